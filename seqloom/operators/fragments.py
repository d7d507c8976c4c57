"""Positions of long texts as rows."""

from pyspark.sql import DataFrame, functions as F

BLOCK = 256


def text_blocks(df: DataFrame, keys: list, sequence: str, size: int, overlap: int) -> DataFrame:
    """(keys, _i, _b, _own): text from letter _i * size on, its own _own letters and up to `overlap` (at most `size`) of the
    next block, in one pass over each text."""
    parts = df.select(*keys, F.regexp_extract_all(sequence, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)).alias("_p"))
    joined = F.transform(
        "_p",
        lambda p, i: F.concat(p, F.coalesce(F.left(F.get("_p", i + 1), F.lit(overlap)), F.lit(""))),
    )
    blocks = parts.select(*keys, F.posexplode(joined).alias("_i", "_b"), F.transform("_p", F.length).alias("_len"))
    return blocks.select(*keys, "_i", "_b", F.element_at("_len", F.col("_i") + 1).alias("_own"))


def text_windows(df: DataFrame, key, sequence: str, k: int) -> DataFrame:
    """(key, start, window): the text of up to k letters from every 0-based start.

    Texts are first cut into blocks that overlap by k-1 letters, so that the cost is linear in
    the length and a row never carries a whole text. A block is at least k letters, so the next one
    holds all that a window needs.
    """
    size = max(BLOCK, k)
    keys = [key] if isinstance(key, str) else list(key)
    blocks = text_blocks(df, keys, sequence, size, k - 1)
    starts = F.posexplode(F.transform(F.sequence(F.lit(1), F.col("_own")), lambda j: F.substr("_b", j, F.lit(k))))
    return (
        blocks.select(*keys, "_i", starts.alias("_j", "window"))
        .select(*keys, (F.col("_i").cast("bigint") * size + F.col("_j")).alias("start"), "window")
    )
