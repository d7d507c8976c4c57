"""Column functions on sequence text: cleaning, validity, keys, tokens, slots."""

from pyspark.sql import Column, functions as F

from seqloom import constants as K


def let(value: Column, fn) -> Column:
    """fn(value) with `value` computed once, for use inside lambdas, which recompute what they inline."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def normalize_sequence(s: Column) -> Column:
    return F.upper(F.trim(F.coalesce(s, F.lit(""))))


def clean_sequence(s: Column) -> Column:
    """Upper-case letters only; gaps and every other symbol are dropped."""
    return F.regexp_replace(F.upper(F.trim(F.coalesce(s, F.lit("")))), r"[^\p{L}]", "")


def standard_sequence(s: Column) -> Column:
    return F.regexp_replace(clean_sequence(s), f"[^{K.RESIDUES}]", "")


def invalid_residues(s: Column) -> Column:
    rest = F.regexp_replace(clean_sequence(s), f"[{K.RESIDUES}]", "")
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(rest, ""), lambda c: c != ""))), "")


def is_valid_sequence(s: Column, min_len: int = 5, max_len: int = 100) -> Column:
    return F.length(s).between(min_len, max_len) & s.rlike(f"^[{K.RESIDUES}]+$")


def stable_key(s: Column) -> Column:
    return F.sha1(F.encode(s, "utf-8"))


def parse_float(s: Column) -> Column:
    """Number or null; never an error. 'nan' and 'inf' parse, as callers test for finiteness.

    Spellings only the JVM accepts ('1d', '2f', hexadecimal) are no numbers.
    """
    text = F.trim(s)
    plain = F.length(F.translate(text, "dDxXpP", "")) == F.length(text)
    suffix = F.lower(F.right(text, F.lit(1))) == "f"
    infinite = F.lower(F.right(text, F.lit(3))) == "inf"
    return F.when(plain & (~suffix | infinite), text.try_cast("double"))


def is_finite(x: Column) -> Column:
    """Not null, NaN or infinite; NaN sorts above infinity, so one comparison does."""
    return F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))


def parent_name(name: Column, marker: str = "_human_sample_") -> Column:
    return F.substring_index(name, marker, 1)


def letters(s: Column) -> Column:
    """Array of single characters; empty text gives an empty array."""
    return F.when(F.length(s) > 0, F.split(s, "")).otherwise(F.array().cast("array<string>"))


def _lookup(keys, values) -> Column:
    return F.create_map(*[F.lit(x) for kv in zip(keys, values) for x in kv])


def token_map() -> Column:
    symbols = list(K.RESIDUES) + ["X", K.GAP]
    return _lookup(symbols, range(len(symbols)))


def tokenize(s: Column) -> Column:
    """Residue ids 0-19, X 20, gap 21; any other symbol raises."""
    table = token_map()
    return F.transform(
        letters(s),
        lambda c: F.coalesce(
            F.try_element_at(table, c), F.raise_error(F.concat(F.lit("unknown residue "), c)).cast("int")
        ),
    )


def detokenize(ids: Column, keep_pads: bool = False) -> Column:
    symbols = F.array(*[F.lit(c) for c in list(K.RESIDUES) + ["X", K.GAP if keep_pads else "", "<msk>"]])
    return F.array_join(F.transform(ids, lambda i: F.element_at(symbols, i + 1)), "")


def pad_tokens(ids: Column, width) -> Column:
    width = F.lit(width) if isinstance(width, int) else width
    return F.concat(ids, F.array_repeat(F.lit(K.TOKEN_PAD), F.greatest(width - F.size(ids), F.lit(0))))


def one_hot(s: Column) -> Column:
    """L x 21 indicator over residues and gap."""
    symbols = F.array(*[F.lit(c) for c in K.RESIDUES + K.GAP])
    return F.transform(
        letters(s), lambda c: F.transform(symbols, lambda a: (a == c).cast("tinyint"))
    )


def segment(s: Column, lengths: Column) -> Column:
    """Pieces of `s` cut at the cumulative lengths."""
    return F.transform(
        F.sequence(F.lit(1), F.size(lengths)),
        lambda i: F.substr(
            s,
            F.aggregate(F.slice(lengths, F.lit(1), i - 1), F.lit(0), lambda acc, x: acc + x) + 1,
            F.element_at(lengths, i),
        ),
    )


def fits(lengths: Column, limits=None) -> Column:
    """Every region is no longer than its limit."""
    limits = F.array(*[F.lit(x) for x in (limits or K.REGION_LIMITS)])
    return F.forall(F.arrays_zip(lengths.alias("n"), limits.alias("m")), lambda z: z["n"] <= z["m"])


def place_by_position(numbering: Column, positions) -> Column:
    """Numbering text (region -> position -> residue) as a fixed-width gapped string.

    Null where a position is not one of `positions`, so that the caller decides to drop the row. Of a position that
    stands twice the last residue counts.
    """
    regions = F.from_json(F.replace(numbering, F.lit("'"), F.lit('"')), "map<string,map<string,string>>")
    entries = F.flatten(F.transform(F.map_values(regions), lambda m: F.map_entries(m)))
    slots = F.transform(entries, lambda e: F.struct(F.trim(e["key"]).alias("k"), e["value"].alias("v")))
    wanted = F.array(*[F.lit(p) for p in positions])

    def fill(m):
        last = lambda p: F.try_element_at(F.filter(m, lambda e: e["k"] == p), F.lit(-1))["v"]
        placed = F.array_join(F.transform(wanted, lambda p: F.coalesce(last(p), F.lit(K.GAP))), "")
        return F.when(F.size(F.array_except(F.transform(m, lambda e: e["k"]), wanted)) == 0, placed)

    return let(slots, fill)


def region_of(position: Column, scheme: str = "imgt", chain: str = "H") -> Column:
    """Region name of a numeric position; K chains follow L."""
    chain = "L" if chain == "K" else chain
    c1, c2, c3 = K.CDR_RANGES[(scheme.lower(), chain)]
    out = F.when(position < c1[0], "FR1").when(position <= c1[1], "CDR1").when(position < c2[0], "FR2")
    out = out.when(position <= c2[1], "CDR2").when(position < c3[0], "FR3").when(position <= c3[1], "CDR3")
    return out.otherwise("FR4")


def slot_codes(chain: str = "H", kind: str = "seven") -> list:
    """Region code per fixed slot: 'seven', 'cdr' (1-3), 'kabat_vernier' or 'kabat'."""
    chain = "L" if chain == "K" else chain
    if kind == "seven":
        return [code for code, n in enumerate(K.SEVEN_REGION_LENGTHS[chain]) for _ in range(n)]
    if kind == "cdr":
        return [(code + 1) // 2 if code % 2 else 0 for code in slot_codes(chain, "seven")]
    codes = [0] * K.SLOT_COUNT[chain]
    for first, last, code in K.KABAT_VERNIER_SLOTS[chain]:
        codes[first:last + 1] = [code] * (last + 1 - first)
    if kind == "kabat":
        codes = [0 if c == 5 else c for c in codes]
    return codes


def rescale_linear(x: Column, t_new: float, t_r: float) -> Column:
    return F.lit((t_new - 1) / (t_r - 1)) * (x - 1) + 1


def pvalue_stars(p: Column) -> Column:
    return (
        F.when(p < 0, "#").when(p > 0.05, "").when(p > 0.01, "*")
        .when(p > 0.001, "**").when(p > 0.0001, "***").otherwise("****")
    )


def extract_numbers(s: Column, signed: bool = True) -> Column:
    """Every number in the text; a dash right before counts as its sign when `signed`."""
    pattern = r"-?\d+(?:\.\d+)?" if signed else r"\d+(?:\.\d+)?"
    return F.transform(F.regexp_extract_all(s, F.lit(pattern), F.lit(0)), lambda x: x.try_cast("double"))


def parse_list(s: Column, *delims: str) -> Column:
    """Delimited text to a (nested) array of numbers; empty text gives an empty array."""
    head, rest = delims[0], delims[1:]
    parts = F.filter(F.split(s, "\\Q" + head + "\\E"), lambda x: F.trim(x) != "")
    if rest:
        return F.transform(parts, lambda x: parse_list(x, *rest))
    return F.transform(parts, lambda x: F.trim(x).try_cast("double"))
