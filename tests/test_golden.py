"""Small fixtures with results worked out by hand, one per delicate rule."""

import gzip
import math

import pytest
from pyspark.sql import functions as F

from seqloom import constants as K
from seqloom.functions import chemistry as C, sequences as Q
from seqloom.operators import alignment as N, filters as L, motifs as M, scoring as R, similarity as S
from seqloom.sources import readers, writers


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_master_rules(spark):
    data = [
        (1, "k1", " acdefg ", "yes", "first"), (2, "k2", "ACDEFG", "yes", "last"), (3, "ACDEFK", "", "yes", "key used"),
        (4, "k4", "ACDEFX", "yes", "bad residue"), (5, "k5", "ACDE", "yes", "short"), (6, "k6", "ACDEF", "no", "not standard"),
        (7, "k7", "A" * 100, "yes", "longest"), (8, "k8", "A" * 101, "yes", "too long"),
    ]
    df = spark.createDataFrame(data, "n int, sequence_key string, representative_sequence string, is_standard_aa_sequence string, evidence_groups string")
    for c in ("databases", "activity_summary", "hemolysis_summary", "combo_class"):
        df = df.withColumn(c, F.lit(""))
    got = {r["sequence"]: r["evidence_groups"] for r in L.load_master(df.withColumn("evidence_rows", F.lit(1)), "n").collect()}
    assert got == {"ACDEFG": "last", "ACDEFK": "key used", "A" * 100: "longest"}


def test_units_and_numbers(spark):
    mass = 500.0
    cases = [
        ("5", "µM", 5.0), ("5", "μM", 5.0), ("5", "microM", 5.0), ("5", " nM ", 0.005), ("5", "mM", 5000.0), ("5", "ug/mL", 10.0),
        ("5", "microg/ml", 10.0), ("5", "mg/l", 10.0), ("5", "mg/ml", 10000.0), ("5", "units", None), ("0", "uM", None), ("-1", "uM", None),
        ("1e3", "uM", 1000.0), ("1d", "uM", None), ("", "uM", None), (">5", "uM", None), ("0x10", "uM", None),
    ]
    df = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "i int, v string, u string")
    got = rows(df.orderBy("i"), C.to_micromolar(Q.parse_float(F.col("v")), F.col("u"), F.lit(mass)))
    assert [g[0] for g in got] == [pytest.approx(c[2]) if c[2] is not None else None for c in cases]
    special = spark.createDataFrame([("nan",), ("inf",), ("-Infinity",), (" 7 ",)], "v string")
    v = rows(special, Q.parse_float(F.col("v")), Q.is_finite(Q.parse_float(F.col("v"))))
    assert math.isnan(v[0][0]) and math.isinf(v[1][0]) and [x[1] for x in v] == [False, False, False, True]


def test_comparators_and_metrics(spark):
    data = [("MIC ", "<=", "1"), ("mic", ">", "1"), ("LD50", "", "1"), ("IC50", "~", "nan"), ("EC50", " = ", "2")]
    df = spark.createDataFrame(data, "metric string, comparator string, raw_value string").withColumn("unit", F.lit("uM"))
    assert sorted(rows(L.activity_filter(df), "metric", "number")) == [("EC50", 2.0), ("MIC", 1.0)]


def test_motif_rules(spark):
    table = spark.createDataFrame(
        [("AAA", "regular"), ("C-x(2,4)-C-[KR]-x", "PROSITE"), ("[KR]A[", "PROSITE pattern"), (" ", "regular"), ("WW", "MERCI db")], "pattern string, type string"
    )
    active = M.load_motifs(table)
    assert sorted((r["motif"], r["kind"], r["regex"]) for r in active.collect()) == [
        ("AAA", "exact", None), ("C-x(2,4)-C-[KR]-x", "regex", "C.{2,4}C[KR]."), ("WW", "exact", None)
    ]
    assert M.load_motifs(table, ("none",)).count() == 0
    texts = spark.createDataFrame([(1, "AAAAA"), (2, "CGGCKWCGGCRWW"), (3, "GGG"), (4, "")], "id int, sequence string")
    exact = sorted(rows(M.exact_hits(texts, active, "id"), "id", "start", "end", "motif"))
    assert exact == [(1, 0, 3, "AAA"), (1, 1, 4, "AAA"), (1, 2, 5, "AAA"), (2, 11, 13, "WW")]
    regex = sorted(rows(M.regex_hits(texts, active, "id"), "id", "start", "end"))
    assert regex == [(2, 0, 6), (2, 6, 12)]
    negative = M.load_negative(spark.createDataFrame([("KW",), ("",)], "motif string"))
    p = {r["id"]: r for r in M.motif_profile(texts, active, negative, "id").collect()}
    assert (p[2]["active_positions"], p[2]["negative_positions"], p[2]["fixed_positions"], p[2]["free_de"]) == (13, 2, 13, 0)
    assert (p[1]["active_fraction"], p[3]["has_active"], p[4]["length"], p[4]["fixed_fraction"]) == (1.0, False, 0, 0.0)
    region = dict(rows(M.region_index(texts, active.where("kind = 'exact'"), negative, "id"), "id", "region"))
    assert region == {1: "11111", 2: "0000220000011", 3: "000", 4: ""}


def test_any_number_of_patterns_takes_one_plan(spark):
    texts = spark.createDataFrame([(1, "CGGCKWGGG"), (2, "KYKW")], "id int, sequence string")
    few = [("C-x(2)-C", "PROSITE"), ("G-G", "PROSITE"), ("K-[WY]", "PROSITE")]
    many = few + [(f"H-x({i})-W-W", "PROSITE") for i in range(600)]
    hits = [sorted(rows(M.regex_hits(texts, M.load_motifs(spark.createDataFrame(t, "pattern string, type string")), "id"), "id", "start", "end", "motif")) for t in (few, many)]
    assert hits[0] == hits[1] and (1, 6, 8, "G-G") in hits[0] and (2, 2, 4, "K-[WY]") in hits[0]
    assert M.regex_hits(texts, M.load_motifs(spark.createDataFrame([], "pattern string, type string")), "id").count() == 0


def test_automaton_and_join_find_the_same(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "AAAABAAB"), (2, None), (3, ""), (4, "好AB好AB"), (1, "AB")], "id int, sequence string")
    table = spark.createDataFrame([(m, "exact", None, n) for n, m in enumerate(["A", "AA", "AAB", "B", "好A", "ZZ", "AAAABAAB", ""])] + [("AA", "exact", None, 9)], "motif string, kind string, regex string, n int")
    want = sorted((r["id"], i, i + len(m["motif"]), m["motif"], m["n"]) for r in texts.collect() for m in table.collect() if m["motif"] for i in range(len(r["sequence"] or "")) if (r["sequence"] or "").startswith(m["motif"], i))
    for letters in (2_000_000, 0):
        monkeypatch.setattr(M, "AUTOMATON_LETTERS", letters)
        got = M.exact_hits(texts, table, "id", extra=["n"])
        assert sorted(map(tuple, got.collect())) == want
        assert letters == 0 or "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_motif_window_centre(spark):
    texts = spark.createDataFrame([(1, "ACDEFGHIK")], "id int, sequence string")
    spans = spark.createDataFrame([(1, 0, 2, "AC"), (1, 6, 9, "HIK")], "id int, start bigint, end bigint, motif string")
    got = sorted(rows(M.motif_windows(texts, spans, "id", width=5), "motif", "motif_center", "window"))
    assert got == [("AC", 1, "--ACD"), ("HIK", 8, "GHIK-")]


def test_alignment_cleaning(spark):
    body = "ACDEFGHIKL"
    data = [("a", body), ("b", body), ("c", "-CDEFGHIKL"), ("d", "--DEFGHIKL"), ("e", "ACDEFGHIK-"), ("f", "ACDEFGH---"), ("g", "AADEFGHIKL")]
    df = spark.createDataFrame(data, "name string, aligned string")
    out = L.clean_alignment(df, "name", cysteines=(2,), max_leading=1)
    got = {r["name"]: (r["reason"], r["cleaned"]) for r in out.collect()}
    assert got["a"] == ("ok", body) and got["b"] == ("duplicate", None) and got["c"] == ("ok", "-CDEFGHIKL")
    assert got["d"] == ("misaligned_cysteine", "--DEFGHIKL") and got["e"] == ("filled", "ACDEFGHIKS")
    assert got["f"] == ("trailing_gaps", None) and got["g"][0] == "misaligned_cysteine"
    dropped = L.clean_alignment(df, "name", cysteines=(2,), drop_misaligned=True).where("name = 'g'").first()
    assert dropped["cleaned"] is None
    light = L.clean_alignment(spark.createDataFrame([("x", "ACDEFGH---")], "name string, aligned string"), "name", cysteines=(), chain="L").first()
    assert (light["reason"], light["cleaned"]) == ("filled", "ACDEFGHSS-")


def test_conservation_classes(spark):
    data = [("A", "A", "A"), ("A", "A", "C"), ("A", "C", "C"), ("A", "D", "C"), ("A", None, "C")]
    df = spark.createDataFrame(data, "parental string, predicted string, germline string")
    assert [r["conservation"] for r in S.annotate_conservation(df).collect()] == ["Conserved", "Back-mutated", "Humanized", "Engineered", None]
    same = df.limit(1).withColumn("id", F.lit(1))
    assert S.mutation_precision(same, ["id"], "germline", "parental", "predicted").first()["precision"] is None


def test_numbering_to_slots(spark):
    text = "{'fwh1': {'1 ': 'Q', '2': 'V'}, 'cdrh3': {'111A': 'Y', '112A': 'W'}}"
    df = spark.createDataFrame([(text,), ("{'x': {'999': 'A'}}",)], "j string")
    placed, unknown = [r[0] for r in rows(df, Q.place_by_position(F.col("j"), K.HEAVY_POSITIONS))]
    assert len(placed) == 152 and placed[0] == "Q" and placed[1] == "V" and placed[111] == "Y" and placed[134] == "W"
    assert placed.replace("-", "") == "QVYW" and unknown is None
    assert len(K.LIGHT_POSITIONS) == 139 and K.LIGHT_POSITIONS[117] == "112F"


def test_slot_vectors():
    heavy, light = Q.slot_codes("H", "kabat_vernier"), Q.slot_codes("K", "kabat_vernier")
    assert (len(heavy), len(light)) == (152, 139)
    assert [heavy.count(c) for c in (1, 2, 3, 4, 5)] == [14, 20, 37, 2, 8]
    assert [light.count(c) for c in (1, 2, 3, 4, 5)] == [17, 14, 25, 1, 9]
    assert Q.slot_codes("H", "seven").count(5) == 37 and Q.slot_codes("H", "cdr").count(3) == 37


def test_gzip_repertoire_with_corrupt_file(spark, tmp_path):
    lines = ['"{""Run"": 7}"', "a,numbering,b", """x,"{'fw': {'1': 'Q', '2': 'V'}}",1""", "y,,2"]
    with gzip.open(tmp_path / "one.csv.gz", "wt") as f:
        f.write("\n".join(lines) + "\n")
    with gzip.open(tmp_path / "two.csv.gz", "wt") as f:
        f.write('meta\nb,a\n9,z\n')
    blob = gzip.compress(("\n".join(lines) * 500).encode())
    (tmp_path / "bad.csv.gz").write_bytes(blob[: len(blob) // 3])
    got = readers.read_paired_repertoire(spark, str(tmp_path / "*.csv.gz"), ["a", "b", "numbering"])
    rows_ = {(r["name"], r["a"], r["b"], r["numbering"]) for r in got.where("name <> 'bad'").collect()}
    assert rows_ == {("one", "x", "1", "{'fw': {'1': 'Q', '2': 'V'}}"), ("one", "y", "2", None), ("two", "z", "9", None)}


def test_table_with_byte_order_mark(spark, tmp_path):
    (tmp_path / "t.tsv").write_bytes("﻿name\tpeptide\na\tacd-e\n".encode("utf-8"))
    df = readers.resolve_columns(readers.read_table(spark, str(tmp_path / "t.tsv")))
    assert df.columns[:2] == ["sequence_id", "sequence"]
    assert rows(df, "sequence_id", "sequence") == [("a", "ACDE")]
    with pytest.raises(ValueError, match="no sequence column"):
        readers.resolve_columns(df.select("name"))


def test_fasta_lines_and_blanks(spark, tmp_path):
    (tmp_path / "x.fasta").write_text(">a first one\nACD\n\nEFG\n>b\nKLM\n>c|len=3\nWYY")
    got = rows(readers.read_fasta(spark, str(tmp_path / "x.fasta")), "sequence_id", "description", "sequence")
    assert got == [("a", "a first one", "ACDEFG"), ("b", "b", "KLM"), ("c|len=3", "c|len=3", "WYY")]


def test_keyed_table(spark, tmp_path):
    (tmp_path / "k.csv").write_text("id,v,l\n# note\na,1,1;2\nb,x,\na,3,4;5\n")
    got = {r["id"]: (r["v"], r["l"]) for r in readers.read_keyed(spark, str(tmp_path / "k.csv"), "id", numbers=["v"], lists=["l"]).collect()}
    assert got == {"a": (3.0, [4.0, 5.0]), "b": (None, None)}


def test_markdown_numbers(spark):
    df = spark.createDataFrame([(1234.56789, None, "a"), (0.00001234, 1e9, "b"), (0.5, 100.0, "c")], "x double, y double, n string")
    got = [r[0] for r in writers.markdown_rows(df).collect()]
    assert got[2:] == ["| 1234.57 | nan | a |", "| 1.234e-05 | 1e+09 | b |", "| 0.5 | 100 | c |"]


def test_snapshot_is_kept(spark, tmp_path):
    path = str(tmp_path / "snap")
    first = writers.save_snapshot(spark.range(5).toDF("k"), path, ["k"]).count()
    again = writers.save_snapshot(spark.range(9).toDF("k"), path, ["k"])
    assert (first, again.count()) == (5, 5)


def test_jdbc_ranges():
    assert readers.jdbc_options("jdbc:x", "AMP") == {"url": "jdbc:x", "dbtable": "AMP"}
    assert readers.jdbc_options("jdbc:x", "AMP", "id", 0, 100, 8)["numPartitions"] == "8"


def test_scorer_registry():
    assert R.resolve("net-charge,hydro,charge") == ["charge", "hydrophobic"]
    assert R.resolve("none") == [] and R.independent_scorers("charge") == ["hydrophobic"]
    with pytest.raises(ValueError, match="unknown scorer"):
        R.resolve("other")


def test_unknown_token_raises(spark):
    df = spark.createDataFrame([("ACB",)], "s string")
    with pytest.raises(Exception, match="unknown residue B"):
        df.select(Q.tokenize(F.col("s"))).collect()


def test_round_trip_tokens(spark):
    df = spark.createDataFrame([("ACDX-W",)], "s string")
    ids = Q.tokenize(F.col("s"))
    r = df.select(ids.alias("i"), Q.detokenize(ids).alias("d"), Q.detokenize(ids, True).alias("k")).first()
    assert (r["i"], r["d"], r["k"]) == ([0, 1, 2, 20, 21, 18], "ACDXW", "ACDX-W")


def test_log_odds_replaces_zeros(spark):
    f = spark.createDataFrame([(1, "A", 1.0), (1, "C", 0.0), (2, "A", 0.5), (2, "C", 0.5)], "pos int, aa string, freq double")
    got = {(r["pos"], r["aa"]): r["log_odds"] for r in N.log_odds(f).collect()}
    assert got[(1, "A")] == pytest.approx(math.log2(1 / 0.75)) and got[(1, "C")] == pytest.approx(math.log2(0.025 / 0.25))


def test_strict_consensus(spark):
    df = spark.createDataFrame([("AAAC",), ("AACD",), ("AC-E",)], "aligned string")
    assert N.strict_consensus(df).first()[0] == "Aa,*"
