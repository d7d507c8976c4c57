"""Queries take all rows and all letters of their tables."""

from compare import difference

from seqloom.catalog import ORACLES, QUERIES


def test_identity_to_references_takes_suppliers_and_long_names(spark, tmp_path):
    import duckdb

    tables = {
        "customer": ([(1, "Ada" * 20, "WINDMILL"), (2, "", ""), (3, "Rita", "MAN")], "c_custkey long, c_name string, c_mktsegment string"),
        "supplier": ([(1, "ADA" * 20 + "KILN"), (7, "Nils")], "s_suppkey long, s_name string"),
        "nation": ([(4, "Ada" * 22), (5, "Chad")], "n_nationkey int, n_name string"),
    }
    con = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    out = QUERIES["identity_to_references"](spark, str(tmp_path))
    got = {(r["kind"], r["k"], r["n_nationkey"]): r["identity"] for r in out.collect()}
    assert len(got) == 10 and difference(out, con, ORACLES["identity_to_references"]) is None
    # The first 60 letters are equal, those after them are not.
    assert got["customer", 1, 4] == round(100 * 60 / 68, 6) and got["supplier", 1, 4] == round(100 * 60 / 66, 6)


def test_cells_are_fitted_on_few_rows_without_their_texts(spark):
    from pyspark.sql import functions as F

    from seqloom.operators import composition

    n = 20_000
    rows = spark.range(n, numPartitions=40).select(F.concat(F.lit("MKTAYKWQ" * 20), F.translate(F.col("id").cast("string"), "0123456789", "ACDEFGHIKL")).alias("s"))
    rows = rows.withColumn("comp", composition.composition(F.col("s")))
    # Rows that leave the partitions, of which each would send `sample` otherwise.
    some = composition.fitted_on(rows, n, "s", 400)
    assert some.columns == ["h", "comp"] and 400 <= some.count() < 800
    assert composition.fitted_on(rows, n, "s", n).count() == n
    cells, placed = composition.fit(rows.select("s"), "s", cell_rows=2000, sample=400)
    assert int(cells.rows.sum()) == n == placed.count() and len(cells.cells) > 5
