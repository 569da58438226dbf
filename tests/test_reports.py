"""Texts of the written reports: roundings at ties, and tiles that lack a date or a number."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tilescope.operators import spectral
from tilescope.plans import all_queries


def lineitem(folder, tiles):
    """A lineitem table whose tiles have k cloudy pixels of n on the first date and one clear pixel on the second."""
    rows = []
    for tile, (k, n) in tiles.items():
        rows += [(tile, "F", 5 if i < k else 1) for i in range(n)]
        rows += [(tile, "O", 1)] if tile != 7 else []
    con = duckdb.connect()
    con.execute("CREATE TABLE t (tile BIGINT, status VARCHAR, line INTEGER)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", rows)
    con.execute(
        "CREATE TABLE lineitem AS SELECT tile AS l_suppkey, status AS l_linestatus, line AS l_linenumber, CAST(line AS BIGINT) AS l_partkey,"
        " 10e0 AS l_quantity, 20000e0 AS l_extendedprice, 0.05e0 AS l_discount, 0.02e0 AS l_tax FROM t"
    )
    con.execute(f"COPY lineitem TO '{folder}/lineitem.parquet' (FORMAT parquet)")
    return con


@pytest.mark.parametrize("tiles", [{1: (23, 80), 2: (41, 80), 3: (51, 80)}, {7: (3, 4), None: (1, 2)}])
def test_change_narrative_equals_sql(spark, tmp_path, tiles):
    """23 of 80 are 28.75 per cent as a hundredth part times a hundred, and just below it as a mean of hundreds and zeros."""
    con = lineitem(tmp_path, tiles)
    query = all_queries()["change_narrative"]
    got = {tuple(r) for r in query.run(spark, str(tmp_path)).collect()}
    assert got == set(con.execute(query.sql).fetchall()) and len(got) == len(tiles)


def test_mean_difference_is_exact(spark):
    """However rows are dealt, 92.4375 comes out as such, and its share of full scale, a tie of three decimals, as 0.362."""
    base = spark.range(256).select(F.floor(F.col("id") / 16).alias("y"), (F.col("id") % 16).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(19))).alias("tile"))
    total = F.col("y") * 16 + F.col("x") + F.lit(149) + (F.col("x") + F.col("y")) % 2
    # Per-pixel sums with mean 277.3125 over 256 pixels.
    total = total + F.when((F.col("y") == 0) & (F.col("x") == 0), 80).otherwise(0)
    second = base.select("tile", "y", "x", (total - 40).alias("r"), F.lit(25).alias("g"), F.lit(15).alias("b"))
    first = second.select("tile", "y", "x", F.lit(0).alias("r"), F.lit(0).alias("g"), F.lit(0).alias("b"))
    want = second.filter("tile = 0").agg(F.sum(F.col("r") + 40)).first()[0] / 768
    assert want == 92.4375
    diff = spectral.pixel_difference(first, second, ["tile", "y", "x"], ["r", "g", "b"])
    for n in (1, 3, 7):
        dealt = diff.repartition(n, F.xxhash64("tile", "x", "y")).sortWithinPartitions(F.xxhash64("y", "tile", "x"))
        rows = spectral.difference_summary(dealt, ["tile"]).select("mean_diff", F.format_number(F.col("mean_diff") / 255, 3).alias("text")).collect()
        assert {(r["mean_diff"], r["text"]) for r in rows} == {(want, "0.362")}
