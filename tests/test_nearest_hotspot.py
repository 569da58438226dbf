"""Nearest hotspot: what its joins broadcast."""

import pytest
from pyspark.sql import functions as F

from tilescope.operators import hotspots


def broadcast_rows(plan):
    """Rows of every broadcast in an executed plan."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return broadcast_rows(plan.executedPlan())
    own = [plan.metrics().get("numOutputRows").get().value()] if kind == "BroadcastExchangeExec" else []
    if kind.endswith("QueryStageExec"):
        return own + broadcast_rows(plan.plan())
    children = plan.children()
    return own + [n for k in range(children.size()) for n in broadcast_rows(children.apply(k))]


@pytest.mark.parametrize("small", [100_000, 3])
def test_clicks_are_not_broadcast(spark, tmp_path, monkeypatch, small):
    monkeypatch.setattr(hotspots, "SMALL", small, raising=False)
    spark.range(5000).select(F.col("id").alias("click_id"), (F.col("id") % 70 / 100).alias("lat"), (F.col("id") % 90 / 100).alias("lng")).write.parquet(f"{tmp_path}/clicks")
    # A filter of many rows: the optimizer takes the places to be more than the clicks.
    spots = spark.range(4_000_000).filter("id < 40").select(F.concat(F.lit("s"), "id").alias("id"), (F.col("id") * 7 % 11 / 10).alias("lat"), (F.col("id") * 3 % 13 / 10).alias("lng"))
    clicks = spark.read.parquet(f"{tmp_path}/clicks")
    found = hotspots.nearest_hotspot(clicks, spots, reach=0.25)
    got = {(r["click_id"], round(r["distance"], 9)) for r in found.collect()}
    away = F.sqrt(F.pow(clicks["lat"] - spots["lat"], 2) + F.pow(clicks["lng"] - spots["lng"], 2))
    want = clicks.crossJoin(spots).groupBy("click_id").agg(F.min(away).alias("d")).filter("d <= 0.25")
    assert got == {(r["click_id"], round(r["d"], 9)) for r in want.collect()}
    assert max(broadcast_rows(found._jdf.queryExecution().executedPlan()), default=0) <= 40


def test_the_query_reaches_as_far_as_a_click_on_the_map(spark, duck):
    """Half a degree, as the map's own search: every click with a tile inside it gets the nearest one."""
    from tests.conftest import ROOT
    from tilescope.functions import geodesy
    from tilescope.plans import all_queries
    from tilescope.plans.registry import Data

    d = Data(spark, ROOT)
    spots = geodesy.add_center_wgs84(d.tile_points).select("lat", "lng").distinct().collect()
    clicks = d.view("clicks").collect()
    near = {c["click_id"]: min(((s["lat"] - c["lat"]) ** 2 + (s["lng"] - c["lng"]) ** 2) ** 0.5 for s in spots) for c in clicks}
    query = all_queries()["nearest_hotspot"]
    got = {r["click_id"]: r["distance"] for r in query.run(spark, ROOT).collect()}
    assert got == {c: pytest.approx(m, abs=1e-6) for c, m in near.items() if m <= 0.5}
    assert set(got) == {r[0] for r in duck.execute(query.sql).fetchall()} and max(got.values()) > 0.05
