"""Substring and overlap joins against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tilescope.operators import containment, overlap


def test_contained_pairs(spark):
    rng = random.Random(4)
    texts = {"".join(rng.choice("ab_") for _ in range(rng.randint(1, 40))) for _ in range(150)} | {"", "é中x", "x" * 100}
    needles = {t[i : i + rng.randint(1, 34)] for t in texts for i in range(0, max(1, len(t)), 9)} | {"", "nowhere", "中", "x" * 70}
    a = spark.createDataFrame([(n,) for n in needles] * 2 + [(None,)], "needle string")
    b = spark.createDataFrame([(t,) for t in texts] * 2 + [(None,)], "text string")
    got = [tuple(r) for r in containment.contained_pairs(a, b).collect()]
    want = {(n, t) for n in needles for t in texts if n and n in t}
    assert len(got) == len(set(got)) and set(got) == want
    assert containment.contained_pairs(a.limit(0), b).count() == containment.contained_pairs(a, b.limit(0)).count() == 0


def test_records_of_requests_on_a_tile_with_many_rows(spark):
    queue = spark.range(3000).select("id", F.when(F.col("id") < 2000, "hot_1").otherwise(F.concat(F.lit("t_"), "id")).alias("tile_id"))
    queue = queue.withColumn("created_at", (F.col("id") % 50).cast("timestamp"))
    asked = spark.createDataFrame([("hot_1",), ("2500",), ("the t_2500 tile",), ("t_299",), ("none of them",)], "wanted string")
    got = {(r["wanted"], r["id"], r["match_grade"]) for r in containment.records_of_requests(queue, asked, 2).collect()}
    assert got == {
        ("hot_1", 1999, 1), ("hot_1", 1949, 1), ("2500", 2500, 0), ("the t_2500 tile", 2500, 2), ("t_299", 2999, 2), ("t_299", 2998, 2),
    }


@pytest.mark.parametrize("huge", [False, True])
def test_overlap_pairs(spark, huge):
    rng = random.Random(9)

    def boxes(n, scale):
        out = []
        for k in range(n):
            x, y = rng.uniform(-12, 12), rng.uniform(-12, 12)
            side = 2 ** rng.uniform(-6, scale)
            out.append((k, [x, y, x + side, y + side * rng.random()]))
        return out + [(n, [0.0, 0.0, 0.0, 0.0]), (n + 1, [1.0, 1.0, 2.0, 2.0]), (n + 2, None), (n + 3, [0.0, 0.0, float("nan"), 1.0]), (n + 4, [1.0, 0.0, 0.0, 1.0])]

    left, right = boxes(80, 4), boxes(200, 3)
    if huge:
        left += [(1000, [-1e4, -1e4, 1e4, 1e4])]
    a = spark.createDataFrame(left, "left_id long, bounds array<double>")
    b = spark.createDataFrame(right, "right_id long, bounds array<double>")
    got = [tuple(r) for r in overlap.overlap_pairs(a, b).collect()]

    def sound(v):
        return v is not None and all(x == x for x in v) and v[0] <= v[2] and v[1] <= v[3]

    want = {
        (i, j) for i, p in left for j, q in right
        if sound(p) and sound(q) and p[0] <= q[2] and q[0] <= p[2] and p[1] <= q[3] and q[1] <= p[3]
    }
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_a_huge_area_is_many_tasks(spark):
    """Rows of the cell that holds all small boxes are dealt by salt."""
    a = spark.createDataFrame([(1, [0.0, 0.0, 1e6, 1e6])], "left_id long, bounds array<double>")
    b = spark.range(4000).select(F.col("id").alias("right_id"), F.array(*[F.col("id").cast("double") + k for k in (0, 0, 1, 1)]).alias("bounds"))
    found = overlap.overlap_pairs(a, b)
    assert found.count() == 4000
    salts = b.groupBy(F.pmod(F.xxhash64("right_id"), F.lit(overlap.SALTS))).count().collect()
    assert len(salts) == overlap.SALTS and max(r["count"] for r in salts) < 400


def test_scenes_of_areas_meet_by_different_boxes(spark, monkeypatch):
    """400 areas on three boxes and 300 scenes on two: five boxes meet, and every area still has its whole list."""
    boxes = {0: [0.0, 0.0, 2.0, 2.0], 1: [5.0, 5.0, 6.0, 9.0], 2: [0.5, 0.5, 5.5, 5.5]}
    areas = [(k, boxes[k % 3]) for k in range(400)] + [(3, boxes[1]), (900, None), (901, [9.0, 9.0, 1.0, 1.0]), (902, [1e3, 1e3, 1e3, 1e3])]
    scenes = [(k, f"2020-01-{1 + k * 7 % 28:02d}", float(k % 90), [5.2, 8.0, 7.0, 8.5] if k % 2 else [1.0, 1.0, 1.5, 1.5]) for k in range(300)]
    met = []
    pairs_of = overlap.overlap_pairs

    def counted(left, right):
        found = pairs_of(left, right)
        met.append(found.count())
        return found

    monkeypatch.setattr(overlap, "overlap_pairs", counted)
    a = spark.createDataFrame(areas, "area_id long, bounds array<double>")
    c = spark.createDataFrame(scenes, "scene_id long, date string, cloud_cover double, bounds array<double>")
    got = {(r["area_id"], r["rank"], r["scene_id"], r["date"]) for r in overlap.scenes_of_areas(c, a, "2020-01-03", "2020-01-20", 60.0, 5).collect()}
    hits = {}
    for i, p in areas:
        for scene, date, cloud, q in scenes if p and p[0] <= p[2] else []:
            if "2020-01-03" <= date <= "2020-01-20" and cloud < 60 and p[0] <= q[2] and q[0] <= p[2] and p[1] <= q[3] and q[1] <= p[3]:
                hits.setdefault(i, []).append((date, scene))
    want = set()
    for i, own in hits.items():
        first = sorted(own, key=lambda h: ([-ord(x) for x in h[0]], h[1]))[:5]
        want |= {(i, k + 1, scene, date) for k, (date, scene) in enumerate(first)}
    assert got == want and met[0] < 7


def test_cells_of_boxes_are_not_broadcast(spark):
    a = spark.range(50).select(F.col("id").alias("left_id"), F.array(*[F.col("id").cast("double") + k for k in (0, 0, 1, 1)]).alias("bounds"))
    found = overlap.overlap_pairs(a, a.withColumnRenamed("left_id", "right_id"))
    assert found.count() == 148
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
