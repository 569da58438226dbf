"""False-alarm classifier, isolation forest and evaluation reports."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilescope import config
from tilescope.functions import vectors
from tilescope.functions.ranking import exact_quantile, join_small, top_per_key
from tilescope.operators import discovery
from tilescope.operators.change import confidence_fallback
from tilescope.session import checkpointed, written

# ---------------------------------------------------------------------------
# Random forest
# ---------------------------------------------------------------------------


def stratified_split(rows: DataFrame, key: str, label: str = "label", test_share: float = 0.25) -> DataFrame:
    """Add `is_test`: within each label, rows whose key hash falls in the lowest share.

    The cut is the exact order statistic of the hashes, found without sorting a
    label's rows in one place, so both labels are split at the same share.
    """
    hashed = rows.withColumn("__h", F.pmod(F.xxhash64(F.col(key)), F.lit(2**40)).cast("double"))
    cut = exact_quantile(hashed, [label], "__h", lambda n: F.greatest(F.floor(n * test_share) - 1, F.lit(0)), "__cut")
    return (
        join_small(hashed, cut.select(label, "__cut"), [label])
        .withColumn("is_test", F.col("__h") <= F.col("__cut"))
        .drop("__h", "__cut")
    )


def balanced_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """Weight n / (classes * class size) per row; the class table has one row per class."""
    sizes = rows.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    table = sizes.agg(F.map_from_entries(F.collect_list(F.struct(label, "__n"))).alias("m")).scalar()
    sized = rows.withColumn("__m", table)
    total = F.aggregate(F.map_values("__m"), F.lit(0).cast("long"), lambda a, b: a + b)
    return sized.withColumn("weight", total / (F.size("__m") * F.element_at("__m", F.col(label)))).drop("__m")


def rf_train(
    rows: DataFrame,
    features: Sequence[str] = tuple(config.CHANGE_FEATURES),
    label: str = "label",
    trees: int = 50,
    depth: int = 4,
    seed: int = 42,
) -> PipelineModel:
    """Balanced random forest on the change features."""
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    forest = RandomForestClassifier(
        numTrees=trees, maxDepth=depth, seed=seed, labelCol=label, featuresCol="features", weightCol="weight"
    )
    # Training makes several passes over these few columns, so they are written once.
    weighted = written(balanced_weights(rows.select(*features, label), label))
    return Pipeline(stages=[assembler, forest]).fit(weighted)


def rf_score(rows: DataFrame, model: PipelineModel | None, calibration: float = config.DRIFT_THRESHOLD) -> DataFrame:
    """Add `confidence`: the forest's probability of real change, or the drift ratio without a model."""
    if model is None:
        return rows.withColumn("confidence", confidence_fallback(F.col("drift"), calibration))
    scored = model.transform(rows)
    return scored.withColumn("confidence", vector_to_array("probability")[1]).drop(
        "features", "rawPrediction", "probability"
    )


def feature_rank(model: PipelineModel, spark, features: Sequence[str] = tuple(config.CHANGE_FEATURES)) -> DataFrame:
    """Feature importances, largest first."""
    weights = model.stages[-1].featureImportances.toArray()
    table = spark.createDataFrame([(f, float(w)) for f, w in zip(features, weights)], "feature string, importance double")
    return table.orderBy(F.col("importance").desc(), "feature")


def confusion_report(rows: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Per class: matrix row, precision, recall and F1, from one aggregation."""
    y, p = F.col(label), F.col(prediction)
    cells = rows.agg(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("class"),
                    F.count_if((y == c) & (p == 0)).alias("predicted_0"),
                    F.count_if((y == c) & (p == 1)).alias("predicted_1"),
                    F.count_if((y == c) & (p == c)).alias("hit"),
                    F.count_if(p == c).alias("claimed"),
                    F.count_if(y == c).alias("support"),
                )
                for c in (0, 1)
            ]
        ).alias("rows")
    )
    flat = cells.select(F.inline("rows"))

    def share(a: Column, b: Column) -> Column:
        return F.when(b == 0, F.lit(0.0)).otherwise(a / b)

    precision, recall = share(F.col("hit"), F.col("claimed")), share(F.col("hit"), F.col("support"))
    rated = flat.withColumn("precision", precision).withColumn("recall", recall)
    both = F.col("precision") + F.col("recall")
    return rated.withColumn(
        "f1", F.when(both == 0, F.lit(0.0)).otherwise(2 * F.col("precision") * F.col("recall") / both)
    ).drop("hit", "claimed")


def class_gap(rows: DataFrame, label: str = "label", score: str = "confidence") -> DataFrame:
    """Mean score of both classes and the difference."""
    means = rows.agg(
        F.avg(F.when(F.col(label) == 1, F.col(score))).alias("real_avg"),
        F.avg(F.when(F.col(label) == 0, F.col(score))).alias("false_avg"),
    )
    return means.withColumn("gap", F.col("real_avg") - F.col("false_avg"))


def derived_features(rows: DataFrame) -> DataFrame:
    """Add max_cloud, the cloudier side, and month_diff, the distance of the months."""
    return rows.withColumns(
        {
            "max_cloud": F.greatest("cloud_t1", "cloud_t2"),
            "month_diff": F.abs(F.col("month_t1") - F.col("month_t2")),
        }
    )


def feature_histogram(rows: DataFrame, feature: str, bins: int, label: str = "label") -> DataFrame:
    """Equal-width histogram of a feature per label, over the feature's whole range."""
    ends = rows.agg(F.struct(F.min(feature).alias("lo"), F.max(feature).alias("hi"))).scalar()
    spread = rows.withColumn("__e", ends)
    lo, hi = F.col("__e.lo"), F.col("__e.hi")
    place = F.when(hi == lo, F.lit(0)).otherwise(
        F.least(F.lit(bins - 1), F.floor((F.col(feature) - lo) / (hi - lo) * bins))
    )
    return spread.groupBy(label, place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------------------
# Isolation forest
# ---------------------------------------------------------------------------


def _average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype="float64")
    out = np.where(n == 2, 1.0, 0.0)
    big = n > 2
    m = n[big]
    out[big] = 2 * (np.log(m - 1) + np.euler_gamma) - 2 * (m - 1) / m
    return out


def _grow(points: np.ndarray, seed: int) -> list[tuple[int, float, int, int, float]]:
    """One isolation tree over a small sample: (feature, cut, left, right, depth at leaf)."""
    rng = np.random.default_rng(seed)
    limit = math.ceil(math.log2(max(len(points), 2)))
    nodes: list[tuple[int, float, int, int, float]] = []

    def leaf(n: int, depth: int) -> int:
        nodes.append((-1, 0.0, -1, -1, depth + float(_average_path(np.array([n]))[0])))
        return len(nodes) - 1

    def build(rows: np.ndarray, depth: int) -> int:
        low, high = rows.min(axis=0), rows.max(axis=0)
        open_features = np.flatnonzero(high > low)
        if len(rows) <= 1 or depth >= limit or len(open_features) == 0:
            return leaf(len(rows), depth)
        f = int(rng.choice(open_features))
        cut = float(rng.uniform(low[f], high[f]))
        here = len(nodes)
        nodes.append((f, cut, -1, -1, 0.0))
        goes_left = rows[:, f] <= cut
        left, right = build(rows[goes_left], depth + 1), build(rows[~goes_left], depth + 1)
        nodes[here] = (f, cut, left, right, 0.0)
        return here

    build(points, 0)
    return nodes


NODE_SCHEMA = "tree int, node int, feature int, cut double, left int, right int, depth double"


def _lowest_per_tree(trees: int, sample: int, seed: int):
    """Rows (tree, h, key) of a task: for every tree the keys with the lowest hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = np.random.default_rng(seed).integers(1, 2**63, trees, dtype="uint64")
        limit = np.full(trees, np.iinfo("uint64").max, "uint64")
        held: list[list[tuple[np.ndarray, pa.Array]]] = [[] for _ in range(trees)]
        sizes = np.zeros(trees, "int64")
        kind = None

        def trim(tree: int) -> None:
            h = np.concatenate([x for x, _ in held[tree]])
            keys = pa.concat_arrays([k for _, k in held[tree]])
            order = np.argsort(h, kind="stable")
            cut = h[order[min(sample, len(h)) - 1]]
            keep = order[h[order] <= cut]  # equal hashes stay: the key settles them later
            held[tree], sizes[tree] = [(h[keep], keys.take(pa.array(keep)))], len(keep)
            if len(h) >= sample:
                limit[tree] = cut

        for batch in batches:
            base, keys = batch.column(0).to_numpy().view("uint64"), batch.column(1)
            kind = keys.type
            for begin in range(0, len(base), 4096):
                h = (base[begin : begin + 4096, None] ^ salts[None, :]) * np.uint64(0x9E3779B97F4A7C15)
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                row, tree = np.nonzero(h <= limit[None, :])
                order = np.argsort(tree, kind="stable")
                row, tree = row[order], tree[order]
                cuts = np.searchsorted(tree, np.arange(trees + 1))
                for t in np.unique(tree).tolist():
                    mine = row[cuts[t] : cuts[t + 1]]
                    held[t].append((h[mine, t], keys.take(pa.array(begin + mine))))
                    sizes[t] += len(mine)
                    if sizes[t] > 4 * sample:
                        trim(t)
        for t in range(trees):
            if sizes[t]:
                trim(t)
                h, keys = held[t][0]
                signed = (h ^ np.uint64(1 << 63)).view("int64")  # the same order
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(h), t, "int32")), pa.array(signed), keys.cast(kind)], ["tree", "h", "key"]
                )

    return run


def isolation_trees(
    tiles: DataFrame,
    key: str,
    trees: int = 100,
    sample: int = 256,
    seed: int = 42,
    vector: str = "embedding",
) -> DataFrame:
    """Grow the forest: one small sample per tree, one task-sized group per tree.

    Every tree draws `sample` rows of the whole table, those with the lowest
    hash of (key, tree): each task keeps its lowest in one pass over the keys,
    the lowest of all tasks win, and only their vectors are fetched. Rows
    without a vector are not drawn.
    """
    known = tiles.filter(F.col(vector).isNotNull())
    kind = known.schema[key].dataType.simpleString()
    lowest = known.select(F.xxhash64(F.col(key), F.lit(seed)).alias("h"), F.col(key).alias("key")).mapInArrow(
        _lowest_per_tree(trees, sample, seed), f"tree int, h long, key {kind}"
    )
    drawn = top_per_key(lowest, ["tree"], [F.col("h"), F.col("key")], sample).select("tree", F.col("key").alias(key))
    samples = drawn.join(known.select(key, vector), key)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        ordered = pdf.sort_values(key)
        nodes = _grow(np.array(ordered[vector].tolist(), dtype="float64"), seed + tree)
        out = pd.DataFrame(nodes, columns=["feature", "cut", "left", "right", "depth"])
        out.insert(0, "node", np.arange(len(out)))
        out.insert(0, "tree", tree)
        return out

    return samples.groupBy("tree").applyInPandas(grow, NODE_SCHEMA)


def isolation_score(tiles: DataFrame, forest: pd.DataFrame, sample: int = 256, vector: str = "embedding") -> DataFrame:
    """Add `anomaly_score` in (0, 1]: higher means easier to isolate."""
    packed = [
        {c: g.sort_values("node")[c].to_numpy() for c in ("feature", "cut", "left", "right", "depth")}
        for _, g in forest.groupby("tree")
    ]
    scale = float(_average_path(np.array([sample]))[0]) or 1.0
    model = tiles.sparkSession.sparkContext.broadcast(packed)  # at most trees * 2 * sample nodes

    @F.arrow_udf("double")
    def score(batch: pa.Array) -> pa.Array:
        width = len(batch.drop_null()[0]) if batch.null_count < len(batch) else 1
        rows = vectors.batch_matrix(batch, width)
        depth = np.zeros(len(rows))
        everyone = np.arange(len(rows))
        for tree in model.value:
            at = np.zeros(len(rows), dtype="int64")
            moving = tree["feature"][at] >= 0
            while moving.any():
                who = everyone[moving]
                node = at[who]
                left = rows[who, tree["feature"][node]] <= tree["cut"][node]
                at[who] = np.where(left, tree["left"][node], tree["right"][node])
                moving = tree["feature"][at] >= 0
            depth += tree["depth"][at]
        scores = np.power(2.0, -depth / max(1, len(model.value)) / scale)
        return pa.array(scores, mask=np.isnan(rows[:, 0]))

    return tiles.withColumn("anomaly_score", score(F.col(vector)))


def isolation_forest(
    tiles: DataFrame,
    key: str = "tile_id",
    trees: int = 100,
    sample: int = 256,
    contamination: float = 0.15,
    seed: int = 42,
    vector: str = "embedding",
) -> DataFrame:
    """Score every row and flag the most anomalous share; the vector is left out of the result.

    A row without a vector has no score and no flag.

    The forest (a bounded table) is collected and broadcast. Scores are written
    once, because the cut - the exact linear percentile of all scores, found by
    bracketing rather than sorting - reads them twice more.
    """
    n = tiles.filter(F.col(vector).isNotNull()).count()
    sample = min(sample, n)
    forest = isolation_trees(tiles, key, trees, sample, seed, vector).toPandas()
    scored = checkpointed(isolation_score(tiles, forest, sample, vector).drop(vector))
    cut = exact_quantile(
        scored.select("anomaly_score"), [], "anomaly_score", lambda m: (m - 1) * (1 - contamination), "cut"
    )
    return scored.withColumn("is_anomaly", F.col("anomaly_score") > cut.select("cut").scalar())


def ml_insights_report(tiles: DataFrame, key: str = "tile_id", n_clusters: int = 3) -> dict[str, DataFrame] | None:
    """Cluster groups, cluster sizes and suspicious tiles; None with fewer rows than clusters."""
    if tiles.limit(n_clusters).count() < n_clusters:
        return None
    grouped = discovery.kmeans_insights(tiles, n_clusters)
    listed = isolation_forest(grouped, key)
    return {
        "clusters": listed,
        "distribution": discovery.cluster_distribution(listed, n_clusters),
        "suspicious": listed.filter("is_anomaly").orderBy(F.col("anomaly_score").desc(), key),
    }


# ---------------------------------------------------------------------------
# Timing report
# ---------------------------------------------------------------------------


def latency_stats(calls: DataFrame, keys: Sequence[str], ms: str) -> DataFrame:
    """Min, max, mean and the (int(0.95 n))-th smallest time per key."""
    spread = calls.groupBy(*keys).agg(F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"), F.avg(ms).alias("avg_ms"))
    place = lambda n: F.greatest(F.floor(n * 0.95) - 1, F.lit(0))
    p95 = exact_quantile(calls, keys, ms, place, "p95_ms")
    return join_small(p95, spread, keys)
