"""Unsupervised discovery: clusters, themes, separation and a 2-d map."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilescope.functions import vectors
from tilescope.functions.ranking import top_per_key
from tilescope.session import checkpointed, written

Model = list[list[float]]


def cluster_count(requested: int, n_rows: int) -> int:
    return min(requested, max(2, n_rows // 2))


def aoi_tiles(points: DataFrame, prefix: str) -> DataFrame:
    """One point per tile id of the area (smallest point id)."""
    inside = points.filter(F.coalesce(F.col("tile_id"), F.lit("")).startswith(prefix))
    return top_per_key(inside, ["tile_id"], [F.col("point_id")])


def mean_vector(vector: Column) -> Column:
    return Summarizer.mean(array_to_vector(vectors.as_double(vector)))


def lloyd_round(vectors_only: DataFrame, centroids: Model, previous: Model | None) -> DataFrame:
    """(label, n, moved, total): size, changed labels and vector sum of each cluster.

    Every task reduces its rows to one row per cluster before anything is
    shuffled, so a cluster that holds most rows costs no more than a small one.
    """
    now = vectors.model_matrix(centroids)
    before = vectors.model_matrix(previous) if previous else None

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, moved = np.zeros(now.shape), np.zeros(len(now), "int64"), np.zeros(len(now), "int64")
        for batch in batches:
            rows = vectors.batch_matrix(batch.column(0), now.shape[1])
            label = vectors.nearest_rows(rows, now)
            # Before the first round every label counts as 0.
            old = vectors.nearest_rows(rows, before) if before is not None else np.zeros_like(label)
            for c in np.unique(label):
                mine = label == c
                total[c] += rows[mine].sum(axis=0)
                n[c] += mine.sum()
                moved[c] += (old[mine] != c).sum()
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen.astype("int32")), pa.array(n[seen]), pa.array(moved[seen]), pa.array(list(total[seen]), pa.list_(pa.float64()))],
            names=["label", "n", "moved", "total"],
        )

    parts = vectors_only.mapInArrow(partial, "label int, n long, moved long, total array<double>")
    return parts.groupBy("label").agg(
        F.sum("n").alias("n"), F.sum("moved").alias("moved"), Summarizer.sum(array_to_vector("total")).alias("total")
    )


def kmeans(tiles: DataFrame, starts: Model, max_iter: int = 50, vector: str = "embedding") -> Model:
    """Lloyd rounds from given start vectors; returns the centroids that label the data.

    Both the previous and the current assignment are functions of the row and
    two sets of centroids, so counting changed labels needs no stored labels and
    lineage never grows. Only k sums and counts reach the driver; an empty
    cluster keeps its centroid, and the loop ends when no label changes.
    """
    centroids = [list(map(float, c)) for c in starts]
    previous: Model | None = None
    # Vectors alone stay with the executors between rounds; a lost part is read again.
    base = tiles.filter(F.col(vector).isNotNull()).select(vector).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for _ in range(max_iter):
            rows = lloyd_round(base, centroids, previous).collect()
            if sum(r["moved"] for r in rows) == 0:
                return centroids
            previous = centroids
            centroids = list(centroids)
            for r in rows:
                centroids[r["label"]] = (r["total"].toArray() / r["n"]).tolist()
        # The last assignment was made with the centroids before the last update.
        return previous or centroids
    finally:
        base.unpersist()


def with_cluster(tiles: DataFrame, model: Model, vector: str = "embedding") -> DataFrame:
    return tiles.withColumn("cluster", vectors.nearest_index(F.col(vector), model))


def cluster_means(labelled: DataFrame, vector: str = "embedding") -> DataFrame:
    """(cluster, mean): mean vector of each cluster."""
    return labelled.groupBy("cluster").agg(vector_to_array(mean_vector(F.col(vector))).alias("mean"))


def cluster_centroids(labelled: DataFrame, vector: str = "embedding") -> DataFrame:
    """(cluster, centroid): unit-length mean vector of each cluster."""
    means = cluster_means(labelled, vector)
    length = vectors.norm(F.col("mean"))
    return means.select(
        "cluster",
        F.when(length > 0, F.transform("mean", lambda x: x / length)).otherwise(F.col("mean")).alias("centroid"),
    )


def theme_label(centroids: DataFrame, themes: Sequence[tuple[str, Sequence[float]]]) -> DataFrame:
    """Best theme of each centroid by dot product with unit theme vectors; the first wins ties."""
    scored = centroids.select("cluster", F.posexplode(vectors.cosine_to(F.col("centroid"), [v for _, v in themes])).alias("i", "cos"))
    best = scored.groupBy("cluster").agg(F.max(F.struct(F.col("cos"), -F.col("i"))).alias("best"))
    names = F.array(*[F.lit(n) for n, _ in themes])
    found = F.col("best.cos") > -1.0
    return best.select(
        "cluster",
        F.when(found, F.get(names, -F.col("best.col2"))).otherwise(F.lit("Unassigned")).alias("theme"),
        F.when(found, F.col("best.cos")).otherwise(F.lit(-1.0)).alias("similarity"),
    )


def land_cover_tags(
    tiles: DataFrame, labels: Sequence[tuple[str, Sequence[float]]], top_k: int = 2, vector: str = "embedding"
) -> DataFrame:
    """The top_k labels of every tile by cosine. Ranking happens inside the row: no shuffle."""
    names = F.array(*[F.lit(n) for n, _ in labels])
    scores = vectors.cosine_to(F.col(vector), [v for _, v in labels])
    scored = tiles.withColumn("__s", scores).drop(vector)
    ranked = F.sort_array(F.transform("__s", lambda s, i: F.struct((-s).alias("neg"), i.alias("i"))))
    kept = [c for c in tiles.columns if c != vector]
    return scored.select(*kept, F.posexplode(F.slice(ranked, 1, top_k)).alias("__r", "__t")).select(
        *kept,
        (F.col("__r") + 1).alias("rank"),
        F.get(names, F.col("__t.i")).alias("label"),
        (-F.col("__t.neg")).alias("confidence"),
    )


def cluster_summary(labelled: DataFrame, n_samples: int = 5) -> DataFrame:
    """Size, share, envelope and first tile ids of each cluster, largest first."""
    total = labelled.agg(F.count(F.lit(1)).alias("n")).scalar()
    sizes = labelled.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("tile_count"),
        F.min(F.col("bounds")[0]).alias("min_left"),
        F.min(F.col("bounds")[1]).alias("min_bottom"),
        F.max(F.col("bounds")[2]).alias("max_right"),
        F.max(F.col("bounds")[3]).alias("max_top"),
    )
    firsts = top_per_key(labelled.select("cluster", "tile_id"), ["cluster"], [F.col("tile_id")], n_samples)
    samples = firsts.groupBy("cluster").agg(F.sort_array(F.collect_list("tile_id")).alias("sample_tiles"))
    return (
        sizes.join(samples, "cluster")
        .withColumn("percentage", F.col("tile_count") / total * 100)
        .orderBy(F.col("tile_count").desc(), "cluster")
    )


def centroid_pairs(centroids: DataFrame) -> DataFrame:
    """Cosine and distance of every centroid pair i < j (k rows on each side)."""
    a = centroids.select(F.col("cluster").alias("a"), F.col("centroid").alias("va"))
    b = centroids.select(F.col("cluster").alias("b"), F.col("centroid").alias("vb"))
    cos = vectors.dot(F.col("va"), F.col("vb"))
    # Equi join on a constant-size list of partners: cluster a meets each b > a.
    partners = F.array_sort(F.collect_set("b"))
    others = b.agg(partners.alias("others")).scalar()
    listed = a.withColumn("__o", others)
    wanted = listed.withColumn("b", F.explode(F.filter("__o", lambda x: x > F.col("a")))).drop("__o")
    return wanted.join(b, "b").select("a", "b", cos.alias("cosine_similarity"), (F.lit(1.0) - cos).alias("cosine_distance"))


def cluster_separation(pairs: DataFrame) -> DataFrame:
    """Mean and minimum distance between centroids; 0 when there are no pairs."""
    return pairs.agg(
        F.coalesce(F.avg("cosine_distance"), F.lit(0.0)).alias("mean_distance"),
        F.coalesce(F.min("cosine_distance"), F.lit(0.0)).alias("min_distance"),
    )


def cluster_distribution(labelled: DataFrame, k: int) -> DataFrame:
    """Rows per cluster, with empty clusters as 0."""
    ids = labelled.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster"))
    counts = labelled.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return ids.join(counts, "cluster", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def k_sweep(
    tiles: DataFrame,
    starts: Model,
    themes: Sequence[tuple[str, Sequence[float]]],
    ks: Sequence[int] = (3, 4, 5),
    max_iter: int = 50,
) -> DataFrame:
    """Number of distinct themes found for each k."""
    out = None
    for k in ks:
        model = kmeans(tiles, starts[:k], max_iter)
        labels = theme_label(cluster_centroids(with_cluster(tiles, model)), themes)
        row = labels.agg(
            F.lit(k).alias("k"),
            F.count(F.lit(1)).alias("n_clusters"),
            F.count_distinct("theme").alias("unique_themes"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def kmeans_insights(tiles: DataFrame, n_clusters: int = 3, n_init: int = 5, seed: int = 42, vector: str = "embedding") -> DataFrame:
    """Best of several MLlib k-means runs, by training cost."""
    # Every run reads the vectors anew from their source; nothing of their size is kept on executors.
    data = tiles.withColumn("features", array_to_vector(vectors.as_double(F.col(vector))))
    spark = tiles.sparkSession

    def fit(i: int):
        means = KMeans(k=n_clusters, seed=seed + i, maxIter=50, featuresCol="features", predictionCol="cluster")
        return means.fit(data.select("features").filter("features IS NOT NULL"))

    # The runs are independent jobs, so they share the cluster.
    with ThreadPoolExecutor(n_init) as pool:
        fits = list(pool.map(inheritable_thread_target(spark)(fit), range(n_init)))
    best = min(fits, key=lambda m: m.summary.trainingCost)
    return best.transform(data).drop("features")


def pca_2d(tiles: DataFrame, vector: str = "embedding") -> DataFrame:
    """First two principal components of the centred vectors (pc1, pc2).

    The sign of a component is set so that its largest loading is positive. With
    fewer than two dimensions' worth of variance MLlib still returns a basis.
    """
    data = tiles.withColumn("__f", array_to_vector(vectors.as_double(F.col(vector))))
    centre = data.agg(Summarizer.mean(F.col("__f")).alias("m")).first()["m"].toArray()
    basis = PCA(k=2, inputCol="__f", outputCol="__p").fit(data).pc.toArray().copy()
    for j in range(basis.shape[1]):
        if basis[np.argmax(np.abs(basis[:, j])), j] < 0:
            basis[:, j] = -basis[:, j]
    shift = centre @ basis
    loadings = basis.T.tolist()

    matrix = np.asarray(loadings)

    @F.arrow_udf("array<double>")
    def project(batch: pa.Array) -> pa.Array:
        flat = vectors.batch_matrix(batch, matrix.shape[1]) @ matrix.T - shift
        offsets = np.arange(0, flat.size + 1, matrix.shape[0], dtype="int32")
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.ravel()))

    return (
        tiles.withColumn("__p", project(F.col(vector)))
        .withColumn("pc1", F.col("__p")[0])
        .withColumn("pc2", F.col("__p")[1])
        .drop("__p")
    )


def min_max_100(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rescale columns to [-100, 100] by their global range (one aggregation, used as constants)."""
    ends = df.agg(F.struct(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])).scalar()
    out = df.withColumn("__e", ends)
    for c in columns:
        lo, hi = F.col(f"__e.lo_{c}"), F.col(f"__e.hi_{c}")
        out = out.withColumn(c, (F.col(c) - lo) / F.greatest(hi - lo, F.lit(1e-6)) * 200 - 100)
    return out.drop("__e")


def discovery_report(
    points: DataFrame,
    prefix: str,
    starts: Model,
    themes: Sequence[tuple[str, Sequence[float]]],
    max_iter: int = 50,
    vector: str = "embedding",
) -> dict[str, DataFrame] | None:
    """Points, cluster summaries and separation; None when fewer than three tiles remain."""
    # Every k-means round reads the tiles, so removing repeats is done once.
    tiles = checkpointed(aoi_tiles(points, prefix))
    n = tiles.count()
    if n < 3:
        return None
    model = kmeans(tiles, starts[: cluster_count(len(starts), n)], max_iter)
    labelled = with_cluster(tiles, model)
    centroids = written(cluster_centroids(labelled))  # one row per cluster
    # Labels are written once for the summaries, without the vectors.
    narrow = written(labelled.drop(vector))
    clusters = cluster_summary(narrow).join(theme_label(centroids, themes), "cluster")
    plane = min_max_100(pca_2d(labelled).withColumnsRenamed({"pc1": "x", "pc2": "y"}), ["x", "y"])
    return {
        "points": plane.select("tile_id", "cluster", "x", "y", "date", "bounds"),
        "clusters": clusters,
        "separation": cluster_separation(centroid_pairs(centroids)),
        "pairs": centroid_pairs(centroids),
    }
