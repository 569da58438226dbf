"""Clusters, projection, themes, forests and reports against numpy and hand-made rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import ROOT
from tests.fixtures import labelled_pairs
from tilescope.operators import discovery, embedding, learning


@pytest.fixture(scope="module")
def vectors(spark):
    rows = spark.read.parquet(f"{ROOT}/embeddings.parquet").orderBy("vec_id").collect()
    return np.array([r.embedding for r in rows], dtype="float64")


@pytest.fixture(scope="module")
def tiles(spark):
    return spark.read.parquet(f"{ROOT}/embeddings.parquet").withColumn("tile_id", F.format_string("t%05d", "vec_id"))


def lloyd(data, starts, max_iter=50):
    """k-means labels in numpy: stops when no label changes, empty clusters stay put."""
    centres, labels = starts.copy(), np.zeros(len(data), dtype=int)
    for _ in range(max_iter):
        new = np.argmin(((data[:, None, :] - centres[None]) ** 2).sum(axis=2), axis=1)
        if (new == labels).all():
            break
        labels = new
        for c in range(len(centres)):
            if (labels == c).any():
                centres[c] = data[labels == c].mean(axis=0)
    return labels


@pytest.mark.parametrize("max_iter", [1, 3, 50])
def test_kmeans_labels_equal_numpy(tiles, vectors, max_iter):
    starts = vectors[[3, 50, 200, 499]]
    model = discovery.kmeans(tiles, starts.tolist(), max_iter)
    got = [r.cluster for r in discovery.with_cluster(tiles, model).orderBy("vec_id").collect()]
    assert got == lloyd(vectors, starts, max_iter).tolist()


def test_empty_cluster_keeps_its_start(tiles, vectors):
    starts = [vectors[0].tolist(), (np.ones(64) * 50).tolist(), vectors[9].tolist()]
    model = discovery.kmeans(tiles, starts, 5)
    assert model[1] == starts[1]


def test_cluster_count_rule():
    assert [discovery.cluster_count(4, n) for n in (3, 5, 6, 100)] == [2, 2, 3, 4]


def test_pca_equals_svd(tiles, vectors):
    rows = discovery.pca_2d(tiles).orderBy("vec_id").collect()
    got = np.array([[r.pc1, r.pc2] for r in rows])
    centred = vectors - vectors.mean(axis=0)
    want = centred @ np.linalg.svd(centred, full_matrices=False)[2][:2].T
    assert np.abs(np.abs(got) - np.abs(want)).max() < 1e-6


def test_themes_first_wins_ties_and_unassigned(spark):
    centroids = spark.createDataFrame([(0, [1.0, 0.0]), (1, [-1.0, 0.0])], "cluster int, centroid array<double>")
    themes = [("first", [2.0, 0.0]), ("same", [1.0, 0.0]), ("third", [0.0, 1.0])]
    got = {r.cluster: (r.theme, r.similarity) for r in discovery.theme_label(centroids, themes).collect()}
    assert got == {0: ("first", 1.0), 1: ("third", 0.0)}
    alone = discovery.theme_label(centroids.filter("cluster = 1"), themes[:1]).first()
    assert (alone.theme, alone.similarity) == ("Unassigned", -1.0)


def test_separation_of_one_cluster_is_zero(spark):
    centroids = spark.createDataFrame([(0, [1.0, 0.0])], "cluster int, centroid array<double>")
    assert tuple(discovery.cluster_separation(discovery.centroid_pairs(centroids)).first()) == (0.0, 0.0)


def test_kmeans_insights_labels_everything(tiles):
    out = discovery.kmeans_insights(tiles, 3, n_init=2)
    sizes = {r.cluster: r.n for r in discovery.cluster_distribution(out, 3).collect()}
    assert sum(sizes.values()) == 500 and set(sizes) == {0, 1, 2}


def test_isolation_forest_flags_planted_outliers(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(0, 1, (340, 6))
    data[:40] += 12
    rows = spark.createDataFrame([(f"r{i:04d}", row.tolist()) for i, row in enumerate(data)], "tile_id string, embedding array<double>")
    judged = learning.isolation_forest(rows).toPandas().sort_values("tile_id")
    flagged = judged[judged.is_anomaly]
    assert len(flagged) == round(340 * 0.15)
    assert judged.anomaly_score.between(0, 1).all()
    assert judged.anomaly_score[:40].mean() > judged.anomaly_score[40:].mean() + 0.1
    assert flagged.anomaly_score.min() > judged[~judged.is_anomaly].anomaly_score.max()
    again = learning.isolation_forest(rows.repartition(5)).toPandas().sort_values("tile_id")
    assert (again.anomaly_score.values == judged.anomaly_score.values).all()


def test_average_path_length():
    assert learning._average_path(np.array([1, 2, 256])).round(4).tolist() == [0.0, 1.0, 10.2448]


def test_forest_separates_real_changes_from_false_alarms(spark):
    pairs = labelled_pairs(spark)
    model = learning.rf_train(pairs)
    scored = learning.rf_score(pairs, model)
    gap = learning.class_gap(scored).first()
    # Measured on its own training rows: it shows separation, not generalisation.
    assert gap.gap > 0.7 and gap.real_avg > 0.8
    assert learning.confusion_report(scored).agg(F.min("f1")).first()[0] > 0.9
    ranked = learning.feature_rank(model, spark).collect()
    assert len(ranked) == 7 and abs(sum(r.importance for r in ranked) - 1) < 1e-9
    fallback = {r.pair_id: r.confidence for r in learning.rf_score(pairs, None).collect()}
    assert fallback["1-0"] == 1.0 and abs(fallback["0-24"] - 0.128 / 0.25) < 1e-12


def test_split_is_stratified(spark):
    rows = spark.range(4000).select(F.col("id").cast("string").alias("k"), F.when(F.col("id") % 10 == 0, 1).otherwise(0).alias("label"))
    counts = {(r.label, r.is_test): r["count"] for r in learning.stratified_split(rows, "k").groupBy("label", "is_test").count().collect()}
    assert counts[(1, True)] == 100 and counts[(0, True)] == 900


def test_confusion_by_hand(spark):
    rows = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "label int, prediction int")
    got = {r["class"]: r for r in learning.confusion_report(rows).collect()}
    assert (got[1].precision, got[1].recall) == (1.0, 0.5) and abs(got[1].f1 - 2 / 3) < 1e-12
    assert (got[0].predicted_0, got[0].predicted_1, got[0].support) == (2, 0, 2)
    none = learning.confusion_report(spark.createDataFrame([(0, 0)], "label int, prediction int")).collect()[1]
    assert (none.precision, none.recall, none.f1) == (0.0, 0.0, 0.0)


def test_histogram_equals_numpy(spark):
    values = np.random.default_rng(5).gamma(2.0, 3.0, 500)
    rows = spark.createDataFrame([(0, float(v)) for v in values], "label int, x double")
    got = {r.bin: r.n for r in learning.feature_histogram(rows, "x", 12).collect()}
    want = np.histogram(values, bins=12)[0]
    assert [got.get(i, 0) for i in range(12)] == want.tolist()


def test_text_embedding_reads_whole_texts(spark):
    long = "b" * 200_000 + "A"
    rows = spark.createDataFrame([("1", long), ("2", ""), ("3", "Zz")], "id string, text string")
    got = {r.id: list(r.embedding) for r in embedding.embed_text(rows, embedding.LetterCountEmbedder()).collect()}
    assert got["1"][0] > 0 and abs(np.linalg.norm(got["1"]) - 1) < 1e-12
    assert got["2"] == [0.0] * 26 and got["3"][25] == 1.0
