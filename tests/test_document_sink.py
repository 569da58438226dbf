"""One file per document: names, clashes, shards, and jobs that fail."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tilescope.sources.document_sink import write_documents


def exports(spark, rows):
    return spark.createDataFrame(rows, "file_name string, json string")


def files(folder):
    return sorted(n for n in os.listdir(folder) if n != "_SUCCESS")


def test_every_document_is_a_file_under_its_name(spark, tmp_path):
    folder = str(tmp_path / "docs")
    many = spark.range(500).select(
        F.format_string("provenance_hotspot_%d_tile.json", "id").alias("file_name"), F.to_json(F.struct("id")).alias("json")
    )
    write_documents(many.repartition(7).unionByName(many.limit(5)), folder)
    assert files(folder) == sorted(f"provenance_hotspot_{k}_tile.json" for k in range(500))
    assert all(json.load(open(f"{folder}/provenance_hotspot_{k}_tile.json")) == {"id": k} for k in range(500))
    assert sorted(os.listdir(folder))[0] == "_SUCCESS", "no attempt folder stays"
    with pytest.raises(FileExistsError):
        write_documents(many, folder)
    assert len(files(folder)) == 500


def test_a_shared_name_loses_no_document(spark, tmp_path):
    folder = str(tmp_path / "docs")
    rows = [("rec_a.json", f'{{"n": {k}}}') for k in range(40)] + [("rec_a.json", '{"n": 1}'), ("only.json", "{}"), ("plain", "1"), ("plain", "2")]
    write_documents(exports(spark, rows), folder)
    found = files(folder)
    assert len(found) == 43 and "only.json" in found and "rec_a.json" not in found
    texts = [open(f"{folder}/{n}").read() for n in found if n.startswith("rec_a_") and n.endswith(".json")]
    assert sorted(json.loads(t)["n"] for t in texts) == list(range(40))
    assert sorted(open(f"{folder}/{n}").read() for n in found if n.startswith("plain_")) == ["1", "2"]


def test_shards_and_empty_tables(spark, tmp_path):
    write_documents(exports(spark, [(f"d{k}.json", "é" * k) for k in range(60)]), str(tmp_path / "s"), shards=1)
    found = {n: open(f"{p}/{n}").read() for p, _, names in os.walk(tmp_path / "s") for n in names if n != "_SUCCESS"}
    assert found == {f"d{k}.json": "é" * k for k in range(60)}
    assert len(os.listdir(tmp_path / "s")) > 8
    write_documents(exports(spark, []), str(tmp_path / "e"))
    assert os.listdir(tmp_path / "e") == ["_SUCCESS"]


@pytest.mark.parametrize("bad", [("x.json", None), (None, "{}"), ("../x.json", "{}"), ("_SUCCESS", "{}")])
def test_a_failed_task_leaves_nothing(spark, tmp_path, bad):
    folder = str(tmp_path / "docs")
    good = exports(spark, [(f"d{k}.json", "{}") for k in range(100)]).repartition(8)
    with pytest.raises(Exception, match="document"):
        write_documents(good.unionByName(exports(spark, [bad])), folder)
    assert not os.path.exists(folder)
