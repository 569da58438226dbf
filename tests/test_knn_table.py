"""knn_table as registered: the table of queries is every stored vector."""

from tests.conftest import ROOT
from tilescope.plans import all_queries


def test_every_vector_is_a_query(spark, duck):
    query = all_queries()["knn_table"]
    got = [(r["query"], r["rank"], r["tile_id"], r["score"]) for r in query.run(spark, ROOT).collect()]
    asked = {str(r[0]) for r in duck.execute("SELECT vec_id FROM embeddings").fetchall()}
    assert {q for q, *_ in got} == asked and len(got) == 5 * len(asked)
    found = duck.execute(query.sql)
    place = [[c[0] for c in found.description].index(c) for c in ("query", "rank", "tile_id", "score")]
    assert sorted(got) == sorted(tuple(r[k] for k in place) for r in found.fetchall())
