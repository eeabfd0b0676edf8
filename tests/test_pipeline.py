"""The declared retrieval pipeline: checks, JSON, and one compiled plan."""

import pytest

from quern.plans.pipeline import Chunking, Config, Node, compiled, validate


def test_validation_and_json():
    good = Config((Node("vector_recall", params={"top_k": 5}), Node("rrf_fusion"), Node("parent_expand", enabled=False)))
    assert validate(good) == [] and Config.from_json(good.to_json()) == good
    bad = Config((Node("vector_recall", params={"top_k": "5"}), Node("vector_recall", params={"x": 1}), Node("magic")), Chunking("odd", 0))
    assert len(validate(bad)) == 7
    with pytest.raises(ValueError, match="magic"):
        compiled(bad, {})


def test_compiled(spark):
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    frames = {
        "corpus_vectors": vec, "query_vectors": vec.where("vec_id = 1"),
        "documents": spark.createDataFrame([(2, "red fox"), (3, "blue fox"), (9, "red")], "id long, text string"),
        "queries": spark.createDataFrame([(1, "red")], "query_id long, text string"),
        "parents": spark.createDataFrame([(2, 20)], "id long, parent_id long"),
        "verdicts": spark.createDataFrame([(5, "irrelevant")], "query_id long, verdict string"),
    }
    nodes = (Node("vector_recall", params={"top_k": 2}), Node("keyword_recall"), Node("rrf_fusion"), Node("parent_expand"), Node("verdict_gate"))
    got = [(r["rank"], r["id"]) for r in compiled(Config(nodes), frames).orderBy("rank").collect()]
    assert got[0] == (1, 20) and {i for _, i in got} == {20, 3, 9}
