import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscale.operators import dense, lexical
from folioscale.session import local_session


@pytest.fixture(scope="module")
def spark():
    return local_session(2, 2, "1g")


@pytest.mark.parametrize("values", [8_000_000, 20])
def test_nearest_against_brute_force(spark, monkeypatch, values):
    monkeypatch.setattr(dense, "MAX_QUERY_VALUES", values)
    rng = np.random.default_rng(3)
    m = rng.normal(size=(60, 5))
    m[7] = m[8] = m[9]
    m[11] = 0
    rows = [(i, v.tolist(), "x") for i, v in enumerate(m)] + [(100, None, "x"), (101, [1.0], "x")]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, score string")
    queries = table.where("vec_id % 10 = 0 and vec_id < 60 or vec_id = 100").select(F.col("vec_id").alias("query_id"), "embedding")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in dense.nearest(table, queries, 6).collect()}
    length = np.linalg.norm(m, axis=1)
    unit = m / np.where(length > 0, length, 1)[:, None]
    for q in range(0, 60, 10):
        scores = np.round(unit @ unit[q], 6)
        best = sorted(range(60), key=lambda i: (-scores[i], i))[:6]
        assert [got[q, k + 1][0] for k in range(6)] == best
    assert len(got) == 36 and dense.nearest(table, queries.limit(0)).count() == 0


def test_questions_in_parts_give_the_same_answers(spark, monkeypatch):
    docs = spark.createDataFrame([(f"d{i}", f"s{i % 4}", f"kinase buffer {'assay ' * (i % 5)} w{i}") for i in range(40)], "doc_id string, source string, text string")
    questions = spark.createDataFrame([(i, f"assay w{i} kinase") for i in range(12)] + [(50, None), (None, "kinase"), (51, "the of")], "query_id int, text string")
    whole = sorted(tuple(r) for r in lexical.search(docs, questions, 1, 3).collect())
    monkeypatch.setattr(lexical, "MAX_QUESTION_CHARS", 40)
    monkeypatch.setattr(lexical, "MAX_WEIGHTS", 12)
    assert sorted(tuple(r) for r in lexical.search(docs, questions, 1, 3).collect()) == whole and len(whole) == 36
    assert lexical.search(docs.limit(0), questions).count() == 0 and lexical.search(docs, questions.limit(0)).count() == 0


def test_fusion_and_pooling(spark):
    a = spark.createDataFrame([(1, 1, "x", 0.9), (1, 2, "y", 0.5)], "query_id int, rank bigint, id string, score double")
    b = spark.createDataFrame([(1, 1, "y", 7.0), (1, 2, "z", 7.0)], "query_id int, rank bigint, id string, score double")
    rrf = {r.id: r.score for r in dense.reciprocal_rank_fusion([a, b]).collect()}
    assert rrf == {"x": pytest.approx(1 / 61), "y": pytest.approx(1 / 62 + 1 / 61), "z": pytest.approx(1 / 62)}
    # equal scores keep their raw value, as in the reference
    assert {r.id: r.score for r in dense.weighted_fusion(a, b).collect()} == {"x": 0.7, "y": pytest.approx(2.1), "z": pytest.approx(2.1)}
    v = spark.createDataFrame([("g", [3.0, 0.0], 1.0), ("g", [0.0, 4.0], 3.0), ("h", [1.0, 1.0], 1.0), ("h", [-1.0, -1.0], 1.0), ("n", None, 1.0)], "g string, embedding array<double>, w double")
    got = {r.g: r.pooled for r in dense.pooled(v, "g", weight=F.col("w")).collect()}
    assert got["g"] == [pytest.approx(3 / np.hypot(3, 12)), pytest.approx(12 / np.hypot(3, 12))] and got["h"] == [0.0, 0.0] and set(got) == {"g", "h"}
