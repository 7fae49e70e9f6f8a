import math
from collections import Counter

import pytest

import __spark_entry__
from folioscale.operators.lexical import search
from folioscale.session import local_session


@pytest.fixture(scope="module")
def spark():
    return local_session(2, 2, "1g")


def test_scores_ranks_and_cap(spark):
    texts = {1: ("a", "kinase binding binding"), 2: ("a", "kinase assay"), 3: ("a", "kinase binding"), 4: ("b", "the kinase in cells"), 5: ("b", "buffer"),
             6: (None, "binding"), 7: (None, None)}
    docs = spark.createDataFrame([(i, s, t) for i, (s, t) in texts.items()], "doc_id bigint, source string, text string")
    rows = search(docs, spark.createDataFrame([(9, "Kinase binding")], "query_id bigint, text string"), per_source=2, top=3).collect()

    words = {i: [w for w in (t or "").split() if w not in ("the", "in")] for i, (_, t) in texts.items()}
    mean = sum(map(len, words.values())) / 7
    score = dict.fromkeys(words, 0.0)
    for term in ("kinase", "binding"):
        df = sum(term in w for w in words.values())
        for i, w in words.items():
            tf = Counter(w)[term]
            score[i] += math.log((7 - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / mean))
    order = sorted((i for i in words if score[i]), key=lambda i: (-round(score[i], 6), i))
    kept = []
    for i in order:
        if sum(texts[k][0] == texts[i][0] for k in kept) < 2:
            kept.append(i)
    assert [r.doc_id for r in sorted(rows, key=lambda r: r["rank"])] == kept[:3]
    assert all(r.score == pytest.approx(score[r.doc_id], abs=1e-6) for r in rows)


def test_entry_is_the_search(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"query_id", "rank", "doc_id", "source", "score"}
    assert max(r["rank"] for r in rows) <= 10
    assert max(Counter((r.query_id, r.source) for r in rows).values()) <= 2
