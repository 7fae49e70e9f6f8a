import random
from collections import OrderedDict

import pandas as pd
import pytest

from folioscale.session import local_session
from folioscale.streaming import operators as S


@pytest.fixture(scope="module")
def spark():
    return local_session(2, 2, "1g")


@pytest.fixture(scope="module")
def requests(spark, tmp_path_factory):
    """Requests in three files, so state has to last over three batches; times rise from file to file, not within."""
    folder = tmp_path_factory.mktemp("stream")
    rng = random.Random(4)
    rows = [(i, f"k{rng.randint(0, 2)}", f"item{rng.randint(0, 9)}", i * 7.0 + rng.random()) for i in range(240)]
    for n in range(3):
        part = rows[n * 80 : (n + 1) * 80]
        rng.shuffle(part)
        pd.DataFrame(part, columns=["id", "client", "item", "at"]).to_parquet(folder / f"part-{n}.parquet")
        import os

        os.utime(folder / f"part-{n}.parquet", (n + 1, n + 1))
    stream = lambda: spark.readStream.schema("id bigint, client string, item string, at double").option("maxFilesPerTrigger", 1).parquet(str(folder))
    return stream, sorted(rows, key=lambda r: r[3])


def test_rate_limit_against_a_loop(requests):
    stream, rows = requests
    got = {r.id: r.allowed for r in S.run_available(S.rate_limited(stream(), "client", "at", "id", 2, 60.0)).collect()}
    passed: dict[str, list[float]] = {}
    for i, client, _, at in rows:
        near = [t for t in passed.get(client, []) if at - t < 60.0]
        ok = len(near) < 2
        passed[client] = near + [at] * ok
        assert got[i] == ok
    assert len(got) == 240 and 0 < sum(got.values()) < 240


def test_cache_against_a_loop(requests):
    stream, rows = requests
    got = {r.id: r.hit for r in S.run_available(S.cache_hits(stream(), "client", "at", "id", "item", 4, 300.0)).collect()}
    caches: dict[str, OrderedDict] = {}
    for i, client, item, at in rows:
        cache = caches.setdefault(client, OrderedDict())
        hit = item in cache and at - cache[item] < 300.0
        if not hit:
            cache[item] = at
        cache.move_to_end(item)
        if len(cache) > 4:
            cache.popitem(last=False)
        assert got[i] == hit
    assert 0 < sum(got.values()) < 240


def test_means_of_the_last_values(requests):
    stream, rows = requests
    got = {r.id: r.mean for r in S.run_available(S.last_n_means(stream(), "client", "at", "id", "at", 5)).collect()}
    last: dict[str, list[float]] = {}
    for i, client, _, at in rows:
        last[client] = [*last.get(client, []), at][-5:]
        assert got[i] == pytest.approx(sum(last[client]) / len(last[client]))


def test_sentences_come_out_once_and_whole(spark, tmp_path):
    parts = [("a", 0, "One is he", False), ("a", 1, "re. Two", False), ("a", 2, " is 3.5 long! one is here. Tail", True), ("b", 0, None, False), ("b", 1, "Open", True)]
    for n, p in enumerate(parts):
        pd.DataFrame([p], columns=["answer", "n", "text", "closing"]).astype({"text": "string"}).to_parquet(tmp_path / f"{n}.parquet")
        import os

        os.utime(tmp_path / f"{n}.parquet", (n + 1, n + 1))
    stream = spark.readStream.schema("answer string, n bigint, text string, closing boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    got = S.run_available(S.complete_sentences(stream, "answer", "n", "text", "closing")).collect()
    assert sorted((r.answer, r.sentence) for r in got) == [("a", "One is here."), ("a", "Tail"), ("a", "Two is 3.5 long!"), ("b", "Open")]
