import pytest

from folioscale.llm import repetition
from folioscale.llm.repetition import Condition, exact_share, measure_repetition
from folioscale.session import local_session

COPIES = (
    "For Trogruexin D, an IC50 of 56.1 nM and a yield of 93% were obtained. For Stoleiexin α, an IC50 of 1.70 µM and a yield of 31% were "
    "obtained.\n\nFor Mokoustatin α, an IC50 of 2.05 µg/mL and a yield of 88% were obtained."
)


@pytest.fixture(scope="module")
def spark():
    return local_session(2, 2, "1g")


@pytest.fixture(scope="module")
def documents(spark):
    plain = [(i, " ".join(f"w{chr(97 + i % 26)}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(40))) for i in range(60)]
    whole = [(100 + i, " ".join([t] * 3)) for i, t in plain[:30]]
    return spark.createDataFrame([*plain, *whole, (999, COPIES), (1000, None)], "doc_id bigint, text string")


def test_every_share_is_the_exact_one(documents):
    rows = {r.doc_id: r for r in measure_repetition(documents, sample=40).collect()}
    assert len(rows) == 92 and rows[1000].repeated == 0
    assert rows[999].repeated == pytest.approx(22 / 45)


@pytest.mark.parametrize("rules", [[], [(Condition("share_8", True, 0.5),)]])
def test_no_rule_can_drop_a_document(documents, monkeypatch, rules):
    monkeypatch.setattr(repetition, "fit", lambda *a: rules)
    found = {r.doc_id for r in measure_repetition(documents, found_only=True).collect()}
    assert found == {999, *range(100, 130)}
    assert measure_repetition(documents).count() == 92


def test_a_copy_of_neither_the_first_nor_the_nearest_occurrence():
    phrase = [1, 2, 3, 4, 5]
    words = [*phrase, 11, 12, 13, 90, *phrase, 21, 22, 23, 91, *phrase, 31, 32, 33, 92, *phrase, 21, 22, 23]
    assert exact_share(words) == 8 / 35


def test_the_list_on_held_out_documents():
    import random

    from folioscale.llm.repetition import _holds, learn_list, statistics
    import numpy as np
    import pyarrow as pa
    from folioscale.llm.words import Words

    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    texts = []
    for i in range(600):
        base = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        more = [w if rng.random() > 0.05 else rng.choice(words) for w in base[: rng.randint(10, len(base)) if len(base) > 10 else 0]]
        texts.append(" ".join(base + more * rng.choice((0, 0, 0, 1, 2))))
    x = statistics(pa.array(texts))
    w = Words(pa.array(texts), repetition.numberless)
    y = np.array([exact_share(w.of(i).tolist()) >= 0.3 for i in range(600)])
    rules = learn_list({f: v[:300] for f, v in x.items()}, y[:300])
    named = np.zeros(300, dtype=bool)
    for rule in rules:
        named |= _holds(rule, {f: v[300:] for f, v in x.items()}, 300)
    recall, precision = (named & y[300:]).sum() / y[300:].sum(), (named & y[300:]).sum() / named.sum()
    print(f"held out: recall {recall:.3f}, precision {precision:.3f}, {len(rules)} rules")
    assert recall >= 0.9 and precision >= 0.9
    # the floor loses none
    assert (x["share_5"][y] >= 0.3 * 5 / 7 - 1e-9).all()


def test_no_documents(documents):
    assert measure_repetition(documents.limit(0)).count() == 0


def test_all_sources_against_all_distances():
    import random

    import numpy as np

    def brute(words, seed=5, least=8, changed=2):
        ids, covered = np.array(words), np.zeros(len(words), dtype=bool)
        for d in range(1, len(words)):
            same = ids[d:] == ids[:-d]
            starts = [i + d for i in range(len(same) - seed + 1) if same[i : i + seed].all()]
            chains = []
            for i in starts:
                if chains and i <= chains[-1][1] + changed:
                    chains[-1][1] = i + seed
                else:
                    chains.append([i, i + seed])
            for a, b in chains:
                if b - a >= least:
                    covered[a:b] = True
        return covered.mean() if len(words) >= least else 0.0

    rng = random.Random(2)
    for trial in range(150):
        phrases = [[rng.randint(0, 30) for _ in range(rng.randint(5, 11))] for _ in range(4)]
        words = []
        while len(words) < 120:
            p = list(rng.choice(phrases))
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = rng.randint(100, 130)
            words += p + [rng.randint(200, 400) for _ in range(rng.choice((0, 0, 1, 2, 5)))]
        assert exact_share(words) == pytest.approx(brute(words)), trial


def test_a_very_long_text_of_one_short_phrase_ends():
    import time

    phrase, words = [1, 2, 3, 4, 5], []
    for k in range(40_000):
        words += [*phrase, 1000 + 3 * k, 1001 + 3 * k, 1002 + 3 * k]
    begin = time.time()
    assert exact_share(words) == 0.0
    assert time.time() - begin < 30
