from folioscale.llm.pairs import pairs_within
from folioscale.session import local_session


def test_hot_groups_lose_no_pair():
    spark = local_session(2, 2, "1g")
    rows = [("hot", f"k{i:03}") for i in range(120)] + [("two", "a"), ("two", "b"), ("one", "x")]
    members = spark.createDataFrame(rows, "g string, k string")
    for block in (1000, 7):
        got = [tuple(r) for r in pairs_within(members, ["g"], "k", block).collect()]
        want = {(g, a, b) for g, a in rows for h, b in rows if g == h and a < b}
        assert len(got) == len(want) and set(got) == want
    assert pairs_within(members.limit(0), ["g"], "k").count() == 0
