from itertools import combinations

import pytest
from pyspark.sql import functions as F

from folioscale.llm.names import assign, components, link_names, name_pairs, near, near_tokens, parse_author
from folioscale.session import local_session

PEOPLE = [
    ["Margaret Sigruez", "Margaret  Sigruez", "SIGRUEZ Margaret", "Sigruez, M.", "Peggy Sigruez", "Sigruez M", "Dr. Margaret Sigruez", "Margaret Sigrueez*",
     "Margaret T. Sigruez, PhD", "margaret sigruez"],
    ["Jean-Marc Tiersaisø", "J.-M. Tiersaisø", "Tiersaisø JM", "Jean-Marc Tiersaiso1,2"],
    ["Lars Nobrekoard"], ["Łucja Nobrekoard", "Lucja Nobrekoard"], ["L. Nobrekoard"],  # the initial fits two
    ["Theodora Sigruez", "Dora Sigruez"],
]
JOURNALS = [
    ["Journal of Micellar Proteolysis and Dynamics", "Journal of Micella rProteolysis and Dynamics", "J. Micell. Proteol. Dyn.", "JMPD",
     "Micellar Proteolysis & Dynamics, Journal of", "The Journal of Micellar Proteolysis and Dynamics (Suppl.)", "J Micell Proteol Dyn"],
    ["Journal of Micellar Proteolysis"], ["Annals of Helical Bioassays", "Ann. Helic. Bioass."],
]


@pytest.fixture(scope="module")
def spark():
    return local_session(2, 2, "1g")


def linked(spark, groups, kind, more=()):
    rows = [(n, "x") for g in groups for n in g] + [(n, "x") for n in more]
    members = link_names(spark.createDataFrame(rows + rows[:3], "name string, entity string"), "name", kind).withColumn("kind", F.lit(kind))
    return {(r.name_a, r.name_b) for r in name_pairs(members).collect()}


def wanted(groups):
    return {tuple(sorted(p, key=str.encode)) for g in groups for p in combinations(g, 2)}


def test_people(spark):
    assert linked(spark, PEOPLE, "author", [None, "", "Unknown", "N/A", "et al."]) == wanted(PEOPLE)


def test_journals(spark):
    assert linked(spark, JOURNALS, "journal", [None, " ", "unknown"]) == wanted(JOURNALS)


def test_no_names(spark):
    empty = spark.createDataFrame([], "name string")
    assert link_names(empty, "name", "author").count() == 0 and link_names(empty, "name", "journal").count() == 0


def test_index_agrees_with_brute_force(spark):
    words = ["abcde", "abcd", "abdce", "abxde", "bcdea", "vwxyz", "vwxy", "zwxyv", "aa", "ab", "kinase", "kniase", "kinnase", "kines"]
    got = {tuple(r) for r in near_tokens(spark.createDataFrame([(w,) for w in words], "token string")).collect()}
    assert got == {(a, b) for a in words for b in words if near(a, b) and (a == b or min(len(a), len(b)) >= 4 or max(len(a), len(b)) >= 4 and a == b)}


def test_assignment_is_optimal_and_free_of_order():
    assert assign(["margaret", "t", "sigruez"], ["sigruez", "margaret"]) == 0.25
    assert assign(["m", "sigruez"], ["sigruez", "margaret"]) == 0.4
    assert assign(["m", "sigruez"], ["sigruez", "theodora"]) >= 9
    assert assign(["margaret", "sigruez"], ["margaret", "sigruez", "klein"]) >= 9


def test_components_of_a_long_path(spark):
    n = 70
    nodes = spark.createDataFrame([(f"{i:03}",) for i in range(n + 2)], "node string")
    path = [(f"{i:03}", f"{i + 1:03}") for i in range(n)]
    got = dict(components(nodes, spark.createDataFrame(path + [(b, a) for a, b in path], "a string, b string")).collect())
    assert {got[f"{i:03}"] for i in range(n + 1)} == {"000"} and got[f"{n + 1:03}"] == f"{n + 1:03}"


def test_parts_of_a_name():
    assert parse_author("Prof. Dr. Jean-Marc Laisceikova") == ("laisceikova", "jeanmarc", "j")
    assert parse_author("Stozaseük H") == ("stozaseuk", "", "h")
    assert parse_author("BRANBAIENA Elizabeth") == ("branbaiena", "elizabeth", "e")
    assert parse_author("QUENTIN COUTDEISSEN") == ("coutdeissen", "quentin", "q")
