import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from folioscale.functions import services
from folioscale.session import local_session
from folioscale.sources import files


@pytest.fixture(scope="module")
def spark():
    return local_session(2, 2, "1g")


def test_records_round_trip_and_bad_json_is_left_out(spark, tmp_path):
    blocks = spark.createDataFrame([("aa1", 1, "text", "two", 0, 1), ("aa1", 0, "title", "one", 0, 1)], "paper_id string, i bigint, type string, text string, page_idx bigint, level bigint")
    papers = spark.createDataFrame([("aa1", "a.pdf"), ("bb2", "b.pdf")], "paper_id string, file_name string")
    where = str(tmp_path / "records")
    files.write_records(files.build_records(blocks, papers), where)
    (tmp_path / "records" / "part=aa" / "torn.json").write_text('{"paper_id": "cc3", "blo')
    got = files.read_json(spark, where, files.RECORD, lines=True)
    assert {(r.paper_id, r.degraded) for r in got.collect()} == {("aa1", False), ("bb2", True)}
    assert [(r.i, r.text) for r in files.record_blocks(got).orderBy("i").collect()] == [(0, "one"), (1, "two")]
    (tmp_path / "one.json").write_text('{"paper_id": "x",\n "blocks": []}')
    (tmp_path / "two.json").write_text("{not json")
    assert [r.paper_id for r in files.read_records(spark, str(tmp_path / "*.json")).collect()] == ["x"]


def test_selection_listing_and_digests(spark, tmp_path):
    (tmp_path / "list.txt").write_text("a.pdf  # first\n\n# nothing\n  b.pdf\n")
    assert [r.line for r in files.read_selection(spark, str(tmp_path / "list.txt")).collect()] == ["a.pdf", "b.pdf"]
    docs = tmp_path / "docs" / "deep"
    docs.mkdir(parents=True)
    for name in ("a.pdf", "B.PDF", "._a.pdf", "c.txt"):
        (docs / name).write_bytes(b"abc")
    got = files.list_files(spark, str(tmp_path / "docs"))
    assert {r.file_name for r in got.collect()} == {"a.pdf", "B.PDF"} and {r.size for r in got.collect()} == {3}
    row = files.file_digests(spark, str(tmp_path / "docs")).where("path like '%/a.pdf'").first()
    assert row.sha256 == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad" and row.base64 == "YWJj"


def test_the_last_row_of_a_journal_wins(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x", "todo", 1, 0.5, None), ("a", "x", "done", 2, 0.5, None), ("b", "x", "todo", 1, 0.1, None)], files.JOURNAL)
    where = str(tmp_path / "journal")
    files.append_journal(rows, where)
    (tmp_path / "journal" / "z.json").write_text('{"paper_id": "b", "stage": "x", "status": "failed", "seq": 5}\n{"paper_id": "a", "sta')
    old = spark.createDataFrame([("a", "x", "old", 9, 0.0, None), ("c", "x", "old", 9, 0.0, None)], files.JOURNAL)
    got = {r.paper_id: r.status for r in files.journal_state(spark, where, old).collect()}
    assert got == {"a": "done", "b": "failed", "c": "old"}


def test_classified_rows_go_to_their_folders(spark, tmp_path):
    files.write_classified(spark.createDataFrame([("a", "paper"), ("b", "rejected")], "f string, class string"), "class", str(tmp_path / "out"), F.col("f"))
    assert {p.name for p in (tmp_path / "out").iterdir() if p.is_dir()} == {"class=paper", "class=rejected"}


def test_vector_table(spark, tmp_path):
    t = files.VectorTable(spark, str(tmp_path / "vectors"), 2)
    assert t.create() and not t.create() and t.stats().first().points == 0
    rows = spark.createDataFrame([("c1", "p1", "fine", [1.0, 0.0]), ("c2", "p2", "fine", [0.0, 1.0])], t.read().schema)
    assert {r.paper_id for r in t.upsert(rows).collect()} == {"p1", "p2"}
    t.upsert(spark.createDataFrame([("c2", "p2", "table", [1.0, 1.0]), ("c3", "p2", "fine", [0.5, 0.5])], t.read().schema))
    assert {r.chunk_id: r.chunk_type for r in t.read().collect()} == {"c1": "fine", "c2": "table", "c3": "fine"}
    t.update(spark.createDataFrame([("p2",)], "paper_id string"), {"chunk_type": "full"})
    assert {r.chunk_id: r.chunk_type for r in t.read().collect()} == {"c1": "fine", "c2": "full", "c3": "full"}
    assert t.delete_papers(spark.createDataFrame([("p2",)], "paper_id string")) == 2 and t.stats().first().points == 1
    with pytest.raises(PySparkException, match="must have 2 numbers"):
        t.upsert(spark.createDataFrame([("c9", "p", "fine", [1.0])], t.read().schema))
    with pytest.raises(ValueError, match="dimension"):
        files.VectorTable(spark, t.path, 3).read()


def test_services(spark):
    calls = []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise OSError
        return x

    assert services.patiently(flaky, 7, wait=0) == 7 and len(calls) == 3
    with pytest.raises(OSError):
        services.patiently(lambda: (_ for _ in ()).throw(OSError()), tries=2, wait=0)
    rows = spark.createDataFrame([("a", 0, "kinase assay buffer"), ("a", 1, None), ("b", 0, "kinase assay buffer")], "g string, at int, t string")
    got = rows.select("g", "at", services.embedded(F.col("t"), services.HashedWords(8)).alias("v")).collect()
    assert got[0].v == got[2].v and got[1].v is None and sum(x * x for x in got[0].v) == pytest.approx(1, abs=1e-6)
    by = services.embedded_by_group(rows, "g", "at", "t", services.HashedWords(8)).collect()
    assert {(r.g, r["at"]) for r in by} == {("a", 0), ("a", 1), ("b", 0)}
    with pytest.raises(PySparkException):
        rows.select(services.embedded(F.col("t"), lambda texts: services.HashedWords(8)(texts)[:0])).collect()
    answers = spark.createDataFrame([(1, "kinase assay", "c1", "p", "none", 1), (1, "kinase assay", "c2", "p", "kinase assay", 2), (1, "kinase assay", "c3", "p", "assay", 3)], "query_id int, query string, chunk_id string, paper_id string, text string, rank bigint")
    assert [(r.chunk_id, r.rerank_score) for r in services.reranked(answers, top=5, per_paper=2).orderBy("rank").collect()] == [("c2", 1.0), ("c3", 0.5)]
    cache = spark.createDataFrame([("a", "old")], "k string, v string")
    made = services.cached(spark.createDataFrame([("a",), ("b",), ("b",)], "k string"), "k", cache, "v", lambda missing: missing.withColumn("v", F.lit("new")))
    assert sorted(tuple(r) for r in made.collect()) == [("a", "old"), ("b", "new"), ("b", "new")]
    assert spark.range(1).select(services.hypothetical(F.lit("One. Two."))).first()[0] == "Query: One. Two.\nRelevant excerpt: One."
