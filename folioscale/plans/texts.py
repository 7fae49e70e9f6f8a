"""Registered queries over text functions, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscale.functions import text as T
from folioscale.session import table


def _messages(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "messages").where("content is not null").select("id", "content").distinct()


def spelling(spark: SparkSession, root: str) -> DataFrame:
    """Digest of every document with some frequent words taken for misspelt ones."""
    d = table(spark, root, "documents").where("text is not null")
    return d.select("doc_id", F.md5(T.corrected(F.col("text"), {"uptake": "up-take", "binding": "bind", "Moreover": "Further"})).alias("digest"))


def acronyms(spark: SparkSession, root: str) -> DataFrame:
    m = table(spark, root, "sections").where("text is not null").select("paper_id", "id", F.array_join(T.expansions(F.col("text")), "; ").alias("added"))
    return m.where("added <> ''").distinct()


def question_kinds(spark: SparkSession, root: str) -> DataFrame:
    m = _messages(spark, root)
    return m.select("id", T.question_kind(F.col("content")).alias("kind"), T.is_ambiguous(F.col("content")).alias("ambiguous"))


def decomposed(spark: SparkSession, root: str) -> DataFrame:
    m = _messages(spark, root).where("content not like '%\n%'")
    return m.select("id", F.array_join(T.sub_questions(F.col("content")), " / ").alias("parts"))


def cited_claims(spark: SparkSession, root: str) -> DataFrame:
    """Claims of all chunks with the numbers that they cite."""
    c = table(spark, root, "chunks").select("chunk_id", "text").distinct()
    return c.select("chunk_id", F.inline(T.citations(F.col("text")))).select("chunk_id", "source", F.md5("claim").alias("claim"))


def verified(spark: SparkSession, root: str) -> DataFrame:
    """Support of every claim of the messages by the evaluation text of the cited number; numbers without text are warnings."""
    claims = _messages(spark, root).select("id", F.inline(T.citations(F.col("content"))))
    items = table(spark, root, "eval_items").select(F.col("item_id").alias("source"), "text")
    checks = claims.join(items, "source", "left").withColumn("confidence", F.when(F.col("text").isNotNull(), T.support(F.col("claim"), F.col("text"))))
    return checks.groupBy("id").agg(
        F.count("text").alias("checked"), F.count_if(F.col("confidence") >= 0.3).alias("valid"), F.count_if(F.col("text").isNull()).alias("warnings"),
        F.round(F.coalesce(F.avg("confidence"), F.lit(1.0)), 6).alias("confidence"),
    )


def entities(spark: SparkSession, root: str) -> DataFrame:
    s = table(spark, root, "sections").where("text is not null").select("paper_id", "id", "text").distinct()
    return s.select("paper_id", "id", *(F.array_join(T.entities(F.col("text"), c), "|").alias(c) for c in T.ENTITIES))


def entity_relevance(spark: SparkSession, root: str) -> DataFrame:
    """Each evaluation text's entities that the chunks of each type name."""
    items = table(spark, root, "eval_items").select("item_id", T.all_entities(F.col("text")).alias("asked"))
    c = table(spark, root, "chunks").where("text is not null").select("chunk_type", F.explode(T.all_entities(F.col("text"))).alias("e")).distinct()
    found = c.groupBy("chunk_type").agg(F.collect_list("e").alias("found"))
    return items.crossJoin(F.broadcast(found)).select("item_id", "chunk_type", F.round(T.entity_overlap(F.col("asked"), F.col("found")), 6).alias("overlap"))


def dois_and_years(spark: SparkSession, root: str) -> DataFrame:
    p = table(spark, root, "papers").select("paper_id", "doi", "file_name").distinct()
    return p.select("paper_id", "file_name", T.doi(F.concat(F.lit("see https://doi.org/"), "doi", F.lit(", p. 3"))).alias("doi"), T.year(F.col("file_name")).alias("year"))


def structures(spark: SparkSession, root: str) -> DataFrame:
    s = T.structure(F.col("markdown"))
    out = table(spark, root, "extracts").select("paper_id", T.section_hits(F.col("markdown")).alias("sections"), s.alias("s"), F.round(T.content_score(F.col("markdown")), 6).alias("score"))
    return out.select("paper_id", "sections", "s.paragraphs", "s.citations", "s.figures", "s.equations", F.round("s.mean_length", 6).alias("mean_length"), "score")


def prose(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "chunks").where("text is not null").select("chunk_id", T.is_prose(F.col("text")).alias("prose")).distinct()


def votes(spark: SparkSession, root: str) -> DataFrame:
    """Class of every source by the confidence of its documents: length and language stand in for filters."""
    d = table(spark, root, "documents").where("source is not null").withColumn("w", F.least(F.col("n_chars") / 2000.0, F.lit(1.0)))
    by = d.groupBy("source").agg(
        F.sum(F.when(F.col("lang") == "en", F.col("w")).otherwise(0.0)).alias("p"), F.sum(F.when(F.col("lang").isNull(), F.col("w")).otherwise(0.0)).alias("r"), F.sum("w").alias("t"),
    )
    return by.select("source", T.vote(F.col("p"), F.col("r"), F.col("t")).alias("class"))


def same_width(spark: SparkSession, root: str) -> DataFrame:
    r = table(spark, root, "resolved").select("token_no", T.same_width(F.col("token")).alias("t"), "token")
    return r.select("token_no", F.hex(F.encode("t", "UTF-8")).alias("token"), (F.length("t") == F.length("token")).alias("same_length"))


def embed_texts(spark: SparkSession, root: str) -> DataFrame:
    c = table(spark, root, "chunks").select("chunk_id", F.md5(T.embed_text(F.col("context_line"), F.col("embed_body"), F.col("text"))).alias("digest"))
    return c.distinct()


def keys(spark: SparkSession, root: str) -> DataFrame:
    p = table(spark, root, "papers").select("paper_id", "title", "authors", "project_tag").distinct()
    key = T.cache_key(F.col("title"), [F.array("paper_id", F.coalesce("project_tag", F.lit("-")))], F.lit(10))
    return p.select("paper_id", key.alias("search_key"), T.pair_key(F.coalesce("title", F.lit("")), F.col("paper_id")).alias("pair_key")).distinct()


def term_groups(spark: SparkSession, root: str) -> DataFrame:
    groups = [["kinase", "binding"], ["uptake"], ["Figure", "Fig."], ["not there at all"]]
    d = table(spark, root, "documents")
    return d.select("doc_id", F.array_join(T.groups_present(F.col("text"), groups), ",").alias("present"))


def judgments(spark: SparkSession, root: str) -> DataFrame:
    """Grades read from answers made of the events' JSON: k modulo 4 as the grade, 3 being none."""
    e = table(spark, root, "events").select("event_id", F.concat(F.lit("Grade: {\"grade\": "), (F.get_json_object("props", "$.k").cast("int") % 4).cast("string"), F.lit("} ok")).alias("raw"))
    return e.select("event_id", T.judgment(F.col("raw")).alias("grade"))


def sentence_counts(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).cast("bigint").alias("n"))


def queries() -> dict:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    acronym = ", ".join(f"CASE WHEN regexp_matches(text, {q('(?i)' + chr(92) + 'b' + T._escaped(a) + chr(92) + 'b')}) AND NOT contains(lower(text), {q(e.lower())}) THEN {q(e)} END" for a, e in T.ACRONYMS.items())
    kinds = " ".join(f"WHEN {' OR '.join(f'contains(lower(content), {q(w)})' for w in ws)} THEN '{k}'" for k, ws in T.SIGNALS.items())
    stop = "[" + ", ".join(map(q, T.CLAIM_STOP)) + "]"
    no_entity = "[" + ", ".join(map(q, T.NO_ENTITY)) + "]"
    found = lambda c: "list_sort(list_distinct(list_filter(list_transform(flatten([" + ", ".join(f"regexp_extract_all(text, {q(T.bounded(p))}, 1)" for p in T.ENTITIES[c]) + f"]), lambda e: lower(e)), lambda e: length(e) > 2 AND NOT list_contains({no_entity}, e))))"
    every = "list_sort(list_distinct(flatten([" + ", ".join(found(c) for c in T.ENTITIES) + "])))"
    sent = "list_filter(string_split(regexp_replace(coalesce({0}, ''), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"
    claims = lambda src, key, text: f"""s AS (SELECT {key}, unnest({sent.format(text)}) AS s FROM {src}),
m AS (SELECT {key}, trim(regexp_replace(s, '{T.CITATION}', '', 'g')) AS claim, unnest(regexp_extract_all(s, '{T.CITATION}')) AS mark FROM s),
claims AS (SELECT DISTINCT {key}, unnest(regexp_extract_all(mark, '\\d+'))::BIGINT AS source, claim FROM m WHERE claim <> '')"""  # noqa: E731
    both = lambda p, k: f"trim(regexp_extract(content, '(?i){p}', {k}))"
    parts = []
    for p, kind in [
        (r"compare\s+(.+?)\s+(?:and|vs\.?|versus)\s+(.+)", "c"), (r"difference\s+between\s+(.+?)\s+and\s+(.+)", "c"), (r"(.+?)\s+(?:vs\.?|versus)\s+(.+)", "c"),
        (r"(.+?)\s+and\s+(?:also|additionally)\s+(.+)", "p"), (r"(.+?)\.?\s+(?:also|additionally|furthermore),?\s+(.+)", "p"), (r"how\s+does\s+(.+?)\s+affect\s+(.+)", "e"),
        (r"what\s+is\s+the\s+effect\s+of\s+(.+?)\s+on\s+(.+)", "e"), (r"relationship\s+between\s+(.+?)\s+and\s+(.+)", "e"),
    ]:
        a, b = both(p, 1), both(p, 2)
        made = {"c": f"'What is ' || {a} || '? / What is ' || {b} || '? / ' || content", "p": f"{a} || '? / ' || {b} || '?'", "e": f"'What is ' || {a} || '? / How does ' || {a} || ' affect ' || {b} || '?'"}[kind]
        parts.append(f"WHEN regexp_matches(content, '(?i){p}') THEN {made}")
    sections = " + ".join(f"regexp_matches(lower(markdown), {q(p)})::BIGINT" for p in T.PAPER_SECTIONS)
    m = "(SELECT DISTINCT id, content FROM messages WHERE content IS NOT NULL)"
    wide = f"translate(token, '{T.SPACES + T.DASHES}', '{' ' * len(T.SPACES) + '-' * len(T.DASHES)}')"
    return {
        "c10_37_spelling": (spelling, r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '(?i)\buptake\b', 'up-take', 'g'), '(?i)\bbinding\b', 'bind', 'g'), '(?i)\bMoreover\b', 'Further', 'g')) AS digest FROM documents WHERE text IS NOT NULL"),
        "c10_38_acronyms": (acronyms, f"SELECT DISTINCT * FROM (SELECT paper_id, id, array_to_string(list_filter([{acronym}], lambda x: x IS NOT NULL), '; ') AS added FROM sections WHERE text IS NOT NULL) WHERE added <> ''"),
        "c10_45_question_kinds": (question_kinds, rf"""SELECT id, CASE {kinds} ELSE 'general' END AS kind, n <= 3 OR regexp_matches(' ' || lower(content) || ' ', ' (it|this|that|they|these|those) ')
  OR (regexp_matches(lower(content), '^(what is|how does|why is|tell me about|explain|describe)') AND n <= 5) AS ambiguous FROM (SELECT *, len(list_filter(regexp_split_to_array(trim(content), '\s+'), lambda w: w <> '')) AS n FROM {m})"""),
        "c10_39_decomposed": (decomposed, f"SELECT id, CASE {' '.join(parts)} ELSE '' END AS parts FROM {m} WHERE NOT contains(content, chr(10))"),
        "c10_56_cited_claims": (cited_claims, f"WITH {claims('(SELECT DISTINCT chunk_id, text FROM chunks)', 'chunk_id', 'text')} SELECT chunk_id, source, md5(claim) AS claim FROM claims"),
        "c5_22_verified": (verified, f"""WITH {claims(m, 'id', 'content')},
w AS (SELECT id, source, claim, text, list_distinct(list_filter(regexp_split_to_array(lower(claim), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 2 AND NOT list_contains({stop}, w))) AS ws FROM claims LEFT JOIN eval_items ON item_id = source),
c AS (SELECT id, text, CASE WHEN text IS NULL THEN NULL WHEN len(ws) = 0 THEN 0 ELSE len(list_filter(ws, lambda x: contains(lower(text), x))) / len(ws)::DOUBLE END AS confidence FROM w)
SELECT id, count(text)::BIGINT AS checked, count(*) FILTER (confidence >= 0.3)::BIGINT AS valid, count(*) FILTER (text IS NULL)::BIGINT AS warnings, round(coalesce(avg(confidence), 1.0), 6) AS confidence FROM c GROUP BY id"""),
        "c10_53_entities": (entities, f"SELECT DISTINCT paper_id, id, {', '.join(f'array_to_string({found(c)}, chr(124)) AS {c}' for c in T.ENTITIES)} FROM sections WHERE text IS NOT NULL"),
        "c8_2_entity_relevance": (entity_relevance, f"""WITH a AS (SELECT item_id, {every} AS asked FROM eval_items), f AS (SELECT chunk_type, list(DISTINCT e) AS found FROM (SELECT chunk_type, unnest({every}) AS e FROM chunks WHERE text IS NOT NULL) GROUP BY chunk_type)
SELECT item_id, chunk_type, round(CASE WHEN len(asked) = 0 THEN 1.0 ELSE len(list_intersect(asked, found)) / len(asked)::DOUBLE END, 6) AS overlap FROM a, f"""),
        "c10_34_dois_and_years": (dois_and_years, r"SELECT DISTINCT paper_id, file_name, regexp_replace(nullif(regexp_extract('see https://doi.org/' || doi || ', p. 3', 'doi\.org/(10\.\d{4,}/[^\s\"'')]+)', 1), ''), '[.,;:)\"''\s]+$', '') AS doi, nullif(regexp_extract(file_name, '(?:19|20)\d{2}'), '')::INT AS year FROM papers"),
        "c10_75_structures": (structures, rf"""WITH x AS (SELECT paper_id, markdown, list_filter(list_transform(string_split(markdown, chr(10) || chr(10)), lambda p: trim(p, ' ')), lambda p: length(p) > 50) AS ps FROM extracts),
y AS (SELECT paper_id, {sections} AS sections, len(ps) AS paragraphs, len(regexp_extract_all(markdown, '\[\d+\]')) AS citations, len(regexp_extract_all(markdown, '(?i)(?:Figure|Fig\.?|Table)\s*\d+')) AS figures,
  regexp_matches(markdown, '[=∑∫∂]|\\frac|\\sum') AS equations, coalesce(list_sum(list_transform(ps, lambda p: length(p))), 0) / greatest(len(ps), 1)::DOUBLE AS mean_length FROM x)
SELECT paper_id, sections, paragraphs, citations, figures, equations, round(mean_length, 6) AS mean_length, round(least(sections / 8.0::DOUBLE, 0.4::DOUBLE) + CASE WHEN citations > 5 THEN 0.2 WHEN citations > 0 THEN 0.1 ELSE 0 END::DOUBLE
  + CASE WHEN figures > 2 THEN 0.15 WHEN figures > 0 THEN 0.08 ELSE 0 END::DOUBLE + CASE WHEN paragraphs > 10 AND mean_length > 200 THEN 0.15 WHEN paragraphs > 5 THEN 0.08 ELSE 0 END::DOUBLE + CASE WHEN equations THEN 0.1 ELSE 0 END::DOUBLE, 6) AS score FROM y"""),
        "c3_13_prose": (prose, r"SELECT DISTINCT chunk_id, length(text) >= 150 AND length(regexp_replace(text, '[^\p{L}]', '', 'g')) >= length(text) * 0.55 AND len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) >= 30 AND length(text) - length(replace(text, '.', '')) >= 2 AS prose FROM chunks WHERE text IS NOT NULL"),
        "c5_28_votes": (votes, """SELECT source, CASE WHEN coalesce(p / nullif(t, 0), 0) > 0.6 THEN 'paper' WHEN coalesce(r / nullif(t, 0), 0) > 0.6 THEN 'rejected' ELSE 'uncertain' END AS class FROM (
  SELECT source, coalesce(sum(w) FILTER (lang = 'en'), 0) AS p, coalesce(sum(w) FILTER (lang IS NULL), 0) AS r, sum(w) AS t FROM (SELECT *, least(n_chars / 2000.0::DOUBLE, 1.0::DOUBLE) AS w FROM documents WHERE source IS NOT NULL) GROUP BY source)"""),
        "c10_10_same_width": (same_width, f"SELECT token_no, hex(encode({wide})) AS token, length({wide}) = length(token) AS same_length FROM resolved"),
        "c2_30_embed_texts": (embed_texts, "SELECT DISTINCT chunk_id, md5(concat_ws(chr(10), nullif(context_line, ''), nullif(coalesce(embed_body, text), ''))) AS digest FROM chunks"),
        "c10_70_keys": (keys, "SELECT DISTINCT paper_id, md5(coalesce(title, '') || '|' || array_to_string(list_sort([paper_id, coalesce(project_tag, '-')]), ',') || '|10') AS search_key, sha256(encode(coalesce(title, '')) || '\\x00'::BLOB || encode(paper_id)) AS pair_key FROM papers"),
        "c10_65_term_groups": (term_groups, "SELECT doc_id, array_to_string(list_filter([CASE WHEN contains(lower(coalesce(text, '')), 'kinase') OR contains(lower(coalesce(text, '')), 'binding') THEN '0' END, CASE WHEN contains(lower(coalesce(text, '')), 'uptake') THEN '1' END, CASE WHEN contains(lower(coalesce(text, '')), 'fig') AND (contains(lower(text), 'figure') OR contains(lower(text), 'fig.')) THEN '2' END], lambda x: x IS NOT NULL), ',') AS present FROM documents"),
        "c10_66_judgments": (judgments, "SELECT event_id, CASE WHEN json_extract(props, '$.k')::INT % 4 < 3 THEN json_extract(props, '$.k')::INT % 4 ELSE 0 END AS grade FROM events"),
        "c10_26_sentence_counts": (sentence_counts, f"SELECT doc_id, len({sent.format('text')})::BIGINT AS n FROM documents"),
    }
