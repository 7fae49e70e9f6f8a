"""Problem 4: spellings that people typed of one person or one journal are linked.

Tokens (family names, given names, and journal titles closed up to one token) go into a symmetric-delete index: each
token is filed under itself and under itself less any one letter, and two tokens that meet there are at most one
insertion, deletion, replacement or exchange apart. Only names that meet on the index in all the tokens they must share
become candidates; each candidate pair is then decided by an optimal assignment of tokens to tokens that permits
initials, abbreviations, short forms of given names, and left-over middle initials in any order. Accepted pairs are
joined to entities by connected components; a name that has initials only, an abbreviated title or an acronym belongs
to the one entity that it fits, and to none if it fits several.

All work is on distinct strings. Buckets of the index hold spellings one letter apart, so their size does not grow with
the number of rows. The result is one row per string with its entity; pairs are made from it only where they are asked.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscale.llm.pairs import pairs_within
from folioscale.session import ensure_checkpoint_dir, table

#: Names that name nobody, folded. Fixed values.
PLACEHOLDERS = frozenset(
    "unknown|n/a|na|none|null|et al|et al.|anonymous|anon|anon.|author|authors|no author|various|various authors|tba|tbd|unnamed|"
    "nn|n.n.|not available|not given|missing|nil|-|--|?|journal|unknown author|unknown journal|no journal|untitled|test|others".split("|")
)
#: Given names and their usual short forms, folded. Fixed values.
SHORT = {
    "alexander": "alex sasha sandy al lex xander", "alexandra": "alex sasha sandra lexi", "andrew": "andy drew", "anthony": "tony",
    "benjamin": "ben benny benji", "catherine": "cathy kate cat", "charles": "charlie chuck", "christopher": "chris kit topher",
    "daniel": "dan danny", "daniela": "dani", "david": "dave davy", "dmitri": "dima mitya", "dorothy": "dot dolly", "edward": "ed eddie ned ted teddy",
    "elizabeth": "liz beth betty lisa eliza lizzie", "francisco": "paco pancho cisco", "frederick": "fred freddy", "gabriela": "gabi gaby",
    "gregory": "greg", "henry": "harry hank", "ivan": "vanya", "james": "jim jimmy jamie", "jennifer": "jen jenny", "johannes": "hans jo",
    "john": "jack johnny", "jonathan": "jon", "jose": "pepe", "joseph": "joe joey", "josephine": "josie jo", "katherine": "kate kathy katie kat",
    "kenneth": "ken", "lawrence": "larry", "leonard": "len leo", "margaret": "maggie meg peggy", "matthew": "matt", "michael": "mike mick mickey misha",
    "nicholas": "nick", "nikolai": "kolya nick", "patricia": "pat patty trish", "patrick": "pat paddy", "peter": "pete", "philip": "phil",
    "rebecca": "becky", "richard": "rick dick rich ricky", "robert": "rob bob bobby robbie bert", "ronald": "ron", "samuel": "sam",
    "sergei": "seryozha", "stephen": "steve", "susanna": "sue susie suzy", "theodora": "dora thea theo", "theodore": "ted theo", "thomas": "tom tommy",
    "timothy": "tim", "vladimir": "vova volodya", "william": "will bill billy willy liam",
}
#: Letters that do not decompose, and the base letters they stand for. Fixed values.
PLAIN = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ħ": "h", "ı": "i", "æ": "ae", "œ": "oe", "ß": "ss", "þ": "th", "ð": "d", "’": "'", "ʼ": "'"})
_TITLE = re.compile(r"^(?:(?:prof|professor|dr|mr|mrs|ms|sir|pd|priv|doz|ing|dipl)\.?\s+|(?:prof|dr|mr|mrs|ms)\.)+", re.I)
_DEGREE = re.compile(r"(?:,|\s)+\s*(?:ph\.?\s*d|m\.?\s*d|d\.?sc|m\.?sc|b\.?sc|dphil|mba|frs|jr|sr|ii|iii)\.?$", re.I)
_MARKS = re.compile(r"[\d*†‡§¶#¹²³⁰-⁹]+(?:\s*,\s*[\d*†‡§¶#]+)*")
_INITIALS = re.compile(r"^(?:[^\W\d_]\.?[-‐]?){1,3}$")
_SMALL = frozenset("of in on and the for und et de la der die".split())


def fold(text: str) -> str:
    """Lower case, compatibility forms resolved, without accents, single blanks."""
    wide = unicodedata.normalize("NFKD", text).casefold().translate(PLAIN)
    return " ".join("".join(c for c in wide if not unicodedata.combining(c)).split())


def _letters(text: str) -> str:
    return "".join(c for c in fold(text) if c.isalnum())


_FORMAL: dict[str, list[str]] = {}
for _name, _shorts in SHORT.items():
    for _short in _shorts.split():
        _FORMAL.setdefault(_short, []).append(_name)


def formal(given: str) -> list[str]:
    """The folded given name, and those that it is a short form of."""
    return [given, *_FORMAL.get(given, [])]


def _is_initials(token: str) -> bool:
    bare = token.replace(".", "").replace("-", "").replace("‐", "")
    return bool(_INITIALS.match(token)) and (len(bare) == 1 or "." in token or bare.isupper())


def parse_author(name: str) -> tuple[str, str, str] | None:
    """(family name, given name or '', initials of the given names or ''), folded; None if it names nobody.

    The family name stands before a comma, in capitals before a name that is not, before initials, or else last.
    """
    text = " ".join(unicodedata.normalize("NFKC", name).split())
    if fold(text) in PLACEHOLDERS or not any(c.isalpha() for c in text):
        return None
    text = _MARKS.sub(" ", text)
    text = _TITLE.sub("", " ".join(text.split()).strip(" ,;"))
    text = _DEGREE.sub("", text).strip(" ,;")
    if "," in text:
        family, _, rest = text.partition(",")
        parts = rest.split()
    else:
        words = text.split()
        if len(words) < 2:
            return (_letters(text), "", "") if _letters(text) else None
        lead = len(words[0]) > 1 and words[0].isupper() and not _is_initials(words[0])
        if lead and any(not w.isupper() and len(w) > 1 for w in words[1:]) and not all(_is_initials(w) for w in words[1:]):
            family, parts = words[0], words[1:]
        elif _is_initials(words[-1]) and not _is_initials(words[0]):
            k = len(words)
            while k > 1 and _is_initials(words[k - 1]):
                k -= 1
            family, parts = " ".join(words[:k]), words[k:]
        else:
            family, parts = words[-1], words[:-1]
    family = _letters(family)
    full = [p for p in parts if not _is_initials(p) and _letters(p)]
    if not family:
        return None
    if full:
        return family, _letters(full[0]), _letters(full[0])[:1]
    first = next((p for p in parts if _letters(p)), "")
    return family, "", _letters(first)


def parse_journal(name: str) -> tuple[str, list[str], str] | None:
    """(title closed up to one token, content words in order, kind: full, short or acronym); None for placeholders."""
    text = " ".join(unicodedata.normalize("NFKC", name).split())
    if fold(text) in PLACEHOLDERS or not any(c.isalpha() for c in text):
        return None
    text = re.sub(r"\s*[(\[][^)\]]*[)\]]\s*$", "", text).strip(" ,;:") or text
    head, comma, tail = text.rpartition(",")
    if comma and re.search(r"\b(?:of|in|on|for)$", tail.strip(), re.I):
        text = f"{tail.strip()} {head.strip()}"
    if " " not in text and text.isupper() and 2 <= len(text) <= 9:
        return text.lower(), [text.lower()], "acronym"
    words = fold(text.replace("&", " and ")).split()
    if len(words) > 1 and words[0] == "the":
        words = words[1:]
    content = [re.sub(r"[\W_]+", "", w) for w in words if w not in _SMALL]
    content = [w for w in content if w]
    if not content:
        return None
    short = any(w.endswith(".") for w in words) or not any(w in _SMALL for w in words)
    return re.sub(r"[\W_]+", "", "".join(words)), content, "short" if short and len(content) > 1 else "full"


@lru_cache(maxsize=1 << 16)
def near(a: str, b: str) -> bool:
    """Whether one insertion, deletion, replacement or exchange of neighbours at most parts two tokens."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        odd = [i for i in range(len(a)) if a[i] != b[i]]
        return len(odd) == 1 or (len(odd) == 2 and odd[1] == odd[0] + 1 and a[odd[0]] == b[odd[1]] and a[odd[1]] == b[odd[0]])
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k:] == b[k + 1 :]


def token_cost(a: str, b: str) -> float:
    """Cost of taking one token for the other; above 1 if they cannot be."""
    if a == b:
        return 0.0
    if len(a) == 1 or len(b) == 1:
        return 0.4 if a[0] == b[0] else 9.0
    if set(formal(a)) & set(formal(b)):
        return 0.2
    if min(len(a), len(b)) >= 3 and any(near(x, y) for x in formal(a) for y in formal(b)):
        return 0.5
    short, long = sorted((a, b), key=len)
    return 0.3 if len(short) >= 3 and long.startswith(short) else 9.0


def assign(a: list[str], b: list[str], left_over: float = 0.25) -> float:
    """Least cost of an assignment of the tokens of the shorter list to those of the longer; 9 or more if none is possible.

    A token left over costs ``left_over`` if it is an initial and 9 otherwise. Solved exactly over subsets.
    """
    if len(a) > len(b):
        a, b = b, a
    best = {0: 0.0}
    for token in a:
        ahead: dict[int, float] = {}
        for taken, cost in best.items():
            for j, other in enumerate(b):
                if not taken >> j & 1:
                    c = cost + token_cost(token, other)
                    if c < ahead.get(taken | 1 << j, 99.0):
                        ahead[taken | 1 << j] = c
        best = ahead
    rest = [left_over if len(t) == 1 else 9.0 for t in b]
    return min((cost + sum(r for j, r in enumerate(rest) if not taken >> j & 1) for taken, cost in best.items()), default=99.0)


def deletes(token: Column, least: int = 4) -> Column:
    """The token and, from ``least`` letters on, each of its forms with one letter less, once each."""
    less = F.transform(F.sequence(F.lit(1), F.length(token)), lambda k: F.concat(F.substring(token, F.lit(1), k - 1), F.substring(token, k + 1, F.length(token))))
    return F.when(F.length(token) < least, F.array(token)).otherwise(F.array_distinct(F.concat(F.array(token), less)))


def near_tokens(tokens: DataFrame, least: int = 4) -> DataFrame:
    """Pairs (a, b) of tokens at most one edit apart, both ways and with themselves. tokens: token, distinct, not null."""
    filed = tokens.select("token", F.explode(deletes(F.col("token"), least)).alias("key"))
    met = filed.withColumnRenamed("token", "a").join(filed.withColumnRenamed("token", "b"), "key").select("a", "b").distinct()
    swapped = F.exists(
        F.sequence(F.lit(1), F.length("a") - 1),
        lambda k: F.concat(F.substring("a", F.lit(1), k - 1), F.substring("a", k + 1, F.lit(1)), F.substring("a", k, F.lit(1)), F.substring("a", k + 2, F.length("a"))) == F.col("b"),
    )
    return met.where((F.levenshtein("a", "b") <= 1) | ((F.length("a") == F.length("b")) & (F.length("a") > 1) & swapped))


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root): the least node of each connected component. nodes: node; edges: a, b, in both directions.

    Least labels spread along edges and are then looked up in their own label, so paths halve each round; every round is
    checkpointed.
    """
    labels = nodes.select("node", F.col("node").alias("root")).checkpoint()
    edges = edges.where("a <> b").select("a", "b").distinct().checkpoint()
    for _ in range(rounds):
        spread = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("seen"))
        one = labels.join(spread, labels["node"] == spread["a"], "left").select("node", "root", F.least("root", F.coalesce("seen", "root")).alias("next"))
        jump = one.select(F.col("node").alias("via"), F.col("next").alias("beyond"))
        two = one.join(jump, one["next"] == jump["via"], "left").select("node", "root", F.least("next", F.coalesce("beyond", "next")).alias("next"))
        two = two.checkpoint()
        changed = two.where("next <> root").limit(1).count()
        labels = two.select("node", F.col("next").alias("root"))
        if not changed:
            return labels
    raise RuntimeError(f"components have not settled after {rounds} rounds")


def _accepted(pairs: DataFrame, most: float) -> DataFrame:
    """Rows of ``pairs`` whose token lists ``ta`` and ``tb`` have an assignment of at most ``most``."""

    @F.pandas_udf("boolean")
    def fits(ta, tb):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([assign(list(a), list(b)) <= most for a, b in zip(ta, tb)], dtype=bool)

    return pairs.where(fits("ta", "tb"))


def _parsed(names: DataFrame, schema: str, parse) -> DataFrame:  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:

        for batch in batches:
            rows = [(n, *p) for n in batch.column(0).to_pylist() if (p := parse(n)) is not None]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], names=fields)

    fields = [f.split()[0] for f in schema.split(", ")]
    return names.mapInArrow(run, schema)


def _node(kind: str, *parts: str) -> Column:
    return F.concat_ws("|", F.lit(kind), *parts)


def _author_pairs(parsed: DataFrame, family: DataFrame, shorts: DataFrame, most: float) -> tuple[DataFrame, DataFrame]:
    """Nodes (one for each family and given name) and the pairs of them that the assignment accepts."""
    full = parsed.where("given <> ''").select("family", "given").distinct()
    forms = full.join(shorts, full["given"] == shorts["short"], "left").select("family", "given", F.explode(F.array_compact(F.array("given", "long"))).alias("form")).distinct()
    filed = forms.select("family", "given", F.explode(deletes(F.col("form"), 3)).alias("key")).distinct()
    reach = filed.join(family, filed["family"] == family["a"]).select("family", "given", "key", F.col("b").alias("other"))
    back = filed.select(F.col("family").alias("other"), "key", F.col("given").alias("other_given"))
    met = reach.join(back, ["other", "key"]).select("family", "given", "other", "other_given").distinct().where("(family, given) < (other, other_given)")
    edges = _accepted(met.withColumns({"ta": F.array("given", "family"), "tb": F.array("other_given", "other")}), most)
    return full.select(_node("author", "family", "given").alias("node")), edges.select(_node("author", "family", "given").alias("a"), _node("author", "other", "other_given").alias("b"))


def _author_members(parsed: DataFrame, family: DataFrame, shorts: DataFrame, roots: DataFrame) -> DataFrame:
    """(entity, name) of all author names: full names by their component, those with initials only by the person they fit."""
    full = parsed.where("given <> ''").withColumn("node", _node("author", "family", "given")).join(roots, "node").checkpoint()
    # the one person of that family name, else of one an edit away, whom the initial fits
    known = full.join(shorts, full["given"] == shorts["short"], "left").select("family", "root", F.substring(F.coalesce("long", "given"), 1, 1).alias("letter")).distinct()
    brief = parsed.where("given = ''").select("family", "initials").distinct()
    asked = brief.join(family, brief["family"] == family["a"]).select("family", "initials", F.col("b").alias("other")).checkpoint()
    fitting = (
        asked.where("initials <> ''")
        .join(known.withColumnRenamed("family", "other"), "other")
        .where(F.substring("initials", 1, 1) == F.col("letter"))
        .groupBy("family", "initials")
        .agg(F.collect_set(F.when(F.col("other") == F.col("family"), F.col("root"))).alias("here"), F.collect_set("root").alias("all"))
    )
    one = F.when(F.size("here") == 1, F.col("here")[0]).when((F.size("here") == 0) & (F.size("all") == 1), F.col("all")[0])
    same = brief.select(F.col("family").alias("other"), F.col("initials").alias("same"))
    alone = asked.join(same, "other").where("same = initials").groupBy("family", "initials").agg(F.min("other").alias("least"))
    settled = (
        brief.join(fitting.select("family", "initials", one.alias("root")), ["family", "initials"], "left")
        .join(alone, ["family", "initials"], "left")
        .select("family", "initials", F.coalesce("root", _node("?", F.coalesce("least", "family"), "initials")).alias("root"))
    )
    short = parsed.where("given = ''").join(settled, ["family", "initials"])
    return full.select(F.col("root").alias("entity"), "name").unionByName(short.select(F.col("root").alias("entity"), "name"))


def _journal_members(parsed: DataFrame, roots: DataFrame, most: float) -> DataFrame:
    """(entity, name) of all journal names: titles by their component, abbreviations and acronyms by the title they fit."""
    first = F.array_join(F.transform("words", lambda w: F.substring(w, 1, 1)), "")
    full = parsed.where("kind = 'full'").withColumn("node", _node("journal", "closed"))
    whole = full.join(roots, "node").select("name", "root", "words", first.alias("skeleton")).checkpoint()
    acronyms = parsed.where("kind = 'acronym'").select("name", F.col("closed").alias("skeleton"))
    of_acronym = acronyms.join(whole.select("skeleton", "root").distinct(), "skeleton").groupBy("name").agg(F.collect_set("root").alias("fits"))
    brief = parsed.where("kind = 'short'").select("name", F.col("words").alias("ta"), first.alias("skeleton"))
    met = brief.join(whole.select("skeleton", "root", F.col("words").alias("tb")).distinct(), "skeleton")
    of_short = _accepted(met, most).groupBy("name").agg(F.collect_set("root").alias("fits"))
    one = F.when(F.size("fits") == 1, F.col("fits")[0])
    rest = parsed.where("kind <> 'full'").join(of_acronym.unionByName(of_short), "name", "left").select(
        F.coalesce(one, _node("?", F.array_join("words", " "))).alias("entity"), "name"
    )
    return whole.select(F.col("root").alias("entity"), "name").unionByName(rest)


def link_kinds(names: DataFrame, author_most: float = 1.0, journal_most: float = 3.0) -> DataFrame:
    """(kind, entity, name) of each distinct name of both kinds; see link_names. names: kind ('author' or 'journal'), name.

    Both kinds share one run of the connected components. The two limits are the largest costs of an accepted assignment.
    """
    spark = names.sparkSession
    ensure_checkpoint_dir(spark)
    named = names.where("trim(name) <> ''").select("kind", "name").distinct()
    authors = _parsed(named.where("kind = 'author'").select("name"), "name string, family string, given string, initials string", parse_author).checkpoint()
    journals = _parsed(named.where("kind = 'journal'").select("name"), "name string, closed string, words array<string>, kind string", parse_journal).checkpoint()
    shorts = F.broadcast(spark.createDataFrame([(s, f) for s, fs in _FORMAL.items() for f in fs], "short string, long string"))
    family = near_tokens(authors.select(F.col("family").alias("token")).distinct()).checkpoint()
    titles = journals.where("kind = 'full'").select(F.col("closed").alias("token")).distinct()
    nodes, edges = _author_pairs(authors, family, shorts, author_most)
    of_titles = near_tokens(titles).where("a < b").select(_node("journal", "a").alias("a"), _node("journal", "b").alias("b"))
    one_way = edges.unionByName(of_titles).checkpoint()
    both = one_way.unionByName(one_way.select(F.col("b").alias("a"), F.col("a").alias("b")))
    roots = components(nodes.unionByName(titles.select(_node("journal", "token").alias("node"))), both)
    members = _author_members(authors, family, shorts, roots).withColumn("kind", F.lit("author"))
    return members.unionByName(_journal_members(journals, roots, journal_most).withColumn("kind", F.lit("journal"))).select("kind", "entity", "name")


def link_names(names: DataFrame, name: str, kind: str) -> DataFrame:
    """(entity, name): each distinct spelling in the column ``name``, exactly as stored, with the entity it stands for.

    kind: 'author' or 'journal'. Nulls, blank strings and placeholders name nobody and give no row. Repeated rows count
    once; other columns are ignored; an empty table gives no rows. Entities are named by one of their parsed spellings.
    """
    return link_kinds(names.select(F.lit(kind).alias("kind"), F.col(name).cast("string").alias("name"))).select("entity", "name")


def name_pairs(members: DataFrame) -> DataFrame:
    """(kind, name_a, name_b) of each two spellings of one entity, the smaller first in order of bytes. members: kind, entity, name."""
    return pairs_within(members, ["kind", "entity"], "name").select("kind", F.col("a").alias("name_a"), F.col("b").alias("name_b"))


def p4_members(spark: SparkSession, root: str) -> DataFrame:
    """Each spelling with its entity: kind, entity, name."""
    papers = table(spark, root, "papers")
    authors = papers.select(F.lit("author").alias("kind"), F.explode("authors").alias("name"))
    return link_kinds(authors.unionByName(papers.select(F.lit("journal").alias("kind"), F.col("journal").alias("name"))))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of spellings of one person or one journal."""
    return name_pairs(p4_members(spark, root).checkpoint()).distinct()
