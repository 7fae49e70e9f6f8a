"""Text functions as column expressions: query rewriting, classes, citations, entities, structure.

Patterns keep to what Java, Python and RE2 read alike: no look-behind, boundaries only beside ASCII letters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Misspelt terms and their spelling. Fixed values, those of the reference without its identities.
SPELLING = {
    "chromotography": "chromatography", "chromtography": "chromatography", "spectometry": "spectrometry", "flourescence": "fluorescence", "flourescent": "fluorescent",
    "catalisis": "catalysis", "catalist": "catalyst", "moleculer": "molecular", "sythesis": "synthesis", "syntheis": "synthesis", "crystalization": "crystallization",
    "crystalisation": "crystallisation", "soluable": "soluble", "equilibrum": "equilibrium", "stoichiomtery": "stoichiometry", "protien": "protein", "protiens": "proteins",
    "enzyem": "enzyme", "enzym": "enzyme", "mitocondria": "mitochondria", "mitocondrial": "mitochondrial", "nuclueus": "nucleus", "nuclues": "nucleus",
    "recptor": "receptor", "recpetor": "receptor", "antibodiy": "antibody", "antobody": "antibody", "apoptsis": "apoptosis", "apotosis": "apoptosis",
    "phosphorlyation": "phosphorylation", "phosphrylation": "phosphorylation", "electrophorsis": "electrophoresis", "electrophresis": "electrophoresis",
    "centerfugation": "centrifugation", "centrifigation": "centrifugation", "lyophilzation": "lyophilization", "incubaton": "incubation", "signifcant": "significant",
    "significent": "significant", "concentraion": "concentration", "concentraton": "concentration", "efficency": "efficiency", "dependant": "dependent", "independant": "independent",
}
#: Acronyms and the first of their expansions. Fixed values, those of the reference.
ACRONYMS = {
    "PCR": "polymerase chain reaction", "HPLC": "high performance liquid chromatography", "GC-MS": "gas chromatography mass spectrometry",
    "LC-MS": "liquid chromatography mass spectrometry", "NMR": "nuclear magnetic resonance", "IC50": "half maximal inhibitory concentration",
    "EC50": "half maximal effective concentration", "MIC": "minimum inhibitory concentration", "SAR": "structure activity relationship",
    "QSAR": "quantitative structure activity relationship", "ELISA": "enzyme linked immunosorbent assay", "SDS-PAGE": "sodium dodecyl sulfate polyacrylamide gel electrophoresis",
    "Western blot": "immunoblot", "qPCR": "quantitative PCR", "siRNA": "small interfering RNA", "shRNA": "short hairpin RNA", "CRISPR": "CRISPR-Cas9", "RNAi": "RNA interference",
    "SPR": "surface plasmon resonance", "ITC": "isothermal titration calorimetry", "CD": "circular dichroism", "DLS": "dynamic light scattering",
    "TEM": "transmission electron microscopy", "SEM": "scanning electron microscopy", "AFM": "atomic force microscopy", "XRD": "X-ray diffraction",
    "FTIR": "Fourier transform infrared spectroscopy",
}
#: Signals of the kinds of question, by substring, first kind wins. Fixed values, those of the reference.
SIGNALS = {
    "methods": ("protocol", "procedure", "synthesized", "synthesis", "purified", "purification", "buffer", "concentration", "incubation", "temperature", "how was", "how were",
                "how is", "how are", "what method", "what protocol", "what buffer", "what concentration", "cell line", "assay", "measured", "performed"),
    "limitations": ("limitation", "caveat", "constraint", "weakness", "drawback", "shortcoming", "without", "lacking"),
    "novelty": ("implication", "significance", "finding", "conclude", "conclusion", "novel", "unique", "important", "contribution", "what did they find", "what were the results",
                "what does this mean", "why is this important", "key insight", "main finding", "discovered", "demonstrate", "shown", "proved", "established"),
}
#: Words that are no evidence for a claim. Fixed values, those of the reference.
CLAIM_STOP = tuple(
    """the a an is are was were be been have has had do does did will would could should may might can this that these
    those it its and or but for with from to of in on at by as""".split()
)
CITATION = r"\[(?:[Ss][Oo][Uu][Rr][Cc][Ee]\s*)?\d+(?:\s*,\s*\d+)*\]"
#: Patterns of entities by category, without regard to case. Fixed values, after the reference.
ENTITIES = {
    "chemicals": (r"[A-Z]{2,4}-\d{3,6}", r"[A-Z][a-z]+(?:in|ol|ine|ate|ide|ase|one)", r"(?:sodium|potassium|calcium|chloride|sulfate|phosphate)"),
    "proteins": (r"[A-Z]{2,5}\d{1,2}", r"(?:kinase|receptor|enzyme|antibody|peptide)", r"[A-Z][a-z]+(?:ase|globin)"),
    "methods": (r"(?:HPLC|LC-MS|MS|NMR|PCR|ELISA|Western\s*blot)", r"(?:assay|microscopy|chromatography|electrophoresis|spectroscopy)",
                r"(?:synthesis|purification|extraction|incubation)"),
    "organisms": (r"(?:E\.\s*coli|S\.\s*aureus|HeLa|HEK\s*293|CHO)", r"(?:mouse|mice|rat|human|yeast|bacteria)"),
    "metrics": (r"IC50|EC50|Ki|Kd|Km", r"\d+(?:\.\d+)?\s*(?:nM|mM|pM|ng/mL|mg/mL)"),
}
#: Words that are no entities. Fixed values, those of the reference.
NO_ENTITY = tuple(
    """the and for with from that this are was were been have has what when where which how why who can could would should
    may protein method result study paper research""".split()
)
#: Headings that papers have. Fixed values, those of the reference.
PAPER_SECTIONS = (
    r"\babstract\b", r"\bintroduction\b", r"\bbackground\b", r"\bliterature\s+review\b", r"\bmethods?\b", r"\bmaterials?\s*(and|&)\s*methods?\b", r"\bexperimental\b", r"\bresults?\b",
    r"\bdiscussion\b", r"\bconclusions?\b", r"\backnowledg", r"\breferences\b", r"\bbibliography\b", r"\bsupplementary\b", r"\bappendix\b",
)
SPACES = "               　"
DASHES = "‐‑‒–—―−"


def _escaped(word: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+?^$|-" else c for c in word)


def bounded(pattern: str) -> str:
    """The pattern as the first group of one that matches it only as whole words, in Java and RE2 alike."""
    return rf"(?i)(?:^|[^\p{{L}}\p{{N}}_])({pattern})(?:$|[^\p{{L}}\p{{N}}_])"


def _hits(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(f, F.lit(False)).cast("int") for f in flags])


def corrected(text: Column, spelling: dict[str, str] = SPELLING) -> Column:
    """Whole words of ``spelling`` replaced, whatever their case. Texts that hold none cost one match."""
    any_ = r"(?i)\b(?:" + "|".join(map(_escaped, spelling)) + r")\b"
    fixed = reduce(lambda t, w: F.regexp_replace(t, rf"(?i)\b{_escaped(w)}\b", spelling[w]), spelling, text)
    return F.when(text.rlike(any_), fixed).otherwise(text)


def expansions(text: Column, acronyms: dict[str, str] = ACRONYMS) -> Column:
    """Expansions of the acronyms in the text that it does not spell out, in the order of the table."""
    low = F.lower(text)
    each = [F.when(text.rlike(rf"(?i)\b{_escaped(a)}\b") & ~F.contains(low, F.lit(e.lower())), e) for a, e in acronyms.items()]
    return F.array_compact(F.array(*each))


def expanded(text: Column, acronyms: dict[str, str] = ACRONYMS, most: int = 3) -> Column:
    """The text with its expansions, ``most`` at most, in brackets after it."""
    more = F.slice(expansions(text, acronyms), 1, most)
    return F.when(F.size(more) > 0, F.concat(text, F.lit(" ("), F.array_join(more, ", "), F.lit(")"))).otherwise(text)


def sub_questions(text: Column) -> Column:
    """Questions that a comparison, a cause or a double question is made of; empty for others."""
    low = F.lower(text)
    both = lambda p: [F.trim(F.regexp_extract(text, "(?i)" + p, k)) for k in (1, 2)]
    what = lambda x: F.concat(F.lit("What is "), x, F.lit("?"))
    out = F.array().cast("array<string>")
    patterns = [
        (r"compare\s+(.+?)\s+(?:and|vs\.?|versus)\s+(.+)", "compare", "compare"), (r"difference\s+between\s+(.+?)\s+and\s+(.+)", "compare", "difference"), (r"(.+?)\s+(?:vs\.?|versus)\s+(.+)", "compare", "vs versus"),
        (r"(.+?)\s+and\s+(?:also|additionally)\s+(.+)", "parts", "also additionally"), (r"(.+?)\.?\s+(?:also|additionally|furthermore),?\s+(.+)", "parts", "also additionally furthermore"), (r"how\s+does\s+(.+?)\s+affect\s+(.+)", "cause", "affect"),
        (r"what\s+is\s+the\s+effect\s+of\s+(.+?)\s+on\s+(.+)", "cause", "effect"), (r"relationship\s+between\s+(.+?)\s+and\s+(.+)", "cause", "relationship"),
    ]
    for pattern, kind, words in reversed(patterns):
        a, b = both(pattern)
        made = {
            "compare": F.array(what(a), what(b), text), "parts": F.array(F.concat(a, F.lit("?")), F.concat(b, F.lit("?"))),
            "cause": F.array(what(a), F.concat(F.lit("How does "), a, F.lit(" affect "), b, F.lit("?"))),
        }[kind]
        # the pattern backtracks over long texts, so it is only tried where one of its words stands
        may = reduce(lambda x, y: x | y, [F.contains(low, F.lit(w)) for w in words.split()])
        out = F.when(may & text.rlike("(?i)" + pattern), made).otherwise(out)
    return out


def is_ambiguous(text: Column) -> Column:
    """Three words at most, a pronoun, or a general opening with five words at most."""
    words = F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""))
    pronoun = F.concat(F.lit(" "), F.lower(text), F.lit(" ")).rlike(" (?:it|this|that|they|these|those) ")
    general = F.lower(text).rlike("^(?:what is|how does|why is|tell me about|explain|describe)")
    return (words <= 3) | pronoun | (general & (words <= 5))


def question_kind(text: Column, signals: dict[str, tuple[str, ...]] = SIGNALS) -> Column:
    """The first kind one of whose signals stands in the text, else ``general``."""
    low, out = F.lower(text), F.lit("general")
    for kind, words in reversed(signals.items()):
        out = F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words]), kind).otherwise(out)
    return out


def sentences(text: Column) -> Column:
    """The text cut after each ., ! or ? that white space follows; the marks stay with their sentence."""
    return F.filter(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"([.!?])\s+", "$1\u0001"), "\u0001"), lambda s: s != "")


def citations(text: Column) -> Column:
    """(source, claim) of every citation of every sentence: ``[1]``, ``[Source 1, 2]``; a claim counts once a source."""
    def of(sentence: Column) -> Column:
        claim = F.trim(F.regexp_replace(sentence, CITATION, ""))
        marks = F.regexp_extract_all(sentence, F.lit(CITATION), F.lit(0))
        numbers = F.flatten(F.transform(marks, lambda m: F.regexp_extract_all(m, F.lit(r"\d+"), F.lit(0))))
        return F.transform(numbers, lambda n: F.struct(n.cast("bigint").alias("source"), claim.alias("claim")))

    return F.filter(F.array_distinct(F.flatten(F.transform(sentences(text), of))), lambda c: (c["claim"] != "") & c["source"].isNotNull())


def support(claim: Column, source: Column) -> Column:
    """Share of the claim's words (three letters or more, no stop words) that stand anywhere in the source; 0 without words."""
    words = F.array_distinct(F.filter(F.split(F.lower(claim), r"[^\p{L}\p{N}_]+"), lambda w: (F.length(w) > 2) & ~w.isin(*CLAIM_STOP)))
    low = F.lower(F.coalesce(source, F.lit("")))
    return F.when(F.size(words) > 0, F.size(F.filter(words, lambda w: F.contains(low, w))) / F.size(words)).otherwise(F.lit(0.0))


def entities(text: Column, category: str) -> Column:
    """Distinct entities of a category, in lower case and in order, longer than two characters and no common words."""
    found = F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(bounded(p)), F.lit(1)) for p in ENTITIES[category])))
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, F.lower), lambda e: (F.length(e) > 2) & ~e.isin(*NO_ENTITY))))


def all_entities(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.array(*(entities(text, c) for c in ENTITIES)))))


def entity_overlap(asked: Column, found: Column) -> Column:
    """Share of the asked entities that are found; 1 where none is asked."""
    return F.when(F.size(asked) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(asked, found)) / F.size(asked))


def doi(text: Column) -> Column:
    """The first DOI, after a ``doi`` mark before any other, without closing punctuation; null without one."""
    tries = [r"doi\.org/(10\.\d{4,}/[^\s\"')]+)", r"(?i)doi:?\s*(10\.\d{4,}/[^\s\"')]+)", r"\b(10\.\d{4,}/[A-Za-z0-9.\-_()/]+)"]
    hits = [F.regexp_replace(F.regexp_extract(text, t, 1), r"[.,;:)\"'\s]+$", "") for t in tries]
    return F.coalesce(*(F.when(h != "", h) for h in hits))


def year(text: Column) -> Column:
    found = F.regexp_extract(text, r"(?:19|20)\d{2}", 0)
    return F.when(found != "", found).cast("int")


def is_prose(text: Column) -> Column:
    """150 characters or more, 55 % letters, 30 words, two full stops."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return (F.length(text) >= 150) & (letters >= F.length(text) * 0.55) & (words >= 30) & (F.length(text) - F.length(F.replace(text, F.lit("."))) >= 2)


def section_hits(text: Column) -> Column:
    """How many kinds of headings of papers the text names."""
    low = F.lower(text)
    return _hits([low.rlike(p) for p in PAPER_SECTIONS]).cast("bigint")


def structure(text: Column) -> Column:
    """Paragraphs over 50 characters, their mean length, citations, figure and table mentions, and whether there are equations."""
    parts = F.filter(F.transform(F.split(text, "\n\n"), lambda p: F.trim(p)), lambda p: F.length(p) > 50)
    total = F.aggregate(parts, F.lit(0), lambda s, p: s + F.length(p))
    return F.struct(
        F.size(parts).cast("bigint").alias("paragraphs"), F.regexp_count(text, F.lit(r"\[\d+\]")).cast("bigint").alias("citations"),
        F.regexp_count(text, F.lit(r"(?i)(?:Figure|Fig\.?|Table)\s*\d+")).cast("bigint").alias("figures"), text.rlike(r"[=∑∫∂]|\\frac|\\sum").alias("equations"),
        (total / F.greatest(F.size(parts), F.lit(1))).alias("mean_length"),
    )


def content_score(text: Column) -> Column:
    """Score of a text as a paper, from its headings, citations, figures, paragraphs and equations."""
    s = structure(text)
    step = lambda c, a, b, x, y: F.when(c > a, x).when(c > b, y).otherwise(0.0)
    paragraphs = F.when((s["paragraphs"] > 10) & (s["mean_length"] > 200), 0.15).when(s["paragraphs"] > 5, 0.08).otherwise(0.0)
    return F.least(section_hits(text) / 8.0, F.lit(0.4)) + step(s["citations"], 5, 0, 0.2, 0.1) + step(s["figures"], 2, 0, 0.15, 0.08) + paragraphs + F.when(s["equations"], 0.1).otherwise(0.0)


def vote(paper: Column, rejected: Column, total: Column) -> Column:
    """paper or rejected where more than six tenths of the confidence say so, else uncertain."""
    share = lambda c: F.coalesce(F.try_divide(c, total), F.lit(0.0))
    return F.when(share(paper) > 0.6, "paper").when(share(rejected) > 0.6, "rejected").otherwise("uncertain")


def same_width(text: Column) -> Column:
    """Unusual blanks as blanks and dashes as hyphens, one character for one, so offsets stay."""
    return F.translate(text, SPACES + DASHES, " " * len(SPACES) + "-" * len(DASHES))


def embed_text(context: Column, body: Column, text: Column, more: Column | None = None) -> Column:
    """Context line, further context and body (the text where there is none), a line each, without empty ones."""
    some = lambda c: F.when(c != "", c)
    return F.concat_ws("\n", some(context), some(F.lit(None) if more is None else more), some(F.coalesce(body, text)))


def cache_key(query: Column, filters: list[Column], k: Column) -> Column:
    """MD5 of a search: question, its filters in order, and size."""
    return F.md5(F.concat_ws("|", F.coalesce(query, F.lit("")), *(F.array_join(F.array_sort(F.coalesce(f, F.array().cast("array<string>"))), ",") for f in filters), k.cast("string")))


def pair_key(query: Column, chunk: Column) -> Column:
    """SHA-256 of a question and a chunk id with a null character between them."""
    return F.sha2(F.concat(F.encode(query, "UTF-8"), F.unhex(F.lit("00")), F.encode(chunk, "UTF-8")), 256)


def groups_present(text: Column, groups: list[list[str]]) -> Column:
    """Numbers of the groups of terms of which at least one stands in the text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hit = [F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(v.lower())) for v in g]), F.lit(i)) for i, g in enumerate(groups)]
    return F.array_compact(F.array(*hit))


def judgment(raw: Column) -> Column:
    """The grade (0 to 2) in the first JSON object of an answer; 0 for any other answer."""
    grade = F.try_variant_get(F.try_parse_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0)), "$.grade", "int")
    return F.when(grade.isin(0, 1, 2), grade).otherwise(0)


def truncated(text: Column, words: int) -> Column:
    """The first ``words`` words, back to their last sentence end where that lies past the half; the whole text if it is shorter."""
    head = F.regexp_extract(F.coalesce(text, F.lit("")), rf"^\s*(?:\S+\s+){{0,{words - 1}}}\S+", 0)
    ends = reduce(lambda a, b: a | b, [F.contains(head, F.lit(f"{mark} ")) for mark in ".?!"])
    cut = F.greatest(*(F.when(F.contains(head, F.lit(f"{mark} ")), F.length(head) - F.instr(F.reverse(head), F.lit(f" {mark}"))).otherwise(0) for mark in ".?!"))
    return F.when(F.length(head) >= F.length(F.rtrim(text)), text).when(ends & (cut > F.length(head) * 0.5), F.substring(head, F.lit(1), cut)).otherwise(head)


def with_note(answer: Column, confidence: Column, invalid: Column, least: float = 0.7) -> Column:
    """The answer with a note where its citations' mean confidence is under ``least`` and some do not hold."""
    note = F.concat(F.lit("\n\nNote: "), invalid.cast("string"), F.lit(" of the citations could not be confirmed in their sources."))
    return F.when((confidence < least) & (invalid > 0), F.concat(answer, note)).otherwise(answer)


def merged_types(lists: list[Column]) -> Column:
    """All chunk types of several classes, each once, in order of first mention."""
    return F.array_distinct(F.flatten(F.array(*lists)))
