"""Hybrid search: a parsed query becomes Column expressions; vectors add a semantic score."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from albumen import vocabulary as V
from albumen.functions import text, vectors
from albumen.operators.graph import materialise
from albumen.operators.once import computed_once
from albumen.operators.photos import captured_between, in_places

# How scores are mixed, and the least semantic score that counts.
SEMANTIC_WEIGHT, PERSON_WEIGHT, PLACE_WEIGHT, CONTEXT_CUT, SEMANTIC_MIN = 10.0, 8.0, 5.0, 12.0, 0.16


def phrase(s: str) -> str:
    """text.normalize_phrase for one string on the driver."""
    folded = unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode().lower()
    return " ".join(re.sub("[^a-z0-9]+", " ", folded).split())


def normalize(s: str) -> str:
    """text.normalize_token for one string on the driver."""
    out = []
    for w in phrase(s).split():
        w = V.CANONICAL.get(w, w)
        out.append(V.CANONICAL.get(w) or text.singular(w))
    return " ".join(out)


# Words that begin a place, words that end it, and the forms of a modifier m with its thing t.
PLACE_OPENERS = ("in", "at", "near", "from")
PLACE_CLOSERS = ("by", "with", "wearing", "holding", "beside", "next to")
PHRASES = ("{m} {t}", "wearing {m} {t}", "{t} color {m}", "{t} colour {m}")
#: Where a modifier and its thing stand, by the kinds of words (m a modifier, f a filler, o another), tried in order;
#: the first form looks at all words, the others at those that are no fillers.
FORMS = (
    (True, re.compile("^(?P<thing>.)f(?P<modifier>m)")),
    (False, re.compile("(?P<modifier>m)(?P<thing>o)")),
    (False, re.compile("(?P<modifier>m).*(?P<thing>o)$")),
)


@dataclass
class Query:
    """The parts of a query that the score looks at."""

    subject: list[str] = field(default_factory=list)
    location: list[str] = field(default_factory=list)
    words: list[str] = field(default_factory=list)
    expanded: list[str] = field(default_factory=list)
    modifier: str = ""
    thing: str = ""
    phrases: list[str] = field(default_factory=list)


def expand(words: list[str]) -> list[str]:
    """Variants and related terms of the words that are not among them."""
    out = dict.fromkeys(words)
    for w in words:
        terms = [normalize(v) for v in text.token_variants(w)]
        terms += [part for r in V.RELATED.get(w, [])[: V.RELATED_USED] for part in normalize(r).split(" ")]
        out |= dict.fromkeys(t for t in terms if t and t not in out)
    return list(out)[len(dict.fromkeys(words)) :]


def parse(query: str) -> Query:
    clean = normalize(query)
    if not clean:
        return Query()
    said, place = _cut(clean, PLACE_OPENERS)
    location = _cut(place, PLACE_CLOSERS)[0].split()
    words = [w for w in clean.split() if w not in V.STOP] or clean.split()
    q = Query(subject=said.split() or location, location=location, words=words, expanded=expand(words))
    for every, form in FORMS:
        seen = [w for w in words if every or w not in V.FILLER]
        kinds = "".join("f" if w in V.FILLER else "m" if w in V.MODIFIERS else "o" for w in seen)
        if m := form.search(kinds):
            q.modifier, q.thing = (seen[m.start(k)] for k in ("modifier", "thing"))
            q.phrases = [p.format(m=q.modifier, t=q.thing) for p in PHRASES]
            break
    return q


def _cut(line: str, at: tuple[str, ...]) -> tuple[str, str]:
    """What stands before and after the first of some words."""
    before, *after = re.split(rf"\b(?:{'|'.join(at)})\b", line, maxsplit=1)
    return before, after[0] if after else ""


def query_text(query: str, q: Query | None = None) -> str:
    q = q or parse(query)
    return " ".join([normalize(query), *q.expanded]).strip() if q.expanded else normalize(query) or query


def lexical_score(q: Query, tags: Column, subject: Column, semantic: Column, place: Column) -> Column:
    """subject: name, semantic text and camera; place: address, city, country and tags; all normalised.

    Places are required, and so is a thing that a modifier goes with; the rest adds up.
    """
    if not q.words:
        return F.lit(0.0)

    def points(*cases: tuple[Column, float]) -> Column:
        out = F
        for condition, n in cases:
            out = out.when(condition, F.lit(float(n)))
        return out.otherwise(F.lit(0.0))

    def holds(w: str) -> Column:
        return F.array_contains(tags, w)

    total, gate = F.lit(3.0 if q.subject and q.location else 0.0), F.lit(True)
    for w in q.location:
        gate = gate & text.contains_term(place, w)
    if q.thing:
        tagged = F.arrays_overlap(tags, F.array(*map(F.lit, text.token_variants(q.thing))))
        said = text.contains_term(subject, q.thing)
        gate = gate & (tagged | said)
        total = total + points((tagged, 6), (said, 3.5))
        tagged, said = holds(q.modifier), text.contains_term(subject, q.modifier)
        total = total + points((tagged, 15), (said, 13.5))
    for p in q.phrases:
        total = total + points((subject.contains(normalize(p)), 5))
    for w in q.words:
        total = total + points((holds(w), 3), (text.contains_term(subject, w), 1.5)) + points((text.contains_term(semantic, w), 2)) + points((text.contains_term(place, w), 2.5))
    more = F.lit(0.0)
    for w in q.expanded:
        more = more + points((holds(w), 1), (text.contains_term(subject, w), 0.7)) + points((text.contains_term(semantic, w), 0.8)) + points((text.contains_term(place, w), 0.8))
    return F.when(gate, total + F.least(more, F.lit(5.0))).otherwise(F.lit(0.0))


def vector_top(vecs: DataFrame, query: list[float], k: int, key: str = "photo_id", col: str = "embedding") -> DataFrame:
    """The k vectors of highest dot product with the unit query: a bounded heap per task, then one merge."""
    unit = F.array(*[F.lit(float(x)) for x in query])
    rows = vecs.where(F.size(col) == len(query)).select(key, vectors.dot(vectors.unit(F.col(col)), unit).alias("semantic"))
    return rows.where("semantic is not null").orderBy(F.desc("semantic"), key).limit(k)


def candidates(limit: int) -> int:
    return max(25 * limit, 500)


def hybrid(scored: DataFrame, q: Query, semantic: DataFrame | None, people_groups: int = 0, places: int = 0, key: str = "photo_id") -> DataFrame:
    """key, lexical, score > 0 and fallback. scored: key, lexical, and said (the modifier stands in the row's own text).

    With a modifier and a thing, rows that score no words are left out; those whose text lacks the modifier, or that
    are under the lexical cut, are a fallback, used only if there are no others. Rows are scored once: they are written,
    narrow, before it is asked whether there are others.
    """
    rows = computed_once(scored)
    if semantic is not None:
        rows = rows.join(semantic.select(key, "semantic"), key, "left")
    else:
        rows = rows.withColumn("semantic", F.lit(None).cast("double"))
    extra = F.when(F.col("semantic") >= SEMANTIC_MIN, F.col("semantic") * SEMANTIC_WEIGHT).otherwise(0.0)
    rows = rows.withColumn("score", F.col("lexical") + extra + F.lit(PERSON_WEIGHT * people_groups + PLACE_WEIGHT * bool(places))).where("score > 0")
    if not q.thing:
        return rows.select(key, "lexical", "score", F.lit(False).alias("fallback"))
    rows = rows.where("lexical > 0").select(key, "lexical", "score", (~F.col("said") | (F.col("lexical") < CONTEXT_CUT)).alias("fallback"))
    rows = materialise(rows, "scored")
    others = rows.agg(F.coalesce(F.bool_or(~F.col("fallback")), F.lit(False)).alias("others"))
    return rows.crossJoin(F.broadcast(others)).where(~F.col("fallback") | ~F.col("others")).drop("others")


def search_fields(df: DataFrame) -> DataFrame:
    """df with what scores look at: tags, semantic, subject and place, all normalised, and raw (the row's own text in
    lower case). df: filename, effective and candidates (arrays), caption, ocr_text, address, city, country, model,
    tags, objects, names (arrays)."""
    word = lambda *c: text.normalize_token(F.concat_ws(" ", *c))
    df = computed_once(df.withColumn("__said", text.semantic_text(F.col("candidates"), [F.col(c) for c in ("filename", "caption", "ocr_text", "address", "city", "country")])))
    raw = F.lower(F.concat_ws(" ", "filename", "caption", "__said", "ocr_text", F.array_join("objects", " "), F.array_join("names", " "), "address", "city", "country", F.array_join("tags", " ")))
    semantic = word("__said")
    df = df.withColumns({"__semantic": semantic, "__subject": F.concat_ws(" ", word("filename"), semantic, word("model")), "__place": word("address", "city", "country", F.array_join("effective", " ")), "__raw": raw})
    return computed_once(df)


def search_photos(photos: DataFrame, query: str, people: DataFrame | None = None, semantic: DataFrame | None = None, first: str | None = None, last: str | None = None, key: str = "photo_id") -> DataFrame:
    """key, lexical, score and fallback of the photos that a query finds, best first.

    Photos must show every person that the query names (one of each name's people), lie in one of the places it
    names, and be taken within the dates. photos: the columns of search_fields, people (ids), captured. people:
    person_id, name. What is collected is bounded by the query: the names and places it spells.
    """
    q = parse(query)
    rows = captured_between(photos, first, last)
    groups = 0
    if people is not None:
        index = person_index(people)
        named = index.join(known_terms(query, index), "term", "left_semi").select("term", F.explode("ids").alias("person_id"))
        named = materialise(named, "named")
        groups = named.select("term").distinct().count()
        if groups:
            shown = rows.select(key, F.explode("people").alias("person_id")).join(named, "person_id").groupBy(key).agg(F.count_distinct("term").alias("n"))
            rows = rows.join(shown.where(F.col("n") == groups).select(key), key, "left_semi")
    places = [r.term for r in known_terms(query, place_terms(photos, ["city", "country", "address"])).collect()]
    if places:
        rows = rows.where(in_places(F.col("address"), F.col("city"), F.col("country"), places))
    fields = search_fields(rows)
    lexical = lexical_score(q, F.col("effective"), F.col("__subject"), F.col("__semantic"), F.col("__place"))
    said = F.col("__raw").contains(q.modifier) if q.thing else F.lit(True)
    found = hybrid(fields.select(key, lexical.alias("lexical"), said.alias("said")), q, semantic, groups, len(places), key)
    return found.orderBy(F.desc("score"), key)


def known_terms(query: str, vocabulary: DataFrame, col: str = "term") -> DataFrame:
    """The terms of a vocabulary that the query has as whole words, the longest first."""
    padded = F.lit(f" {phrase(query)} ")
    term = text.normalize_phrase(F.col(col))
    hit = vocabulary.select(term.alias("term")).distinct().where((F.col("term") != "") & padded.contains(F.concat(F.lit(" "), F.col("term"), F.lit(" "))))
    return hit.orderBy(F.length("term").desc(), "term")


def terms_of(queries: DataFrame, vocabulary: DataFrame, query_id: str, query: str, col: str = "term") -> DataFrame:
    """(query_id, term): known_terms for every row of a table of queries at once.

    A query's runs of words, of the lengths that terms have, are looked up by equality: what is shuffled is a query's
    words times the distinct lengths of terms in words, and neither side is broadcast or scanned per query. Queries
    without an id, words or known terms give no rows.
    """
    terms = materialise(vocabulary.select(text.normalize_phrase(F.col(col)).alias("term")).where("term <> ''").distinct(), "terms")
    sizes = [r.n for r in terms.select(F.size(F.split("term", " ")).alias("n")).distinct().collect()]
    if not sizes:
        return queries.select(query_id, F.lit("").alias("term")).where(F.lit(False))
    words = F.split(text.normalize_phrase(F.col(query)), " ")
    rows = computed_once(queries.select(F.col(query_id), words.alias("__words")).where(F.col(query_id).isNotNull()))

    def runs_of(n: int) -> Column:
        starts = F.when(F.size("__words") >= n, F.sequence(F.lit(1), F.size("__words") - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda at: F.array_join(F.slice("__words", at, n), " "))

    runs = F.concat(*map(runs_of, sorted(sizes)))
    return rows.select(query_id, F.explode(F.array_distinct(runs)).alias("term")).join(terms, "term").select(query_id, "term")


def place_terms(df: DataFrame, columns: list[str], least: int = 3) -> DataFrame:
    """Distinct words of some length, and whole names, of the place columns; longest first."""
    names = df.select(F.explode(F.array(*[text.normalize_phrase(F.coalesce(c, F.lit(""))) for c in columns])).alias("term")).distinct()
    words = names.select(F.explode(F.split("term", " ")).alias("term")).where(F.length("term") >= least)
    return names.where("term <> ''").unionByName(words).distinct().orderBy(F.length("term").desc(), "term")


def person_index(people: DataFrame) -> DataFrame:
    """Normalised full and first names of named people, and the ids they stand for."""
    name = text.normalize_phrase(F.col("name"))
    rows = people.where((F.trim(F.coalesce("name", F.lit(""))) != "") & ~text.is_unnamed(F.col("name"))).select("person_id", F.explode(F.array_distinct(F.array(name, F.substring_index(name, " ", 1)))).alias("term"))
    return rows.where("term <> ''").groupBy("term").agg(F.array_sort(F.collect_set("person_id")).alias("ids"))
