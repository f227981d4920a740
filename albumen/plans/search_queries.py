"""Text values, tag curation and search."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from albumen import vocabulary as V
from albumen.functions import text, vectors
from albumen.operators import curation as C
from albumen.operators import ranking
from albumen.operators import search as Q
from albumen.operators.once import computed_once
from albumen.plans import standins as S
from albumen.plans.registry import query
from albumen.sources import files

W = "WITH " + S.PHOTOS
_FOLD = "trim(regexp_replace(lower(regexp_replace(strip_accents({}), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', ' ', 'g'))"
_CANON = "CASE w " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.CANONICAL.items() if k.isascii()) + " END"
_SINGULAR = """CASE WHEN length({w}) <= 3 OR ends_with({w}, 'ss') THEN {w} WHEN ends_with({w}, 'ies') AND length({w}) > 4 THEN {w}[:-4] || 'y' WHEN ends_with({w}, 'ves') AND length({w}) > 4 THEN {w}[:-4] || 'f'
 WHEN ends_with({w}, 'es') AND regexp_matches({w}[:-3], '(s|x|z|ch|sh|o)$') THEN {w}[:-3] WHEN ends_with({w}, 's') THEN {w}[:-2] ELSE {w} END"""
#: Every word of the documents, once.
_WORDS = f"word AS (SELECT DISTINCT unnest(string_split({_FOLD.format('text')}, ' ')) AS w FROM documents)"


def _words(spark, sf_dir):
    return S.read(spark, sf_dir, "documents").select(F.explode(F.split(text.normalize_phrase(F.col("text")), " ")).alias("w")).distinct()


@query(f"SELECT doc_id, sha256({_FOLD.format('text')}) AS phrase FROM documents")
def normalize_phrase(spark, sf_dir):
    """X1 over whole texts; digests keep the report small."""
    return S.read(spark, sf_dir, "documents").select("doc_id", F.sha2(text.normalize_phrase(F.col("text")), 256).alias("phrase"))


@query(f"WITH {_WORDS} SELECT w, {_SINGULAR.format(w='w')} AS singular FROM word WHERE w <> ''")
def singular_words(spark, sf_dir):
    """X3."""
    return _words(spark, sf_dir).where("w <> ''").select("w", text.singularize(F.col("w")).alias("singular"))


def _token(c: str) -> str:
    """X2 as SQL."""
    words = f"list_filter(string_split({_FOLD.format(c)}, ' '), lambda w: w <> '')"
    return f"array_to_string(list_transform(list_transform({words}, lambda w: coalesce({_CANON}, w)), lambda w: coalesce({_CANON}, {_SINGULAR.format(w='w')})), ' ')"


@query(f"SELECT doc_id, sha256({_token('text')}) AS token FROM documents")
def normalize_token(spark, sf_dir):
    """X2 over whole texts; digests keep the report small."""
    return S.read(spark, sf_dir, "documents").select("doc_id", F.sha2(text.normalize_token(F.col("text")), 256).alias("token"))


def _in(words):
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _case(column, table, default):
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in table.items()) + f" ELSE {default}::DOUBLE END"


_BUCKET = f"""CASE WHEN tag IN {_in(V.PERSON)} OR source IN ('ai_person', 'face') THEN 'person' WHEN tag IN {_in(V.ANIMAL)} THEN 'animal' WHEN tag IN {_in(V.FLOWER)} THEN 'flower' WHEN tag IN {_in(V.PLANT)} THEN 'plant'
 WHEN tag IN {_in(V.PLACE)} OR source = 'location' THEN 'place' WHEN tag IN {_in(V.ACTION)} OR ends_with(tag, 'ing') THEN 'action' WHEN tag IN {_in(V.SEASON)} THEN 'season' WHEN tag IN {_in(V.WEATHER)} THEN 'weather'
 WHEN tag IN {_in(V.SCENE)} THEN 'scene' WHEN tag IN {_in(V.BACKGROUND)} THEN 'background' ELSE 'object' END"""
_POOL = ("dog", "rose", "garden", "person", "outdoor", "running", "sunset", "sky", "widget", "cloud", "beach", "photo", "ring", "winter")
_SOURCES = ("user", "stored", "ai_person", "ai_object", "ai_tag", "ai_prediction", "location")
#: Tag records from events: user_id is the photo, event_id the place, value / 100 the confidence.
_RECORDS = f"""rec AS (SELECT user_id AS key, event_id AS pos, [{', '.join(f"'{w}'" for w in _POOL)}][event_id % {len(_POOL)} + 1] AS tag, [{', '.join(f"'{w}'" for w in _SOURCES)}][event_id // 3 % {len(_SOURCES)} + 1] AS source,
 CASE WHEN event_id % 11 <> 0 THEN value / 100 END AS raw FROM events),
 sc AS (SELECT *, round(least(greatest(coalesce(raw, {_case('source', V.SOURCE_CONFIDENCE, 0.5)}), 0.0::DOUBLE), 1.0::DOUBLE), 4) AS confidence, {_BUCKET} AS bucket FROM rec),
 im AS (SELECT *, tag IN {_in(V.GENERIC)} AS low, round(confidence * 10.0::DOUBLE + {_case('bucket', V.BUCKET_WEIGHT, 1.0)} + {_case('source', V.SOURCE_WEIGHT, 0.5)} + CASE WHEN bucket IN {_in(V.SUBJECT_BUCKETS)} THEN 0.45::DOUBLE ELSE 0.0::DOUBLE END - CASE WHEN tag IN {_in(V.GENERIC)} THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END, 4) AS importance FROM sc)"""


def _records(spark, sf_dir):
    k = F.col("event_id")
    pick = lambda n, v: F.element_at(F.array(*map(F.lit, v)), (n % len(v) + 1).cast("int"))
    return S.read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), k.alias("pos"), pick(k, _POOL).alias("label"), pick(F.floor(k / 3), _SOURCES).alias("source"), F.when(k % 11 != 0, F.col("value") / 100).alias("confidence"))


@query(f"WITH {_RECORDS} SELECT pos, tag, source, confidence, bucket, importance FROM im")
def tag_importance(spark, sf_dir):
    """X9, X10, X11."""
    return C.scored(_records(spark, sf_dir)).select("pos", "tag", "source", "confidence", "bucket", "importance")


_CURATE = f"""WITH {_RECORDS}, w AS (SELECT *, source NOT IN ('user', 'stored') AND (confidence < 0.18 OR low AND confidence < 0.55) AS weak FROM im),
 b AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY key, weak, tag ORDER BY importance DESC, pos) = 1),
 s AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY importance DESC, tag) AS rank FROM b WHERE NOT weak),
 k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY confidence DESC, tag) AS rank FROM b WHERE weak AND NOT EXISTS (SELECT 1 FROM s WHERE s.key = b.key AND s.tag = b.tag AND s.rank <= 40)),
 a AS (SELECT key, tag, rank, bucket, confidence, importance, 'selected' AS kind FROM s WHERE rank <= 40 UNION ALL SELECT key, tag, rank, bucket, confidence, importance, 'weak' FROM k WHERE rank <= 40)"""


@query(_CURATE + " SELECT * FROM a")
def tag_curation(spark, sf_dir):
    """X12, A16, T7."""
    return C.curate(_records(spark, sf_dir), "key").drop("role")


@query(_CURATE + " SELECT key, bucket, string_agg(tag, ',' ORDER BY rank) AS tags FROM a WHERE kind = 'selected' GROUP BY 1, 2")
def tag_buckets(spark, sf_dir):
    """A17."""
    rows = C.buckets(C.curate(_records(spark, sf_dir), "key"), "key").select("key", F.explode("buckets").alias("bucket", "t"))
    return rows.select("key", "bucket", F.array_join("t", ",").alias("tags"))


@query(f"{W} SELECT photo_id, lower(country) AS label, 'place' AS source FROM photo WHERE country IS NOT NULL UNION ALL SELECT photo_id, unnest(tags), 'stored' FROM photo UNION ALL SELECT photo_id, unnest(people), 'ai_person' FROM photo")
def tag_union(spark, sf_dir):
    """Tag records of all sources."""
    df = S.photos(spark, sf_dir).withColumn("place", F.when(F.col("country").isNotNull(), F.array(F.lower("country"))))
    return C.union_sources(df, "photo_id", {"stored": "tags", "ai_person": "people", "place": "place"}).drop("pos")


@query("""WITH r AS (SELECT event_id AS pos, user_id AS key, event_type AS label FROM events), s AS (SELECT user_id AS key, lower(event_type) AS low, min_by(value, event_id) AS confidence FROM events WHERE event_type <> 'view' GROUP BY 1, 2)
SELECT r.pos, r.key, r.label, s.confidence FROM r LEFT JOIN s ON r.key = s.key AND r.label = s.low""")
def label_scores(spark, sf_dir):
    """The first score of each label."""
    e = S.read(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.col("user_id").alias("key"), F.col("event_type").alias("label"), F.col("value").alias("score"))
    return C.with_model_scores(e.drop("score"), e.where("label <> 'view'").withColumn("label", F.upper("label")), "key")


@query(f"""{W} SELECT photo_id, array_to_string(list_distinct_in_order, ',') AS tags FROM (SELECT photo_id, list_filter([tags[1], tags[2], CASE WHEN tags[3] NOT IN (tags[1], tags[2]) THEN tags[3] END, lower(city_word)], lambda x: x IS NOT NULL) AS list_distinct_in_order FROM (SELECT *, NULL::VARCHAR AS city_word FROM photo))""")
def normalized_tags(spark, sf_dir):
    """Distinct one-word tags in their order; a second copy and a phrase are dropped."""
    raw = F.concat("tags", F.array(F.upper(F.element_at("tags", 1)), F.lit("two words"), F.lit("")))
    return S.photos(spark, sf_dir).select("photo_id", F.array_join(text.normalize_tags(raw), ",").alias("tags"))


@query(f"{W} SELECT photo_id, CASE WHEN n = 0 THEN '' WHEN n = 1 THEN 'face,person,portrait,selfie' WHEN n = 2 THEN 'face,person,portrait,selfie,pair' ELSE 'face,person,portrait,group,family,crowd' END AS tags FROM (SELECT photo_id, photo_id % 4 AS n FROM photo)")
def face_presence(spark, sf_dir):
    """X14."""
    return S.photos(spark, sf_dir).select("photo_id", F.array_join(text.face_presence_tags((F.col("photo_id") % 4).cast("string")), ",").alias("tags"))


def _tags(c: str) -> str:
    """X4 as SQL, but for the order of equals: distinct one-word tokens of a list, as a list with repeats."""
    return f"list_filter(list_transform({c}, lambda t: {_token('t')}), lambda t: t <> '' AND NOT contains(t, ' '))"


_ONCE = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
_EFFECTIVE = f"""{W}, part_tags AS (SELECT *, CASE WHEN photo_id % 4 <> 0 THEN [tags[2]] ELSE [] END AS subjects, ['Anns', 'Ann ' || photo_id % 5] AS persons, ['Brand' || photo_id % 7, address] AS places, ['Floors', 'SKY'] AS grounds,
 ['widgets', 'guess' || photo_id % 3] AS guesses, CASE WHEN photo_id % 3 = 1 THEN ['face', 'person', 'portrait', 'person', 'selfie'] ELSE [] END AS shown FROM photo),
 n1 AS (SELECT *, {_tags('list_concat(subjects, persons, places)')} AS l1, {_tags('list_concat(tags, objects, grounds, guesses)')} AS l2, {_tags('list_concat(subjects, places)')} AS l3 FROM part_tags),
 n2 AS (SELECT *, list_concat(l2, shown) AS l4 FROM n1),
 n3 AS (SELECT *, list_concat({_ONCE.format('l1')}, list_filter(l4, lambda x, i: list_position(l4, x) = i AND NOT list_contains(l1, x))) AS effective, {_ONCE.format('l3')} AS own FROM n2),
 e AS (SELECT *, effective AS etags, CASE WHEN len(own) > 0 THEN own ELSE effective END AS candidates FROM n3)"""


def _effective(spark, sf_dir):
    k, s = F.col("photo_id"), lambda *x: F.array(*x)
    none = F.array().cast("array<string>")
    subjects = F.when(k % 4 != 0, s(F.element_at("tags", 2))).otherwise(none)
    place = text.location_tags(F.concat(F.lit("Brand"), (k % 7).cast("string")), F.lit(None).cast("string"), F.col("address"))
    guesses = text.prediction_tags(s(*[F.struct(label.alias("label"), F.lit(p).alias("score")) for label, p in ((F.lit("widgets"), "0.9"), (F.concat(F.lit("guess"), (k % 3).cast("string")), "0.08"), (F.lit("never"), "0.01"))]))
    faces = text.face_presence_tags(F.when(k % 3 == 1, "1").otherwise("0"))
    df = S.photos(spark, sf_dir, spread=True).withColumns({"subjects": subjects, "places": place})
    out = text.effective_tags(F.col("subjects"), s(F.lit("Anns"), F.concat(F.lit("Ann "), (k % 5).cast("string"))), F.col("places"), F.col("tags"), F.col("objects"), s(F.lit("Floors"), F.lit("SKY")), guesses, faces)
    df = computed_once(df.withColumn("effective", out))
    return df.withColumn("candidates", text.semantic_candidates(F.col("subjects"), F.col("places"), F.col("effective")))


@query(_EFFECTIVE + " SELECT photo_id, array_to_string(etags, ',') AS tags FROM e")
def effective_tags(spark, sf_dir):
    """X13."""
    return _effective(spark, sf_dir).select("photo_id", F.array_join("effective", ",").alias("tags"))


@query(_EFFECTIVE + " SELECT photo_id, array_to_string(list_sort(candidates), ' ') AS semantic_text FROM e")
def semantic_text(spark, sf_dir):
    """Subjects and places, or else the effective tags; words of the fields that are among them add nothing new."""
    return computed_once(_effective(spark, sf_dir)).select("photo_id", text.semantic_text(F.col("candidates"), [F.col("filename"), F.col("country")]).alias("semantic_text"))


@query(_EFFECTIVE + """, y AS (SELECT photo_id, CASE WHEN len(subjects) > 0 THEN """ + _tags("subjects") + " ELSE effective END AS s, " + _tags("places") + """ AS l FROM e)
SELECT photo_id, array_to_string(s, ',') AS subjects, array_to_string(l, ',') AS locations, 'floor,sky' AS backgrounds, 'box' AS weak FROM y""")
def semantic_layers(spark, sf_dir):
    """X16."""
    layers = text.semantic_layers(F.col("subjects"), F.col("places"), F.array(F.lit("Floors"), F.lit("sky")), F.array(F.lit(" boxes "), F.lit(None).cast("string")), F.col("effective"))
    return computed_once(_effective(spark, sf_dir).withColumn("x", layers)).select("photo_id", *[F.array_join(f"x.{c}", ",").alias(c) for c in ("subjects", "locations", "backgrounds", "weak")])


@query(f"{W}, l AS (SELECT photo_id, list_filter(list_transform(list_concat(objects, tags), lambda t: lower(trim(t))), lambda t: t <> '') AS l FROM photo) SELECT photo_id, array_to_string({_ONCE.format('l')}, ',') AS tags FROM l")
def merged_tags(spark, sf_dir):
    """Groups of tags, each tag once, in order."""
    return S.photos(spark, sf_dir).select("photo_id", F.array_join(text.merge_tags(F.col("objects"), F.array(F.lit(" "), F.lit(None).cast("string")), F.col("tags")), ",").alias("tags"))


@query(f"""{W} SELECT photo_id, lower(replace(city, '#', '')) AS label, round(least(greatest(coalesce(rating, 0) / 3.0::DOUBLE - 0.2::DOUBLE, 0), 1), 4)::DOUBLE AS score FROM photo WHERE city IS NOT NULL
 UNION ALL SELECT photo_id, 'low', 0.0::DOUBLE FROM photo""")
def clean_predictions(spark, sf_dir):
    """Labels that are too long or empty go, scores are held within 0 and 1."""
    number = (F.coalesce("rating", F.lit(0)) / F.lit(3.0) - F.lit(0.2)).cast("string")
    item = lambda label, score: F.struct(label.alias("label"), score.alias("score"))
    raw = F.array(item(F.coalesce("city", F.lit("!?")), number), item(F.lit(" LOW "), F.lit("much")), item(F.lit("x" * 81), F.lit("1")))
    return S.photos(spark, sf_dir).select("photo_id", F.inline(text.sanitize_predictions(raw)))


@query("SELECT p_partkey AS photo_id, upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] || ' ' || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] AS title, lower(p_brand[1:5]) || p_brand[7:] AS tag, p_name AS clean FROM part")
def text_values(spark, sf_dir):
    """X17, X19, X20."""
    p = S.read(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("photo_id"), text.title_case(F.regexp_replace("p_name", " ", "__")).alias("title"), text.sanitize_tag(F.concat(F.lit(" "), "p_brand")).alias("tag"), text.sanitize_text(F.concat(F.lit("\x00"), "p_name", F.lit(" ")), 100).alias("clean"))


@query("SELECT term FROM (SELECT DISTINCT lower(trim(term)) AS term FROM (SELECT r_name AS term FROM region UNION ALL SELECT replace(n_name, '_', ' ') FROM nation UNION ALL SELECT 'nation' UNION ALL SELECT unnest(string_split(replace(n_name, '_', ' '), ' ')) FROM nation UNION ALL SELECT unnest(string_split(r_name, ' ')) FROM region) WHERE length(term) >= 3)")
def place_terms(spark, sf_dir):
    """A21."""
    df = S.read(spark, sf_dir, "nation").join(F.broadcast(S.read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return Q.place_terms(df, ["n_name", "r_name"])


@query("SELECT DISTINCT lower(replace(n_name, '_', ' ')) AS term FROM nation WHERE n_name IN ('NATION_7', 'NATION_12')")
def known_terms(spark, sf_dir):
    """Terms of a vocabulary within a query."""
    return Q.known_terms("beach near Nation 7, nation 12s & NATION_12", S.read(spark, sf_dir, "nation"), "n_name")


@query(f"""WITH term AS (SELECT DISTINCT {_FOLD.format('n_name')} AS term FROM nation UNION SELECT {_FOLD.format('r_name')} FROM region UNION SELECT array_to_string(string_split({_FOLD.format('text')}, ' ')[1:5], ' ') FROM benchmark), said AS (SELECT doc_id, ' ' || {_FOLD.format("coalesce(text, '') || ' ' || n_name")} || ' ' AS words FROM documents LEFT JOIN nation ON n_nationkey = doc_id % 25)
SELECT doc_id, term FROM said, term WHERE term <> '' AND contains(words, ' ' || term || ' ')""")
def terms_of_queries(spark, sf_dir):
    """J13 for a table of queries: places, and the first five words of benchmark passages, in whole documents, each with
    a nation's name."""
    first = F.array_join(F.slice(F.split(text.normalize_phrase(F.col("text")), " "), 1, 5), " ")
    vocabulary = S.read(spark, sf_dir, "nation").select(F.col("n_name").alias("term")).unionByName(S.read(spark, sf_dir, "region").select(F.col("r_name").alias("term"))).unionByName(S.read(spark, sf_dir, "benchmark").select(first.alias("term")))
    docs = S.read(spark, sf_dir, "documents").join(F.broadcast(S.read(spark, sf_dir, "nation")), F.col("n_nationkey") == F.col("doc_id") % 25, "left")
    return Q.terms_of(docs.withColumn("said", F.concat_ws(" ", "text", "n_name")), vocabulary, "doc_id", "said")


@query("SELECT term, string_agg(DISTINCT person_id, ',' ORDER BY person_id) AS ids FROM (SELECT 'p' || c_custkey AS person_id, unnest(['customer ' || c_nationkey, 'customer']) AS term FROM customer WHERE c_custkey % 5 <> 0) GROUP BY 1")
def person_index(spark, sf_dir):
    """A22."""
    c = S.read(spark, sf_dir, "customer")
    people = c.select(F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("person_id"), F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("Customer#"), F.col("c_nationkey").cast("string"))).alias("name"))
    return Q.person_index(people).select("term", F.array_join("ids", ",").alias("ids"))


@query("""SELECT key, label, round(p, 9) AS p, rank FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY p DESC, label) AS rank FROM (SELECT user_id AS key, event_id AS label, exp(value / 10 - max(value / 10) OVER (PARTITION BY user_id)) / sum(exp(value / 10 - m)) OVER (PARTITION BY user_id) AS p
FROM (SELECT *, max(value / 10) OVER (PARTITION BY user_id) AS m FROM events))) WHERE rank <= 15""")
def softmax_top(spark, sf_dir):
    """15 labels is the feature."""
    e = S.read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("label"), (F.col("value") / 10).alias("logit"))
    return ranking.top_softmax(e, "key", "label", "logit").select("key", "label", F.round("p", 9).alias("p"), "rank")


def _term(column: str, token: str) -> str:
    import re

    forms = [re.escape(v) for v in text.token_variants(token)] + ([re.escape(token) + "[a-z0-9]*"] if len(token) >= 4 else [])
    return f"regexp_matches({column}, '\\b({'|'.join(forms)})\\b')"


def lexical_sql(q: Q.Query) -> str:
    """The score by the rules, written apart from the Column form: a gate, and a sum of CASEs."""
    gate, parts = ["TRUE"], [3.0 if q.subject and q.location else 0.0]
    has = lambda w: f"list_contains(tags, '{w}')"
    gate += [_term("place", w) for w in q.location]
    if q.thing:
        tagged = f"list_has_any(tags, {text.token_variants(q.thing)})"
        gate.append(f"({tagged} OR {_term('subject', q.thing)})")
        parts += [f"CASE WHEN {tagged} THEN 6.0 ELSE 3.5 END", f"CASE WHEN {has(q.modifier)} THEN 3.0 WHEN {_term('subject', q.modifier)} THEN 1.5 ELSE 0 END", f"CASE WHEN {has(q.modifier)} OR {_term('subject', q.modifier)} THEN 12.0 ELSE 0 END"]
        parts += [f"CASE WHEN contains(subject, '{Q.normalize(p)}') THEN 5.0 ELSE 0 END" for p in q.phrases]
    one = lambda w, a, b, c, d: f"CASE WHEN {has(w)} THEN {a} WHEN {_term('subject', w)} THEN {b} ELSE 0 END + CASE WHEN {_term('semantic', w)} THEN {c} ELSE 0 END + CASE WHEN {_term('place', w)} THEN {d} ELSE 0 END"
    parts += [one(w, 3.0, 1.5, 2.0, 2.5) for w in q.words]
    more = " + ".join(one(w, 1.0, 0.7, 0.8, 0.8) for w in q.expanded) or "0"
    return f"CASE WHEN {' AND '.join(gate)} THEN ({' + '.join(map(str, parts))} + least({more}, 5.0))::DOUBLE ELSE 0.0 END"


#: Queries over photos: words, a place, and a color with a thing.
SEARCHES = {"search_words": "widgets and rings", "search_place": "bolt in economy", "search_context": "red ring", "search_filler": "gear color blue"}
_SAID = "array_to_string(list_sort(candidates), ' ')"
_FIELDS = f"""{_EFFECTIVE}, f0 AS (SELECT *, {_token(_SAID)} AS semantic, {_token('filename')} AS fname, {_token("concat_ws(' ', address, city, country, array_to_string(etags, ' '))")} AS place,
 lower(concat_ws(' ', filename, {_SAID}, array_to_string(objects, ' '), address, city, country, array_to_string(tags, ' '))) AS raw FROM e),
f AS (SELECT photo_id, people, cap_date, etags AS tags, semantic, fname || ' ' || semantic || ' ' AS subject, place, raw, {_FOLD.format("concat_ws(' ', address, city, country)")} AS spot FROM f0)"""


def _searchable(spark, sf_dir):
    none = F.lit(None).cast("string")
    return _effective(spark, sf_dir).withColumns({"caption": none, "ocr_text": none, "model": none, "names": F.array().cast("array<string>")})


def _found_sql(q: Q.Query, where: str = "TRUE", extra: str = "0.0", join: str = "") -> str:
    """P2's choice of rows: what is over the cut and says the modifier, or else all."""
    s = f"{_FIELDS}, s AS (SELECT f.photo_id, {lexical_sql(q)} AS lexical, {extra} AS more, contains(raw, '{q.modifier}') AS said FROM f {join} WHERE {where}), g AS (SELECT photo_id, lexical + more AS score, lexical, NOT said OR lexical < {Q.CONTEXT_CUT} AS low FROM s WHERE lexical + more > 0)"
    cut = "lexical > 0 AND (NOT low OR NOT EXISTS (SELECT 1 FROM g WHERE lexical > 0 AND NOT low))" if q.thing else "TRUE"
    return f"{s} SELECT photo_id, round(score, 6) AS score FROM g WHERE {cut}"


for _name, _text in SEARCHES.items():

    def _search(spark, sf_dir, words=_text):
        rows, q = Q.search_fields(_searchable(spark, sf_dir)), Q.parse(words)
        lexical = Q.lexical_score(q, *(F.col(c) for c in ("effective", "__subject", "__semantic", "__place")))
        said = F.col("__raw").contains(q.modifier) if q.thing else F.lit(True)
        return Q.hybrid(rows.select("photo_id", lexical.alias("lexical"), said.alias("said")), q, None).select("photo_id", F.round("score", 6).alias("score"))

    _search.__name__, _search.__doc__ = _name, f"P1: '{_text}' over all photos, without people, places and vectors."
    query(_found_sql(Q.parse(_text)))(_search)


@functools.cache
def _probe(sf_dir: str, spark) -> list[float]:
    return [float(x) for x in S.read(spark, sf_dir, "embeddings").where("vec_id = 0").first().embedding]


_COS = "list_dot_product(embedding::DOUBLE[], q::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))"


@query(f"SELECT vec_id, round({_COS}, 6) AS semantic FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) ORDER BY {_COS} DESC, vec_id LIMIT 500")
def vector_search(spark, sf_dir):
    """Candidates of one query vector; their number is the feature."""
    top = Q.vector_top(S.read(spark, sf_dir, "embeddings"), _probe(sf_dir, spark), Q.candidates(20), "vec_id")
    return top.select("vec_id", F.round("semantic", 6).alias("semantic"))


_SIM = f"(SELECT vec_id AS photo_id, {_COS} AS sim FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) ORDER BY sim DESC, photo_id LIMIT 500)"
_CLOSE = "CASE WHEN sim >= 0.16 THEN sim * 10 ELSE 0.0 END"
_ASKED = "red rings with Ann in Economy"


def _top(spark, sf_dir):
    return Q.vector_top(S.read(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "photo_id"), _probe(sf_dir, spark), Q.candidates(20))


@query(_found_sql(Q.parse("widgets and rings"), "TRUE", _CLOSE, f"LEFT JOIN {_SIM} v ON f.photo_id = v.photo_id"))
def hybrid_search(spark, sf_dir):
    """Words and vectors; the vector of a photo is that of its number."""
    return Q.search_photos(_searchable(spark, sf_dir), "widgets and rings", None, _top(spark, sf_dir)).select("photo_id", F.round("score", 6).alias("score"))


@query(_found_sql(Q.parse(_ASKED), "list_has_any(people, ['p1', 'p4']) AND contains(spot, 'economy') AND cap_date BETWEEN DATE '2020-06-03' AND DATE '2020-07-15'", f"8.0 + 5.0 + {_CLOSE}", f"LEFT JOIN {_SIM} v ON f.photo_id = v.photo_id"))
def people_place_search(spark, sf_dir):
    """P2 with F2, F5, F6, J13 and A22: a color with a thing, a name of two people, a place and dates."""
    people = spark.createDataFrame([("p1", "Ann Ek"), ("p2", "Bo  Li"), ("p3", "Unnamed 3"), ("p4", "ann"), ("p5", "")], "person_id string, name string")
    return Q.search_photos(_searchable(spark, sf_dir), _ASKED, people, _top(spark, sf_dir), "2020-06-03", "2020-07-15").select("photo_id", F.round("score", 6).alias("score"))


@query()
def hashed_embeddings(spark, sf_dir):
    """Vectors of texts without a model, under a version of their own: length, digest, and likeness to the next text
    in the order of doc_id (after the last, the first)."""
    df = ranking.dealt(S.read(spark, sf_dir, "documents").select("doc_id", "text", F.xxhash64("text").alias("order")), "doc_id", "order")
    df = computed_once(df.select("doc_id", "order", text.hashed_embedding(F.col("text")).alias("v")))
    df = df.select("doc_id", "order", F.lit(text.HASHED_VERSION).alias("version"), F.size("v").alias("size"), F.round(vectors.norm(F.col("v")), 6).alias("len"), F.sha2(F.to_json("v"), 256).alias("digest"), "v")
    return ranking.like_next(df, "doc_id", "order", "v", "near_next").withColumn("near_next", F.round("near_next", 6))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'k=' || json_extract_string(props, '$.k') ELSE '' END AS entries FROM events")
def json_maps(spark, sf_dir):
    """Malformed JSON reads as empty."""
    raw = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.concat(F.lit("{bad"), "props"))
    parsed = F.coalesce(F.from_json(raw, "map<string,string>"), F.create_map().cast("map<string,string>"))
    pairs = F.transform(F.map_entries(files.trim_entries(parsed)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return S.read(spark, sf_dir, "events").select("event_id", F.array_join(pairs, ",").alias("entries"))
