"""Vectors, faces, people and their maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from albumen.functions import media, vectors
from albumen.operators import maintenance as X
from albumen.operators import people as P
from albumen.operators import recluster as R
from albumen.plans import standins as S
from albumen.plans.registry import query
from albumen.sources import files, tables

WF, WP = "WITH " + S.FACES, "WITH " + S.PEOPLE
#: The given vectors are far apart: thresholds here are lower than the defaults, so that there is something to find.
LEAST, EPS = 0.40, 0.60
_DOT = "list_dot_product({a}, {b})"
_PAIRS = f"u AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings), pair AS (SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.v, b.v) AS similarity FROM u a JOIN u b ON a.vec_id < b.vec_id WHERE list_dot_product(a.v, b.v) >= {LEAST})"


@query(f"WITH {_PAIRS} SELECT a, b, round(similarity, 6) AS similarity FROM pair")
def similar_pairs(spark, sf_dir):
    """J10."""
    rows = P.similar_pairs(S.read(spark, sf_dir, "embeddings"), "vec_id", "embedding", LEAST)
    return rows.select("a", "b", F.round("similarity", 6).alias("similarity"))


_COMP = f"WITH RECURSIVE {_PAIRS}, e AS (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair), r AS (SELECT vec_id AS n, vec_id AS o FROM embeddings UNION SELECT e.b, r.o FROM r JOIN e ON r.n = e.a), comp AS (SELECT n AS vec_id, min(o) AS cluster FROM r GROUP BY n)"


@query(_COMP + " SELECT * FROM comp")
def face_clusters(spark, sf_dir):
    """Two samples, so components of the graph of near vectors; noise alone."""
    return P.dbscan(S.read(spark, sf_dir, "embeddings"), "vec_id", "embedding", EPS)


@query(f"""WITH RECURSIVE {_PAIRS}, e AS (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair), core AS (SELECT a FROM e GROUP BY a HAVING count(*) + 1 >= 4), ce AS (SELECT e.a, e.b FROM e JOIN core x ON e.a = x.a JOIN core y ON e.b = y.a),
r AS (SELECT a AS n, a AS o FROM core UNION SELECT ce.b, r.o FROM r JOIN ce ON r.n = ce.a), c AS (SELECT n AS vec_id, min(o) AS cluster FROM r GROUP BY n), bd AS (SELECT e.a AS vec_id, min(cluster) AS cluster FROM e JOIN c ON e.b = c.vec_id WHERE e.a NOT IN (SELECT vec_id FROM c) GROUP BY 1)
SELECT vec_id, coalesce(c.cluster, bd.cluster, vec_id) AS cluster FROM embeddings LEFT JOIN c USING (vec_id) LEFT JOIN bd USING (vec_id)""")
def face_clusters_dense(spark, sf_dir):
    """P4 with four samples: cores, and border points."""
    return P.dbscan(S.read(spark, sf_dir, "embeddings"), "vec_id", "embedding", EPS, 4)


@query()
def refined_clusters(spark, sf_dir):
    """P5: clusters cut by diameter; the greedy order is beyond SQL."""
    e = S.read(spark, sf_dir, "embeddings")
    return P.refine(P.dbscan(e, "vec_id", "embedding", EPS), e, "vec_id", "embedding", 0.62)


@query(f"""{WF}, w AS (SELECT person_id, embedding, greatest(0.05, CASE WHEN confirmed THEN greatest(c, 1.0) WHEN review = 'suspicious' OR confidence < 0.6 THEN least(c, 0.35) ELSE c END)::DOUBLE AS w FROM (SELECT *, CASE WHEN confidence = 0 THEN 0.5 ELSE confidence END AS c FROM face) WHERE NOT rejected AND person_id IS NOT NULL),
 x AS (SELECT person_id, w, embedding, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM w), m AS (SELECT person_id, i, sum(x * w) / sum(w) AS x FROM x GROUP BY 1, 2), m1 AS (SELECT person_id, list(x ORDER BY i) AS m FROM m GROUP BY 1),
 n AS (SELECT w.person_id, embedding, w * least(1.0, greatest(0.1, list_dot_product(embedding, m1.m) / (sqrt(list_dot_product(m1.m, m1.m)) + 1e-12) / (sqrt(list_dot_product(embedding, embedding)) + 1e-12))) AS w FROM w JOIN m1 USING (person_id)),
 y AS (SELECT person_id, w, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM n), z AS (SELECT person_id, i, sum(x * w) / sum(w) AS x FROM y GROUP BY 1, 2), l AS (SELECT person_id, sqrt(sum(x * x)) AS len FROM z GROUP BY 1)
SELECT person_id, (i - 1)::INT AS i, round(x / (len + 1e-12), 6) AS x FROM z JOIN l USING (person_id)""")
def representative_vectors(spark, sf_dir):
    """A11."""
    reps = P.representatives(S.faces(spark, sf_dir).where("person_id is not null"))
    return reps.select("person_id", F.posexplode("rep").alias("i", "x")).withColumn("x", F.round("x", 6))


@query(f"""{WF}, s AS (SELECT face_id, label_id AS person_id, round(list_dot_product(f.embedding, c.v), 9) AS score FROM face f, (SELECT 'p' || label AS label_id, first(embedding::DOUBLE[] ORDER BY vec_id) AS v FROM embeddings GROUP BY 1) c),
r AS (SELECT *, row_number() OVER (PARTITION BY face_id ORDER BY score DESC, person_id) AS k, lead(score) OVER (PARTITION BY face_id ORDER BY score DESC, person_id) AS second FROM s)
SELECT face_id, person_id, round(score, 6) AS score, round(second, 6) AS second, score >= 0.2 AND score - second >= 0.05 AS accepted FROM r WHERE k = 1""")
def best_match(spark, sf_dir):
    """Each face against one vector per person."""
    f = S.faces(spark, sf_dir)
    first = S.read(spark, sf_dir, "embeddings").groupBy(F.concat(F.lit("p"), F.col("label").cast("string")).alias("person_id")).agg(F.min_by("embedding", "vec_id").alias("v"))
    out = P.best_match(P.scores_of(f.select("face_id", "embedding"), first, "face_id", "embedding", "v"), "face_id", 0.2, 0.05)
    return out.withColumns({c: F.round(c, 6) for c in ("score", "second")})


@query(f"""{_COMP}, {S.FACES}, v AS (SELECT cluster, person_id, count(*) AS votes FROM comp JOIN face ON vec_id = pos WHERE person_id IS NOT NULL GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY votes DESC, person_id) AS rank FROM v""")
def overlap_vote(spark, sf_dir):
    """A12."""
    clusters = P.dbscan(S.read(spark, sf_dir, "embeddings"), "vec_id", "embedding", EPS).withColumnRenamed("vec_id", "pos")
    return P.overlap_vote(clusters, S.faces(spark, sf_dir), "pos")


@query(f"{WP} SELECT m.person_id, count(*) AS faces, count(*) FILTER (confirmed) AS confirmed_faces, first(f.face_id ORDER BY confirmed DESC, confidence DESC, pos) AS face_id FROM member m JOIN face f ON m.face_id = f.face_id AND m.person_id = f.person_id WHERE NOT rejected GROUP BY 1")
def representative_faces(spark, sf_dir):
    """J2, A9, A10."""
    return P.representative_faces(P.active_faces(S.people(spark, sf_dir), S.faces(spark, sf_dir)))


_DUPLICATE = f"""{S.FACES}, box AS (SELECT *, pos % 30 AS x, pos % 20 AS y FROM face),
ident AS (SELECT *, 'face-v1-' || left(sha256('{{"filename":"' || filename || '","height":' || least(h, 90 - y) || ',"imageHeight":90,"imageWidth":100,"left":' || x || ',"top":' || y || ',"userId":"' || library_id || '","v":1,"width":' || least(w, 100 - x) || '}}'), 40) AS stored FROM (SELECT *, pos % 6 * 20 + 1 AS w, pos % 5 * 20 + 1 AS h FROM box)),
renamed AS (SELECT *, CASE WHEN pos % 240 < 120 THEN face_id ELSE stored END AS own_id FROM ident)"""


def _boxed(spark, sf_dir):
    """Faces of which those 240 apart have one box, every other one under its deterministic id."""
    k = F.col("pos")
    f = S.faces(spark, sf_dir).withColumns({"left": k % 30, "top": k % 20, "width": k % 6 * 20 + 1, "height": k % 5 * 20 + 1})
    stored = media.face_id(*(F.col(c) for c in ("library_id", "filename", "left", "top", "width", "height", "image_width", "image_height")))
    return f.withColumn("face_id", F.when(k % 240 < 120, F.col("face_id")).otherwise(stored))


@query(f"WITH {_DUPLICATE} SELECT library_id, stored AS face_id, count(*) AS copies, count(*) FILTER (own_id <> stored) AS deleted, first(own_id ORDER BY confirmed DESC, person_id IS NOT NULL DESC, confidence DESC, starts_with(own_id, 'face-v1-') DESC, own_id) AS canonical, min(filename) AS filename, first(person_id ORDER BY confirmed DESC, person_id IS NOT NULL DESC, confidence DESC, starts_with(own_id, 'face-v1-') DESC, own_id) AS person_id, max(confidence)::DOUBLE AS confidence, bool_or(confirmed) AS confirmed FROM renamed GROUP BY 1, 2 HAVING count(*) > 1")
def face_dedupe(spark, sf_dir):
    """A13, P14."""
    return P.dedupe_faces(_boxed(spark, sf_dir), "pos")


@query(f"""{WF}, l AS (SELECT pos, face_id, CASE WHEN pos % 11 = 0 THEN 'p4' ELSE person_id END AS person_id FROM face WHERE person_id IS NOT NULL AND person_id <> 'p8' AND pos % 13 <> 0),
 entry AS (SELECT person_id, face_id FROM l UNION ALL SELECT person_id, face_id FROM l WHERE pos % 17 = 0 UNION ALL SELECT DISTINCT person_id, 'gone' || person_id FROM l UNION ALL SELECT 'ghost', 'f999999'),
 once AS (SELECT e.person_id, face_id, count(*) - 1 AS again, CASE WHEN any_value(f.face_id) IS NULL THEN 'missing' WHEN bool_or(f.rejected) THEN 'rejected' WHEN e.person_id IS DISTINCT FROM any_value(f.person_id) THEN 'stale' ELSE 'kept' END AS what, any_value(f.filename) AS filename FROM entry e LEFT JOIN face f USING (face_id) GROUP BY 1, 2),
 owned AS (SELECT f.person_id, f.face_id, f.filename, CASE WHEN f.person_id NOT IN (SELECT person_id FROM entry) THEN 'orphan' WHEN (f.person_id, f.face_id) IN (SELECT (person_id, face_id) FROM once WHERE what = 'kept') THEN 'kept' ELSE 'added' END AS what FROM face f WHERE NOT rejected AND f.person_id IS NOT NULL)
SELECT (SELECT count(DISTINCT person_id) FROM entry) AS scanned_people, (SELECT count(*) FROM face) AS scanned_faces,
 (SELECT count(DISTINCT person_id) FROM (SELECT person_id FROM once WHERE what <> 'kept' OR again > 0 UNION ALL SELECT person_id FROM owned WHERE what = 'added')) AS changed_people,
 (SELECT count(DISTINCT person_id) FROM entry WHERE person_id NOT IN (SELECT person_id FROM once WHERE what = 'kept' UNION ALL SELECT person_id FROM owned WHERE what = 'added')) AS deleted_people,
 (SELECT sum(again)::BIGINT FROM once) AS duplicate_faces, (SELECT count(*) FROM once WHERE what = 'missing') AS missing_faces, (SELECT count(*) FROM once WHERE what = 'rejected') AS rejected_faces, (SELECT count(*) FROM once WHERE what = 'stale') AS stale_faces,
 (SELECT count(*) FROM owned WHERE what = 'added') AS added_faces, (SELECT count(*) FROM owned WHERE what = 'orphan') AS orphan_faces, (SELECT count(DISTINCT filename) FROM (SELECT filename FROM once UNION ALL SELECT filename FROM owned)) AS affected_files""")
def repair_report(spark, sf_dir):
    """What a repair would change, over lists with strangers, repeats, gaps and a person of nobody."""
    f = S.faces(spark, sf_dir)
    lists = f.where("person_id is not null and person_id <> 'p8' and pos % 13 <> 0").select(F.when(F.col("pos") % 11 == 0, "p4").otherwise(F.col("person_id")).alias("person_id"), F.explode(F.when(F.col("pos") % 17 == 0, F.array("face_id", "face_id")).otherwise(F.array("face_id"))).alias("face_id"))
    people = lists.groupBy("person_id").agg(F.collect_list("face_id").alias("face_ids")).withColumn("face_ids", F.concat("face_ids", F.array(F.concat(F.lit("gone"), "person_id"), F.lit(""))))
    ghost = people.sparkSession.createDataFrame([("ghost", ["f999999"])], people.schema)
    return P.repair_report(people.unionByName(ghost), f)


@query(f"{WP} SELECT m.person_id, m.face_id FROM member m WHERE face_id NOT IN (SELECT face_id FROM face)")
def dangling_members(spark, sf_dir):
    """J9."""
    listed = S.people(spark, sf_dir).select("person_id", F.explode("face_ids").alias("face_id"))
    return listed.join(S.faces(spark, sf_dir).select("face_id"), "face_id", "left_anti").select("person_id", "face_id")


@query(f"{WP} SELECT face_id FROM face WHERE person_id IS NOT NULL AND person_id NOT IN (SELECT person_id FROM person)")
def orphan_faces(spark, sf_dir):
    """J8."""
    return S.faces(spark, sf_dir).where("person_id is not null").join(S.people(spark, sf_dir), "person_id", "left_anti").select("face_id")


@query(f"""{WF} SELECT face_id, rejected, confirmed, NOT confirmed AND NOT rejected AND (review = 'suspicious' OR confidence < 0.6) AS suspicious, NOT rejected AND (confirmed OR (review <> 'suspicious' AND confidence >= 0.6)) AS clusterable,
 confidence >= 0.24 AND (confidence >= 0.32 OR (width * height / 9000.0 <= 0.08 AND greatest(width / 100.0, height / 90.0) <= 0.42)) AS stored FROM face""")
def face_states(spark, sf_dir):
    """F12, F13."""
    ok = media.face_passes(*(F.col(c) for c in ("confidence", "width", "height", "image_width", "image_height")))
    return S.faces(spark, sf_dir).select("face_id", P.rejected().alias("rejected"), P.confirmed().alias("confirmed"), P.suspicious().alias("suspicious"), P.clusterable().alias("clusterable"), ok.alias("stored"))


@query(f"""{WF}, p AS (SELECT DISTINCT person_id, CASE WHEN substr(person_id, 2)::INT % 3 <> 0 THEN 'Ann ' || person_id ELSE '' END AS name FROM face WHERE person_id IS NOT NULL AND person_id <> 'p8')
SELECT filename, string_agg(face_id, ',' ORDER BY face_id) AS faces, count(*) AS face_count, coalesce(string_agg(DISTINCT name, ',' ORDER BY name) FILTER (name <> ''), '') AS names FROM face LEFT JOIN p USING (person_id) WHERE NOT rejected GROUP BY filename""")
def photo_people(spark, sf_dir):
    """P15."""
    rows = X.photo_people(S.faces(spark, sf_dir), S.people(spark, sf_dir))
    return rows.select("filename", F.array_join("faces", ",").alias("faces"), "face_count", F.array_join("names", ",").alias("names"))


_ALIKE = 0.25
_PERSONS = f"""who AS (SELECT vec_id, 'lib' || (vec_id % 4) AS library_id, 'v' || lpad(vec_id::VARCHAR, 6, '0') AS person_id, CASE WHEN vec_id % 3 = 0 THEN 'Ann' ELSE '' END AS name, vec_id % 7 AS faces, 'v' || lpad((vec_id + 4)::VARCHAR, 6, '0') AS declined, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings)"""


def _persons(spark, sf_dir):
    """Every vector a person of one of four libraries, who has declined the next one."""
    k, name = F.col("vec_id"), lambda n: F.concat(F.lit("v"), F.lpad(n.cast("string"), 6, "0"))
    return S.read(spark, sf_dir, "embeddings").select(F.concat(F.lit("lib"), (k % 4).cast("string")).alias("library_id"), name(k).alias("person_id"), F.when(k % 3 == 0, "Ann").otherwise("").alias("name"), (k % 7).alias("faces"), F.col("embedding").alias("rep"), F.array(name(k + 4)).alias("declined"))


@query(f"""WITH {_PERSONS}, pair AS (SELECT a.library_id, CASE WHEN w THEN b.person_id ELSE a.person_id END AS source, CASE WHEN w THEN a.person_id ELSE b.person_id END AS target, s AS similarity FROM
 (SELECT a, b, list_dot_product(a.v, b.v) AS s, CASE WHEN (a.name <> '') <> (b.name <> '') THEN a.name <> '' WHEN a.faces <> b.faces THEN a.faces > b.faces ELSE TRUE END AS w FROM who a JOIN who b ON a.library_id = b.library_id AND a.person_id < b.person_id WHERE a.declined <> b.person_id AND b.declined <> a.person_id) WHERE s >= {_ALIKE})
SELECT library_id, source, target, round(similarity, 6) AS similarity FROM pair""")
def merge_suggestions(spark, sf_dir):
    """A library's people who are alike, with who is merged into whom."""
    return P.suggestion_pairs(_persons(spark, sf_dir), _ALIKE).withColumn("similarity", F.round("similarity", 6))


@query()
def suggestion_report(spark, sf_dir):
    """At most 20 suggestions a library and two a source; the greedy order is beyond SQL."""
    return P.suggestion_report(_persons(spark, sf_dir), _ALIKE).withColumn("similarity", F.round("similarity", 6))


@query()
def incremental_assignment(spark, sf_dir):
    """P10: each library's later faces go to its earlier people or become people; decided in order."""
    f = S.faces(spark, sf_dir)
    people = _persons(spark, sf_dir).where(F.substring("person_id", 2, 9).cast("int") < 40).select("library_id", "person_id", "rep")
    return P.assign_incrementally(f.where("pos >= 40"), people, 0.3, 0.02)


#: People of whom those without a name are `Unnamed n`; and a face after a user has confirmed it.
_CALLED = WP + ", called AS (SELECT person_id, CASE WHEN name = '' THEN 'Unnamed ' || substr(person_id, 2) ELSE name END AS name, face_ids FROM person)"


def _sure(hit: str, owner: str) -> str:
    return f"SELECT face_id, CASE WHEN {hit} THEN {owner} ELSE person_id END AS person_id, {hit} OR confirmed AS confirmed, rejected AND NOT ({hit}) AS rejected, CASE WHEN {hit} THEN 'confirmed' ELSE review END AS review, CASE WHEN {hit} THEN greatest(confidence, 1.0) ELSE confidence END::DOUBLE AS confidence FROM face"


def _called(spark, sf_dir):
    p = S.people(spark, sf_dir)
    return p.withColumn("name", F.when(F.col("name") == "", F.concat(F.lit("Unnamed "), F.substring("person_id", 2, 9))).otherwise(F.col("name")))


def _lists(people):
    return people.select("person_id", "name", F.array_join(F.array_sort("face_ids"), ",").alias("face_ids"))


def _reviewed(faces):
    return faces.select("face_id", "person_id", "confirmed", "rejected", "review", F.col("confidence").cast("double").alias("confidence"))


_MOVED = "SELECT face_id FROM member WHERE person_id IN ('p5', 'p6') AND face_id IN (SELECT face_id FROM face WHERE NOT rejected)"


@query(f"""{_CALLED} SELECT person_id, name, array_to_string(list_sort(face_ids), ',') AS face_ids FROM called WHERE person_id NOT IN ('p3', 'p5', 'p6') UNION ALL
SELECT 'p3', (SELECT name FROM called WHERE person_id IN ('p5', 'p6') AND NOT starts_with(name, 'Unnamed') ORDER BY len(face_ids) DESC LIMIT 1), (SELECT string_agg(face_id, ',' ORDER BY face_id) FROM (SELECT face_id FROM member WHERE person_id = 'p3' UNION {_MOVED}))""")
def merge_people(spark, sf_dir):
    """Two people merged into an unnamed third, which takes a name; rejected and missing faces are not taken over."""
    return _lists(X.merge_people(_called(spark, sf_dir), S.faces(spark, sf_dir), "p3", ["p5", "p6"])[0])


@query(f"{_CALLED} {_sure(f'face_id IN ({_MOVED})', chr(39) + 'p3' + chr(39))}")
def merged_faces(spark, sf_dir):
    """The faces that were taken over are the third's, and confirmed."""
    return _reviewed(X.merge_people(_called(spark, sf_dir), S.faces(spark, sf_dir), "p3", ["p5", "p6"])[1])


@query(f"{WP} SELECT person_id, name, array_to_string(list_sort(face_ids), ',') AS face_ids FROM person")
def merge_undone(spark, sf_dir):
    """A merge and its undo give the people back."""
    people, faces = S.people(spark, sf_dir), S.faces(spark, sf_dir)
    merged, moved, undo = X.merge_people(people, faces, "p3", ["p5", "p6"])
    back, _ = X.undo_merge(merged, moved, undo)
    return back.select("person_id", "name", F.array_join(F.array_sort("face_ids"), ",").alias("face_ids"))


_TAKEN = "SELECT face_id FROM face WHERE person_id = 'p1' AND confidence < 0.4"


@query(f"""{_CALLED}, took AS (SELECT list(face_id) AS took FROM ({_TAKEN}))
SELECT person_id, name, array_to_string(list_sort(list_filter(face_ids, lambda x: NOT (person_id = 'p1' AND list_contains(took, x)))), ',') AS face_ids FROM called, took UNION ALL
SELECT 'p1b', 'Unnamed ' || (SELECT max(substr(name, 9)::INT) + 1 FROM called WHERE starts_with(name, 'Unnamed')), array_to_string(list_sort(took), ',') FROM took""")
def split_person(spark, sf_dir):
    """Some faces become a person of their own, under the next number."""
    f = S.faces(spark, sf_dir)
    return _lists(X.split_person(_called(spark, sf_dir), f, "p1", f.where("confidence < 0.4").select("face_id"), "p1b")[0])


@query(f"{_CALLED} {_sure(f'face_id IN ({_TAKEN})', chr(39) + 'p1b' + chr(39))}")
def split_faces(spark, sf_dir):
    """And are confirmed."""
    f = S.faces(spark, sf_dir)
    return _reviewed(X.split_person(_called(spark, sf_dir), f, "p1", f.where("confidence < 0.4").select("face_id"), "p1b")[1])


_ASKED_FOR = "SELECT face_id FROM face WHERE pos % 9 = 7"


@query(f"""{_CALLED}, entry AS (SELECT person_id, face_id FROM member WHERE person_id = 'p2' OR face_id NOT IN ({_ASKED_FOR}) UNION
  SELECT 'p2', face_id FROM face WHERE pos % 9 = 7 AND NOT rejected AND (confirmed OR (review <> 'suspicious' AND confidence >= 0.6)))
SELECT person_id, any_value(name) AS name, string_agg(face_id, ',' ORDER BY face_id) AS face_ids FROM entry JOIN called USING (person_id) GROUP BY 1""")
def confirmed_people(spark, sf_dir):
    """Faces confirmed as a person's leave all other lists; rejected and suspicious ones are not listed."""
    f = S.faces(spark, sf_dir)
    return _lists(X.confirm_faces(_called(spark, sf_dir), f, "p2", f.where("pos % 9 = 7").select("face_id"))[0])


@query(f"{_CALLED}, label AS (SELECT face_id FROM member WHERE person_id = 'p4'), first AS ({_sure('pos % 9 = 7', chr(39) + 'p2' + chr(39))}), face2 AS (SELECT * FROM first) {_sure('face_id IN (FROM label)', 'person_id').replace('FROM face', 'FROM face2')}".replace("IN (FROM label)", "IN (SELECT face_id FROM label)"))
def confirmed_faces(spark, sf_dir):
    """Faces confirmed one by one, and those of a person who gets a name."""
    p, f = _called(spark, sf_dir), S.faces(spark, sf_dir)
    _, f = X.confirm_faces(p, f, "p2", f.where("pos % 9 = 7").select("face_id"))
    return _reviewed(X.label_person(p, f, "p4", "Zoe")[1])


@query(f"{WP} SELECT person_id, name, (SELECT count(*) FROM face f WHERE f.person_id = person.person_id AND NOT rejected) AS n FROM person")
def repaired_lists(spark, sf_dir):
    """Lists as the faces have it; a second repair changes nothing."""
    f = S.faces(spark, sf_dir)
    people = X.repair_lists(X.repair_lists(S.people(spark, sf_dir), f), f)
    return people.select("person_id", "name", F.size("face_ids").cast("long").alias("n"))


@query(f"""{WP}, plan AS (SELECT face_id, CASE WHEN pos % 2 = 0 THEN 'new' ELSE 'p2' END AS to_id FROM face WHERE pos % 7 = 0 OR person_id = 'p5'), can AS (SELECT face_id FROM face WHERE NOT rejected AND (confirmed OR (review <> 'suspicious' AND confidence >= 0.6))),
 moved AS (SELECT * FROM plan WHERE face_id IN (SELECT face_id FROM can)), given AS (SELECT to_id AS person_id, CASE WHEN to_id = 'new' THEN 'Newcomer' ELSE 'Ann p2' END AS name, string_agg(face_id, ',' ORDER BY face_id) AS face_ids FROM plan GROUP BY 1),
 rest AS (SELECT person_id, name, face_id, i FROM (SELECT person_id, name, unnest(face_ids) AS face_id, generate_subscripts(face_ids, 1) AS i FROM person WHERE person_id NOT IN ('new', 'p2')) WHERE face_id NOT IN (SELECT face_id FROM moved)),
 alive AS (SELECT f.face_id, coalesce(to_id, person_id) AS owner FROM face f LEFT JOIN moved m ON f.face_id = m.face_id WHERE NOT rejected)
SELECT * FROM given UNION ALL SELECT r.person_id, any_value(name), string_agg(r.face_id, ',' ORDER BY i) FROM rest r LEFT JOIN alive a USING (face_id) GROUP BY 1 HAVING count(*) FILTER (a.owner = r.person_id) > 0""")
def applied_plan(spark, sf_dir):
    """A plan of two people, which takes all it can of a third."""
    f = S.faces(spark, sf_dir)
    plan = f.where("pos % 7 = 0 or person_id = 'p5'").select("face_id", F.when(F.col("pos") % 2 == 0, "new").otherwise("p2").alias("person_id"))
    planned = plan.groupBy("person_id").agg(F.array_sort(F.collect_list("face_id")).alias("face_ids")).withColumn("name", F.when(F.col("person_id") == "new", "Newcomer").otherwise(""))
    people, _ = X.apply_plan(S.people(spark, sf_dir), f, planned, plan)
    return people.select("person_id", "name", F.array_join("face_ids", ",").alias("face_ids"))


def _library_people(spark, sf_dir):
    """Faces whose person is one of their library, and those people."""
    f = S.faces(spark, sf_dir).withColumn("person_id", F.concat("library_id", "person_id"))
    people = f.where("person_id is not null and pos % 3 <> 0").groupBy("library_id", "person_id").agg(F.array_sort(F.collect_list("face_id")).alias("face_ids"))
    return people.withColumn("name", F.when(F.col("person_id").endswith("3"), "").otherwise(F.col("person_id"))), f


@query()
def recluster_plan(spark, sf_dir):
    """What clustering anew would make of each library; the order of choices is beyond SQL."""
    people, f = _library_people(spark, sf_dir)
    assignments, _ = R.recluster_plan(f, people, "loose")
    return assignments


@query(f"{WF} SELECT face_id, what FROM (SELECT face_id, 'x' AS what FROM face) WHERE FALSE")
def cluster_job(spark, sf_dir):
    """All faces clustered; no candidate is without an owner, and none has two."""
    people, f = _library_people(spark, sf_dir)
    return R.cluster_job(f, people, "loose")[2]


@query(f"{WF} SELECT face_id, 'missing' AS what FROM face WHERE pos % 10 = 0 UNION ALL SELECT face_id, 'extra' FROM face WHERE pos % 25 = 1")
def assignment_check(spark, sf_dir):
    """What a complete assignment lacks or has too often."""
    f = S.faces(spark, sf_dir)
    return X.incomplete(f, f.where("pos % 10 <> 0").unionByName(f.where("pos % 25 = 1")))


@query(f"{WF} SELECT filename, len(list_filter(a, lambda x: NOT list_contains(b, x)))::INT AS added, len(list_filter(b, lambda x: NOT list_contains(a, x)))::INT AS removed FROM (SELECT filename, list(DISTINCT person_id) FILTER (person_id IS NOT NULL) AS a, coalesce(list(DISTINCT person_id) FILTER (person_id IS NOT NULL AND pos % 2 = 0), []) AS b FROM face GROUP BY 1) WHERE a IS NOT NULL")
def people_changes(spark, sf_dir):
    """People of photos before and after."""
    rows = S.faces(spark, sf_dir).where("person_id is not null").groupBy("filename").agg(F.collect_set("person_id").alias("a"), F.collect_set(F.when(F.col("pos") % 2 == 0, F.col("person_id"))).alias("b"))
    return rows.select("filename", X.people_changes(F.col("b"), F.col("a")).alias("x")).select("filename", "x.added", "x.removed")


_LOW = "NOT rejected AND NOT confirmed AND confidence < 0.6"
_FALSE = f"{_LOW} AND NOT (confidence >= 0.24 AND (confidence >= 0.32 OR (width * height / 9000.0 <= 0.08 AND greatest(width / 100.0, height / 90.0) <= 0.42)))"
_ALONE = _CALLED + ", lone AS (SELECT 's' || pos AS person_id, 'Unnamed ' || pos AS name, [face_id] AS face_ids FROM face WHERE pos % 40 = 21), every AS (SELECT * FROM called UNION ALL SELECT * FROM lone), own AS (SELECT * REPLACE (CASE WHEN pos % 40 = 21 THEN 's' || pos ELSE person_id END AS person_id) FROM face)"


def _with_singles(spark, sf_dir):
    """People and faces of whom some are unnamed and have one face."""
    f, one = S.faces(spark, sf_dir), F.col("pos") % 40 == 21
    name = lambda prefix: F.concat(F.lit(prefix), F.col("pos").cast("string"))
    single = f.where(one).select(name("s").alias("person_id"), name("Unnamed ").alias("name"), F.array("face_id").alias("face_ids"))
    return _called(spark, sf_dir).unionByName(single), f.withColumn("person_id", F.when(one, name("s")).otherwise(F.col("person_id")))


@query(f"{_ALONE} SELECT face_id, CASE WHEN NOT ({_LOW}) THEN person_id END AS person_id, confirmed, CASE WHEN {_LOW} THEN {_FALSE} ELSE rejected END AS rejected, CASE WHEN {_FALSE} THEN 'rejected' WHEN {_LOW} THEN 'suspicious' ELSE review END AS review, confidence::DOUBLE AS confidence FROM own")
def suppressed_faces(spark, sf_dir):
    """Faces of low confidence lose their owner; false ones are rejected, confirmed ones are spared."""
    return _reviewed(X.suppress_suspicious(*_with_singles(spark, sf_dir))[1])


@query(f"""{_ALONE}, gone AS (SELECT person_id, list(face_id) FILTER ({_FALSE}) AS false_faces, list(face_id) AS low FROM own WHERE {_LOW} AND person_id IS NOT NULL GROUP BY 1)
SELECT e.person_id, name, array_to_string(list_sort(list_filter(face_ids, lambda x: NOT coalesce(list_contains(false_faces, x), FALSE))), ',') AS face_ids FROM every e LEFT JOIN gone g ON e.person_id = g.person_id
WHERE NOT (len(face_ids) = 1 AND starts_with(name, 'Unnamed') AND coalesce(list_contains(low, face_ids[1]), FALSE))""")
def suppressed_people(spark, sf_dir):
    """False faces leave their lists, and unnamed people of one such face go."""
    return _lists(X.suppress_suspicious(*_with_singles(spark, sf_dir))[0])


@query(f"{WF} SELECT face_id, CASE WHEN pos % 9 = 4 THEN NULL WHEN person_id = 'p7' THEN NULL ELSE person_id END AS person_id, CASE WHEN pos % 9 = 4 THEN 'rejected' ELSE review END AS review FROM face")
def reviewed_faces(spark, sf_dir):
    """Reject faces, delete a person."""
    f = S.faces(spark, sf_dir)
    _, out = X.delete_person(S.people(spark, sf_dir), X.review(f, f.where("pos % 9 = 4").select("face_id"), "rejected"), "p7")
    return out.select("face_id", "person_id", "review")


@query("SELECT vec_id, round(1.0, 6)::DOUBLE AS len, 80 AS aligned, CASE WHEN vec_id % 10 = 0 THEN 0.0 ELSE round(list_dot_product(embedding[1:32]::DOUBLE[], embedding[1:32]::DOUBLE[]) / (sqrt(list_dot_product(embedding[1:32]::DOUBLE[], embedding[1:32]::DOUBLE[])) * sqrt(list_dot_product(embedding[1:32]::DOUBLE[], embedding[1:32]::DOUBLE[]))), 6) END AS cosine FROM embeddings")
def vector_values(spark, sf_dir):
    """M1, M4, M5, M6: shared dimensions, alignment and unit length."""
    v, half = F.col("embedding"), F.slice("embedding", 1, 32)
    zero = F.array_repeat(F.lit(0.0), 64)
    return S.read(spark, sf_dir, "embeddings").withColumn("embedding", v.cast("array<double>")).select(
        "vec_id", F.round(vectors.norm(vectors.hybrid(v, half)), 6).alias("len"), F.size(vectors.align(v, 80)).alias("aligned"), F.round(F.when(F.col("vec_id") % 10 == 0, vectors.cosine(v, zero)).otherwise(vectors.cosine(v, half)), 6).alias("cosine")
    )


@query("SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) / power(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 2), 6) AS len2 FROM embeddings WHERE vec_id % 3 <> 0")
def vector_index(spark, sf_dir):
    """SC9: the stored vector where version and size fit, else the other one; zero vectors are left out."""
    zero = F.array_repeat(F.lit(0.0), 64)
    df = S.read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("photo"), F.when(F.col("vec_id") % 3 == 0, "old").otherwise("v2").alias("version"), zero.alias("text"))
    return tables.vector_index(df, "vec_id", "photo", "text", "version", "v2", 64).select("vec_id", F.round(vectors.dot(F.col("embedding"), F.col("embedding")), 6).alias("len2"))


@query("SELECT vec_id FROM embeddings WHERE label IN (1, 4, 7)")
def version_filter(spark, sf_dir):
    """F17."""
    return S.read(spark, sf_dir, "embeddings").where(F.col("label").isin(1, 4, 7)).select("vec_id")


@query(f"{WF} SELECT filename, first(pos ORDER BY greatest(width, height) DESC, width * height DESC, pos) AS preview_id, max(greatest(width, height))::INT AS edge FROM face GROUP BY 1")
def best_preview(spark, sf_dir):
    """M15."""
    out = files.best_preview(S.faces(spark, sf_dir).withColumn("preview_id", F.col("pos")), "filename")
    return out.withColumn("edge", F.col("edge").cast("int"))


@query(f"""{WF}, b AS (SELECT face_id, pos % 80 AS l, pos % 70 AS t, width AS w, height AS h FROM face) SELECT face_id, round(i / (w * h + 400.0 - i), 6)::DOUBLE AS iou, least(w, 100 - l)::BIGINT AS clamped FROM (SELECT *, greatest(0, least(l + w, 30) - greatest(l, 10)) * greatest(0, least(t + h, 30) - greatest(t, 10)) AS i FROM b)""")
def box_values(spark, sf_dir):
    """M10."""
    k = F.col("pos")
    box = F.struct((k % 80).alias("left"), (k % 70).alias("top"), F.col("width"), F.col("height"))
    other = F.struct(F.lit(10).alias("left"), F.lit(10).alias("top"), F.lit(20).alias("width"), F.lit(20).alias("height"))
    clamp = media.clamp_box(k % 80, k % 70, F.col("width"), F.col("height"), F.lit(100), F.lit(90))
    return S.faces(spark, sf_dir).select("face_id", F.round(media.iou(box, other), 6).alias("iou"), clamp["width"].cast("long").alias("clamped"))


@query(f"""{WF} SELECT face_id, 'face-v1-' || left(sha256('{{"filename":"' || filename || '","height":' || least(height, 90 - top) || ',"imageHeight":90,"imageWidth":100,"left":' || "left" || ',"top":' || top || ',"userId":"' || library_id || '","v":1,"width":' || least(width, 100 - "left") || '}}'), 40) AS identity FROM face""")
def face_identity(spark, sf_dir):
    """M9: owner, file, and box within the image."""
    of = [F.col(c) for c in ("library_id", "filename", "left", "top", "width", "height", "image_width", "image_height")]
    return S.faces(spark, sf_dir).select("face_id", media.face_id(*of).alias("identity"))


@query(f"""WITH RECURSIVE {S.FACES}, b AS (SELECT filename, pos AS box_id, ("left")::DOUBLE AS l, top::DOUBLE AS t, width::DOUBLE AS w, height::DOUBLE AS h, row_number() OVER (PARTITION BY filename ORDER BY confidence DESC, pos) AS k FROM face),
r AS (SELECT filename, k, [{{'id': box_id, 'l': l, 't': t, 'w': w, 'h': h}}] AS kept FROM b WHERE k = 1 UNION ALL
 SELECT b.filename, b.k, CASE WHEN len(list_filter(kept, lambda x: greatest(0, least(x.l + x.w, b.l + b.w) - greatest(x.l, b.l)) * greatest(0, least(x.t + x.h, b.t + b.h) - greatest(x.t, b.t))
  > 0.35 * (x.w * x.h + b.w * b.h - greatest(0, least(x.l + x.w, b.l + b.w) - greatest(x.l, b.l)) * greatest(0, least(x.t + x.h, b.t + b.h) - greatest(x.t, b.t))))) > 0 THEN kept ELSE list_append(kept, {{'id': b.box_id, 'l': b.l, 't': b.t, 'w': b.w, 'h': b.h}}) END FROM r JOIN b ON r.filename = b.filename AND b.k = r.k + 1)
SELECT filename, x.id AS box_id FROM (SELECT filename, unnest(arg_max(kept, k)) AS x FROM r GROUP BY filename)""")
def suppressed_boxes(spark, sf_dir):
    """Greedy suppression of overlapping boxes per photo."""
    k = F.col("pos")
    boxes = S.faces(spark, sf_dir).select("filename", k.alias("box_id"), (k % 80).alias("left"), (k % 70).alias("top"), "width", "height", F.col("confidence").alias("score"))
    return P.suppress(boxes, "filename").select("filename", "box_id")
