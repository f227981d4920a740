"""Listings, filters, orders, paging and set operations over photos."""

from __future__ import annotations

from pyspark.sql import functions as F

from albumen.functions import media, text
from albumen.operators import maintenance as X
from albumen.operators import photos as P
from albumen.operators import places as G
from albumen.operators import status as T
from albumen.plans import standins as S
from albumen.plans.registry import query
from albumen.sources import files, metadata, tables

W = "WITH " + S.PHOTOS
BEST = "coalesce(rating, 0) DESC, coalesce(likes, 0) DESC, photo_id"


@query(f"{W} SELECT photo_id, filename, rating, likes FROM photo WHERE coalesce(rating, 0) >= 3 AND coalesce(likes, 0) >= 4 AND cap_date BETWEEN DATE '2020-06-05' AND DATE '2020-07-10'")
def photo_filter(spark, sf_dir):
    """The filter page over all photos."""
    return P.filtered(S.photos(spark, sf_dir), 3, 4, "2020-06-05", "2020-07-10").select("photo_id", "filename", "rating", "likes")


@query(f"{W} SELECT photo_id, latitude, longitude FROM photo WHERE (CASE WHEN latitude IS NOT NULL AND TRY_CAST(latitude AS DOUBLE) IS NULL THEN NULL ELSE sqrt(power(coalesce(TRY_CAST(latitude AS DOUBLE), 0) - 10, 2) + power(coalesce(TRY_CAST(longitude AS DOUBLE), 0) - 20, 2)) END) IS NULL OR sqrt(power(coalesce(TRY_CAST(latitude AS DOUBLE), 0) - 10, 2) + power(coalesce(TRY_CAST(longitude AS DOUBLE), 0) - 20, 2)) <= 5000 * 0.01")
def geo_radius(spark, sf_dir):
    """F3."""
    return P.within_radius(S.photos(spark, sf_dir), 10.0, 20.0, 5000.0).select("photo_id", "latitude", "longitude")


_FAILED = """, bad AS (SELECT photo_id, filename, uploaded, CASE WHEN photo_id % 4 = 0 THEN 'failed' END AS verification_status, photo_id % 10 = 0 AS corrupted,
  CASE photo_id % 6 WHEN 0 THEN 'Bad Header' WHEN 1 THEN 'timeout' WHEN 2 THEN '' END AS verification_error, CASE WHEN photo_id % 5 = 0 THEN 'decode error' END AS last_error,
  CASE photo_id % 7 WHEN 0 THEN 'false' WHEN 1 THEN 'true' END AS sha256_match FROM photo)"""


def _failed(spark, sf_dir):
    k = F.col("photo_id")
    return S.photos(spark, sf_dir).select(
        "photo_id", "filename", "uploaded", F.when(k % 4 == 0, "failed").alias("verification_status"), (k % 10 == 0).alias("corrupted"),
        F.when(k % 6 == 0, "Bad Header").when(k % 6 == 1, "timeout").when(k % 6 == 2, "").alias("verification_error"), F.when(k % 5 == 0, "decode error").alias("last_error"),
        F.when(k % 7 == 0, "false").when(k % 7 == 1, "true").alias("sha256_match"),
    )


@query(f"""{W}{_FAILED}, r AS (SELECT *, coalesce(nullif(trim(verification_error), ''), nullif(trim(last_error), ''), '') AS reason FROM bad)
SELECT photo_id, filename, reason, CASE WHEN sha256_match = 'false' THEN 'hash_mismatch' WHEN reason <> '' THEN 'parse_error' ELSE 'unknown' END AS corruption_type, uploaded
FROM r WHERE (coalesce(verification_status, '') = 'failed' OR corrupted) AND (NOT ends_with(filename, '.nef') OR regexp_matches(lower(reason), 'too small|header|signature|decode|embedded preview|sha256') OR coalesce(sha256_match, '') = 'false')""")
def corrupted_uploads(spark, sf_dir):
    """F4."""
    return P.corrupted(_failed(spark, sf_dir))


@query(f"{W} SELECT photo_id FROM photo WHERE list_has_any(people, ['p1', 'p2']) AND list_has_any(people, ['p3', 'p5', 'p0'])")
def people_filter(spark, sf_dir):
    """F5."""
    return S.photos(spark, sf_dir).where(P.has_people(F.col("people"), [["p1", "p2"], ["p3", "p5", "p0"]])).select("photo_id")


@query(f"{W} SELECT photo_id FROM photo WHERE contains(trim(regexp_replace(lower(concat_ws(' ', address, city, country)), '[^a-z0-9]+', ' ', 'g')), 'brand 12') OR contains(trim(regexp_replace(lower(concat_ws(' ', address, city, country)), '[^a-z0-9]+', ' ', 'g')), 'economy')")
def place_filter(spark, sf_dir):
    """F6."""
    return S.photos(spark, sf_dir).where(P.in_places(F.col("address"), F.col("city"), F.col("country"), ["brand 12", "economy"])).select("photo_id")


@query(f"{W} SELECT CASE WHEN regexp_matches(filename, '\\.mp4$') THEN 'video' ELSE 'photo' END AS media_type, count(*) AS n FROM photo GROUP BY 1")
def media_types(spark, sf_dir):
    """F7."""
    return S.photos(spark, sf_dir).groupBy(media.media_type(F.col("filename")).alias("media_type")).agg(F.count("*").alias("n"))


@query(f"{W} SELECT photo_id, filename FROM photo WHERE liked AND coalesce(rating, 0) >= 2 AND contains(lower(concat_ws(' ', filename, array_to_string(tags, ' '), address, latitude, longitude, captured)), 'ring')")
def album_page_filter(spark, sf_dir):
    """F8."""
    return P.album_view(S.photos(spark, sf_dir), True, 2, "Ring").select("photo_id", "filename")


@query(f"""{W} SELECT photo_id, filename, coalesce(rating, 0) AS rating, coalesce(likes, 0) AS likes, list_contains(liked_by, 'u3') AS liked, array_to_string(tags, ',') AS tags,
coalesce(city, address) AS place, CASE WHEN photo_id % 5 <> 0 THEN (photo_id % 4000)::INT ELSE 0 END AS width, CASE WHEN photo_id % 3 <> 0 THEN 480 ELSE 0 END AS height, captured FROM photo""")
def photo_summary(spark, sf_dir):
    """F14, F15."""
    k = F.col("photo_id")
    exif = F.map_from_arrays(
        F.array(*map(F.lit, ("ImageWidth", "PixelXDimension", "ExifImageHeight", "DateTimeOriginal", "CreateDate"))),
        F.array(F.lit(""), F.when(k % 5 != 0, (k % 4000).cast("string")).otherwise("wide"), F.when(k % 3 != 0, "480").otherwise(" "), F.lit(" "), F.col("captured")),
    )
    return P.summary(S.photos(spark, sf_dir).withColumn("exif", exif), "u3")


@query(f"""{W}, g AS (SELECT photo_id, photo_id % 90 AS d, photo_id % 60 AS m, photo_id % 59 AS s, photo_id % 200 - 100 AS t FROM photo)
SELECT photo_id, round(CASE WHEN photo_id % 2 = 0 THEN -1 ELSE 1 END * (d + m / 60.0::DOUBLE + (s + 0.5::DOUBLE) / 3600), 7) AS dms, round(d::DOUBLE + m / 120.0::DOUBLE + s / 360000.0::DOUBLE, 7) AS fractions,
 CASE WHEN abs(t + 0.25) <= 90 THEN CASE WHEN photo_id % 2 = 0 AND t + 0.25 > 0 THEN -(t + 0.25) ELSE t + 0.25 END END::DOUBLE AS latitude, round((d::DOUBLE + 0.125), 7) AS plain FROM g""")
def gps_decimal(spark, sf_dir):
    """Three numbers, three fractions, and a number that is no latitude over 90."""
    k = F.col("photo_id")
    d, m, s = k % 90, k % 60, k % 59
    south = F.when(k % 2 == 0, "South").otherwise("n")
    three = F.format_string("%d deg %d' %d.5\"", d, m, s)
    six = F.format_string("(%d/1, %d/2, %d/100)", d, m, s)
    one = (k % 200 - 100 + 0.25).cast("double").cast("string")
    return S.photos(spark, sf_dir).select("photo_id", media.gps_decimal(three, south, 90).alias("dms"), media.gps_decimal(six, F.lit("E")).alias("fractions"), media.gps_decimal(one, south, 90).alias("latitude"), media.coordinate(F.concat((k % 90).cast("string"), F.lit(".125")), 90).alias("plain"))


@query(f"WITH {S.ALBUMS} SELECT album_id, name FROM album WHERE is_public AND coalesce(token, '') <> '' AND (expires IS NULL OR expires > TIMESTAMP '1998-01-01')")
def public_albums(spark, sf_dir):
    """F18."""
    return P.albums_open(S.albums(spark, sf_dir), F.lit("1998-01-01").cast("timestamp")).select("album_id", "name")


_KINDS = ("recluster_snapshot_2", "face_dedupe_snapshot", "suspicious_face_snapshot", "face_membership_snapshot", "snapshot_repair", "merge")


@query(f"""WITH r AS (SELECT o_orderkey AS merge_id, {list(_KINDS)}[o_orderkey % 6 + 1] AS kind, CASE WHEN o_orderkey % 5 <> 0 THEN 'Ann' END AS own_target, CASE WHEN o_orderkey % 7 < 5 THEN 'Bob,Cid' ELSE '' END AS own_names FROM orders)
SELECT merge_id, coalesce(own_target, 'Base') AS target, CASE WHEN own_names = '' THEN 'Dora' ELSE own_names END AS names FROM r WHERE kind IN ('snapshot_repair', 'merge')""")
def merge_history(spark, sf_dir):
    """merges without snapshots; what a row lacks is taken from its payload."""
    k = F.col("o_orderkey")
    empty = F.array().cast("array<string>")
    rows = S.read(spark, sf_dir, "orders").select(
        k.alias("merge_id"), F.element_at(F.array(*map(F.lit, _KINDS)), (k % 6 + 1).cast("int")).alias("kind"), F.when(k % 5 != 0, "Ann").alias("target"),
        F.when(k % 7 < 5, F.array(F.lit("Bob"), F.lit("Cid"))).otherwise(empty).alias("names"), F.lit("Base").alias("stored_target"), F.array(F.lit("Dora"), F.lit("")).alias("stored_names"),
    )
    return X.merge_history(rows).select("merge_id", "target", F.array_join("names", ",").alias("names"))


@query(f"""{W}, s AS (SELECT photo_id, CASE WHEN photo_id % 5 = 0 THEN 'deleted' END AS state, CASE WHEN photo_id % 4 <> 0 THEN ' Done ' ELSE 'queued' END AS face_status, CASE WHEN photo_id % 3 = 0 THEN photo_id % 2 ELSE 0 END AS n, photo_id % 7 AS listed FROM photo)
SELECT photo_id, CASE WHEN n > 0 THEN n ELSE listed END AS faces FROM s WHERE state IS NULL AND face_status = ' Done ' AND (n > 0 OR listed > 0)""")
def autocluster_trigger(spark, sf_dir):
    """photos whose faces are done and not none."""
    k = F.col("photo_id")
    df = S.photos(spark, sf_dir).select(k, F.when(k % 5 == 0, "deleted").alias("processing_state"), F.when(k % 4 != 0, " Done ").otherwise("queued").alias("face_status"), F.when(k % 3 == 0, k % 2).alias("face_count"), F.array_repeat(F.lit("f"), (k % 7).cast("int")).alias("faces"))
    return T.clustering_due(df).select("photo_id", "faces")


@query(f"WITH {S.FACES} SELECT face_id FROM face WHERE confidence < 0.28 OR (confidence < 0.38 AND (width * height / 9000.0 > 0.08 OR greatest(width / 100.0, height / 90.0) > 0.42))")
def false_positive_faces(spark, sf_dir):
    """F22."""
    f = S.faces(spark, sf_dir)
    area, side = F.col("width") * F.col("height") / 9000.0, F.greatest(F.col("width") / 100.0, F.col("height") / 90.0)
    return f.where(media.false_positive_face(F.col("confidence"), area, side)).select("face_id")


@query("SELECT p_partkey AS photo_id, array_to_string(list_filter(['exif', 'ai_vision', 'face', 'ocr'], lambda s: p_partkey % 2 = 0 OR s NOT IN ('ai_vision', 'face')), ',') AS steps FROM part")
def step_restriction(spark, sf_dir):
    """steps that need a model go where there is none."""
    steps, gated = (F.array(*map(F.lit, x)) for x in (("exif", "ai_vision", "face", "ocr"), ("ai_vision", "face")))
    return S.photos(spark, sf_dir).select("photo_id", F.array_join(F.when(F.col("photo_id") % 2 == 0, steps).otherwise(F.array_except(steps, gated)), ",").alias("steps"))


_SORTS = {
    "rating": "coalesce(rating, 0) DESC",
    "likes": "coalesce(likes, 0) DESC",
    "capture": "coalesce(strptime(captured, '%Y:%m:%d %H:%M:%S'), uploaded) DESC NULLS LAST",
    "date": "uploaded DESC NULLS LAST",
    "location": "lower(filename)",
}
for _by, _order in _SORTS.items():

    def _page(spark, sf_dir, by=_by):
        return P.page(P.listing(S.photos(spark, sf_dir), by), 24, 24).select("photo_id", "filename")

    _page.__name__, _page.__doc__ = f"listing_{_by}", "T1, T2: the second page in this order."
    query(f"{W} SELECT photo_id, filename FROM photo ORDER BY {_order}, photo_id LIMIT 24 OFFSET 24")(_page)


for _name, _most in (("recent_uploads", 20), ("recent_preview", 12)):

    def _recent(spark, sf_dir, most=_most):
        return P.recent(S.photos(spark, sf_dir), most).select("photo_id", "uploaded")

    _recent.__name__, _recent.__doc__ = _name, f"T8: the latest {_most}; their number is the feature."
    query(f"{W} SELECT photo_id, coalesce(uploaded, TIMESTAMP '1970-01-01') AS uploaded FROM photo ORDER BY 2 DESC, 1 LIMIT {_most}")(_recent)


@query(f"{W} SELECT photo_id, filename, (SELECT count(*) FROM photo WHERE coalesce(rating, 0) >= 2) AS total FROM photo WHERE coalesce(rating, 0) >= 2 ORDER BY uploaded DESC NULLS LAST, photo_id LIMIT 24 OFFSET 24")
def listing_total(spark, sf_dir):
    """A page, and how many there are in all."""
    return P.page_with_total(P.listing(P.rated(S.photos(spark, sf_dir), 2), "date"), 24, 24).select("photo_id", "filename", "total")


@query("SELECT c_custkey AS person_id, c_name AS name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 30 OFFSET 60")
def people_page(spark, sf_dir):
    """The third page of people."""
    c = S.read(spark, sf_dir, "customer").orderBy(F.desc("c_acctbal"), "c_custkey")
    return P.page(c, 60, 30).select(F.col("c_custkey").alias("person_id"), F.col("c_name").alias("name"))


@query(f'WITH {S.FACES} SELECT face_id FROM face QUALIFY row_number() OVER (PARTITION BY filename, "left", width // 10 ORDER BY pos) = 1')
def first_faces(spark, sf_dir):
    """Of faces that look alike in a list, the first."""
    f = S.faces(spark, sf_dir)
    return P.keep_first(f, [F.col("filename"), F.col("left"), F.floor(F.col("width") / 10)], [F.col("pos")]).select("face_id")


_PIXEL = """px AS (SELECT user_id % 3 AS photo_id, 100 AS w, 100 AS h, event_id % 97 AS x, event_id * 7 % 89 AS y, event_id * 31 % 256 AS r, event_id * 17 % 120 AS g, event_id * 5 % 60 AS b, CASE WHEN event_id % 9 = 0 THEN 10 WHEN event_id % 2 = 0 THEN 255 END AS a FROM events)"""


@query(f"""WITH {_PIXEL}, s AS (SELECT photo_id, r / 255.0::DOUBLE AS r, g / 255.0::DOUBLE AS g, b / 255.0::DOUBLE AS b, 0.75::DOUBLE + (y - 36) / 56.0::DOUBLE * 0.5 AS wt FROM px WHERE x >= 22 AND x < 78 AND y >= 36 AND y < 92 AND coalesce(a, 255) >= 32),
h AS (SELECT photo_id, wt, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS d, CASE WHEN greatest(r, g, b) = 0 THEN 0 ELSE (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) END AS sat,
 CASE WHEN greatest(r, g, b) = least(r, g, b) THEN 0 WHEN greatest(r, g, b) = r THEN CASE WHEN g < b THEN 60 * (g - b) / (greatest(r, g, b) - least(r, g, b)) + 360 ELSE 60 * (g - b) / (greatest(r, g, b) - least(r, g, b)) END WHEN greatest(r, g, b) = g THEN 60 * ((b - r) / (greatest(r, g, b) - least(r, g, b)) + 2) ELSE 60 * ((r - g) / (greatest(r, g, b) - least(r, g, b)) + 4) END AS hue FROM s),
c AS (SELECT photo_id, sum(wt) AS w, CASE WHEN v < 0.18 THEN 'black' WHEN sat < 0.12 THEN CASE WHEN v > 0.82 THEN 'white' ELSE 'gray' END WHEN hue >= 18 AND hue < 48 AND v < 0.62 AND sat > 0.32 THEN 'brown' WHEN hue >= 18 AND hue < 45 THEN 'orange'
 WHEN hue >= 45 AND hue < 70 THEN 'yellow' WHEN hue >= 70 AND hue < 165 THEN 'green' WHEN hue >= 165 AND hue < 250 THEN 'blue' WHEN hue >= 250 AND hue < 292 THEN 'purple' WHEN hue >= 292 AND hue < 340 THEN 'pink' ELSE 'red' END AS color FROM h GROUP BY ALL),
t AS (SELECT photo_id, sum(w) AS total, max(w) AS w, arg_max(color, w) AS color FROM (SELECT photo_id, color, sum(w) AS w FROM c GROUP BY 1, 2) GROUP BY 1)
SELECT photo_id, color, round(w / total, 6) AS share FROM t WHERE total >= 40 AND w / total >= 0.18""")
def dominant_colors(spark, sf_dir):
    """Pixels from events, 100 by 100 an image."""
    k = F.col("event_id")
    px = S.read(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("photo_id"), F.lit(100).alias("image_width"), F.lit(100).alias("image_height"), (k % 97).alias("x"), (k * 7 % 89).alias("y"), (k * 31 % 256).alias("r"), (k * 17 % 120).alias("g"), (k * 5 % 60).alias("b"), F.when(k % 9 == 0, 10).when(k % 2 == 0, 255).alias("a"))
    return P.dominant_color(px).withColumn("share", F.round("share", 6))


@query("SELECT count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS public FROM orders")
def public_album_count(spark, sf_dir):
    """A20."""
    return S.albums(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if("is_public").alias("public"))


@query(f"WITH {S.ALBUM_FILES}, {S.NAMED} SELECT album_id, pos::INT AS pos, filename, photo_id FROM entry JOIN named USING (filename)")
def album_photos(spark, sf_dir):
    """An album's photos in order; names without a photo are dropped."""
    return P.album_photos(S.album_files(spark, sf_dir), S.named_photos(spark, sf_dir)).select("album_id", "pos", "filename", "photo_id")


@query(f"WITH {S.ALBUM_FILES}, {S.NAMED} SELECT photo_id FROM named WHERE filename NOT IN (SELECT filename FROM entry)")
def not_in_album(spark, sf_dir):
    """J4, anti."""
    listed = S.album_files(spark, sf_dir).select(F.explode("filenames").alias("filename"))
    return S.named_photos(spark, sf_dir).join(listed, "filename", "left_anti").select("photo_id")


@query(f"WITH {S.ALBUM_FILES}, {S.NAMED} SELECT photo_id FROM named WHERE filename IN (SELECT filename FROM entry WHERE album_id % 5 = 1)")
def in_album(spark, sf_dir):
    """J4, semi."""
    listed = S.album_files(spark, sf_dir).where("album_id % 5 = 1").select(F.explode("filenames").alias("filename"))
    return S.named_photos(spark, sf_dir).join(listed, "filename", "left_semi").select("photo_id")


@query(f"""{W}, x AS (SELECT photo_id, p, i FROM (SELECT photo_id, unnest(people) AS p, generate_subscripts(people, 1) AS i FROM photo)),
n AS (SELECT 'p' || r AS person_id, CASE WHEN r % 3 <> 0 THEN 'Ann p' || r ELSE '' END AS name FROM range(10) t(r))
SELECT photo_id, coalesce(string_agg(name, ',' ORDER BY i) FILTER (name <> ''), '') AS names FROM x LEFT JOIN n ON p = person_id GROUP BY photo_id""")
def people_names(spark, sf_dir):
    """Names of a photo's people in their order."""
    n = F.col("id").cast("string")
    names = spark.range(10).select(F.concat(F.lit("p"), n).alias("person_id"), F.when(F.col("id") % 3 != 0, F.concat(F.lit("Ann p"), n)).otherwise("").alias("name"))
    rows = S.photos(spark, sf_dir).select("photo_id", F.posexplode("people").alias("i", "person_id")).join(names, "person_id", "left")
    listed = F.array_sort(F.collect_list(F.when(F.col("name") != "", F.struct("i", "name"))))
    return rows.groupBy("photo_id").agg(F.array_join(F.transform(listed, lambda x: x["name"]), ",").alias("names"))


@query(f"{W}, g AS (SELECT file_hash, min(photo_id) AS first_key, count(*) AS copies FROM photo GROUP BY 1 HAVING count(*) > 1) SELECT photo_id, file_hash, first_key, copies FROM photo JOIN g USING (file_hash)")
def exact_duplicates(spark, sf_dir):
    """J12."""
    return P.duplicates(S.photos(spark, sf_dir), "file_hash", "photo_id")


@query(f"""{W}, r AS (SELECT left(md5((photo_id // 4)::VARCHAR), 13) || right('00' || (photo_id * 37 % 256)::VARCHAR, 3) AS h, min(photo_id) AS k FROM photo GROUP BY 1)
SELECT a.k AS k1, b.k AS k2, hamming(a.h, b.h)::INT AS distance, (100 - 5 * hamming(a.h, b.h))::INT AS similarity FROM r a JOIN r b ON a.k < b.k AND hamming(a.h, b.h) <= 5""")
def perceptual_duplicates(spark, sf_dir):
    """Hashes of 16 characters, of which four photos each share all but the last three."""
    k = F.col("photo_id")
    h = F.concat(F.left(F.md5(F.floor(k / 4).cast("string").cast("binary")), F.lit(13)), F.lpad((k * 37 % 256).cast("string"), 3, "0"))
    return P.near_duplicates(S.photos(spark, sf_dir).withColumn("perceptual_hash", h))


@query(f"{W}, n AS (SELECT *, photo_id % 50 AS nm FROM photo) SELECT DISTINCT a.photo_id FROM n a JOIN n b ON a.nm = b.nm AND a.library_id <> b.library_id AND a.file_hash <> b.file_hash AND a.file_hash <> '' AND b.file_hash <> ''")
def name_conflicts(spark, sf_dir):
    """Another library has the name with other content. Hashes and libraries are counted per name first, so
    rows of a name never meet."""
    df = S.photos(spark, sf_dir).withColumn("nm", F.col("photo_id") % 50).where("file_hash <> ''")
    pairs = df.groupBy("nm", "library_id", "file_hash").agg(F.count("*").alias("n"))
    # Others of the name = all - same library - same hash + both.
    total = pairs.groupBy("nm").agg(F.sum("n").alias("t"))
    lib = pairs.groupBy("nm", "library_id").agg(F.sum("n").alias("l"))
    same = pairs.groupBy("nm", "file_hash").agg(F.sum("n").alias("h"))
    rows = pairs.join(total, "nm").join(lib, ["nm", "library_id"]).join(same, ["nm", "file_hash"]).where("t - l - h + n > 0")
    return df.join(rows.select("nm", "library_id", "file_hash"), ["nm", "library_id", "file_hash"], "left_semi").select("photo_id")


_FIRSTS = "array_to_string(list_filter({0}, lambda x, i: list_position({0}, x) = i{1}), ',')"


@query(f"""{W}, l AS (SELECT photo_id, tags, list_concat(tags, people) AS lists FROM photo) SELECT photo_id, {_FIRSTS.format('lists', '')} AS added, {_FIRSTS.format('tags', " AND x NOT IN ('red', 'ring')")} AS removed, {_FIRSTS.format('tags', " AND x IN ('red', 'ring')")} AS chosen FROM l""")
def album_set_operations(spark, sf_dir):
    """Union, difference and intersection of lists, in order of first places."""
    some = F.array(F.lit("red"), F.lit("ring"))
    show = lambda c: F.array_join(c, ",")
    return S.photos(spark, sf_dir).select("photo_id", show(F.array_union("tags", "people")).alias("added"), show(F.array_except("tags", some)).alias("removed"), show(F.array_intersect("tags", some)).alias("chosen"))


@query(f"WITH {S.ALBUM_FILES}, {S.NAMED}, a AS (SELECT e.album_id, n.photo_id, n.filename FROM entry e JOIN named n USING (filename)) SELECT album_id, photo_id FROM a WHERE photo_id % 2 = 0")
def archive_selection(spark, sf_dir):
    """SC11, S3: the chosen photos of albums."""
    albums = P.album_photos(S.album_files(spark, sf_dir), S.named_photos(spark, sf_dir))
    wanted = S.read(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit("photo"), F.col("p_partkey").cast("string")).alias("filename"))
    return tables.archive_selection(albums.select("album_id", "photo_id", "filename"), wanted).select("album_id", "photo_id")


@query(f"{W} SELECT photo_id, filename, rating FROM photo WHERE library_id = 'lib2'")
def partition_scan(spark, sf_dir):
    """SC1, SC2: one library, some columns."""
    return tables.lookup(S.photos(spark, sf_dir), library_id="lib2").select("photo_id", "filename", "rating")


@query("SELECT p_partkey AS photo_id, p_name FROM part WHERE p_partkey = 77")
def point_lookup(spark, sf_dir):
    """SC3."""
    return tables.lookup(S.read(spark, sf_dir, "part"), p_partkey=77).select(F.col("p_partkey").alias("photo_id"), "p_name")


@query("SELECT o_orderkey AS album_id FROM orders WHERE o_orderkey % 3 <> 0 AND 't' || o_orderkey = 't200'")
def token_scan(spark, sf_dir):
    """SC4."""
    return tables.lookup(S.albums(spark, sf_dir), token="t200").select("album_id")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1 AND event_type <> 'error'")
def upsert_latest(spark, sf_dir):
    """SC5: the latest version of each key; a latest row of type error means deleted."""
    e = S.read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts", (F.col("event_type") == "error").alias("dead"))
    first = e.where("event_id % 2 = 0 and not dead")
    rows = tables.upsert(first, e.where("event_id % 2 = 1 or dead"), ["user_id"], "ts", "dead")
    return rows.select("user_id", "event_id", "event_type")


@query("SELECT user_id FROM (SELECT DISTINCT user_id FROM events) ORDER BY user_id LIMIT 200")
def distinct_owners(spark, sf_dir):
    """SC14."""
    return tables.owners(S.read(spark, sf_dir, "events"))


@query("SELECT s_suppkey AS photo_id, s_name AS address, n_name AS city, r_name AS country FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def reverse_geocode(spark, sf_dir):
    """SC12: places by key; the city falls back from town to village."""
    places = S.read(spark, sf_dir, "nation").join(S.read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    none = F.lit(None).cast("string")
    k = F.col("n_nationkey") % 3
    places = places.select(F.col("n_nationkey").alias("place_id"), F.when(k == 0, F.col("n_name")).alias("city"), F.when(k == 1, F.col("n_name")).alias("town"), F.when(k == 2, F.col("n_name")).alias("village"), none.alias("state"), F.col("r_name").alias("country"))
    photo = S.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("photo_id"), F.col("s_name").alias("address"), F.col("s_nationkey").alias("place_id"))
    return tables.geocoded(photo, places)


@query("SELECT custkey AS library_id, min(origin) AS origin FROM (SELECT c_custkey AS custkey, 'old' AS origin FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'wanted' FROM customer WHERE c_custkey % 3 = 0) GROUP BY 1")
def get_or_create(spark, sf_dir):
    """SC15."""
    from albumen.operators.membership import get_or_create as make

    c = S.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("library_id"))
    old, wanted = c.where("library_id % 2 = 0").withColumn("origin", F.lit("old")), c.where("library_id % 3 = 0").withColumn("origin", F.lit("wanted"))
    return make(old, make(wanted, wanted, ["library_id"]), ["library_id"])


@query(f"{W} SELECT photo_id, string_agg(k || '=' || v, ',' ORDER BY k) AS exif FROM (SELECT photo_id, 'Make' AS k, city AS v FROM photo UNION ALL SELECT photo_id, 'Model', CASE WHEN photo_id % 2 = 0 THEN 'new' ELSE 'old' END FROM photo) WHERE v IS NOT NULL GROUP BY photo_id")
def exif_merge(spark, sf_dir):
    """Later keys win."""
    from albumen.sources.files import merge_maps

    a = F.create_map(F.lit("Make"), F.col("city"), F.lit("Model"), F.lit("old"))
    b = F.map_filter(F.create_map(F.lit("Model"), F.lit("new")), lambda k, v: F.col("photo_id") % 2 == 0)
    pairs = F.array_sort(F.map_entries(F.map_filter(merge_maps(a, b), lambda k, v: v.isNotNull())))
    return S.photos(spark, sf_dir).select("photo_id", F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("exif"))


@query("SELECT user_id, event_type, min(event_id) AS first_pos, max_by(value, event_id) AS value FROM events GROUP BY 1, 2")
def request_dedupe(spark, sf_dir):
    """The last value, at the first place."""
    return S.read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_pos"), F.max_by("value", "event_id").alias("value"))


_COLOR = """SELECT p_partkey AS photo_id, r, g, b FROM (SELECT p_partkey, (p_partkey * 7 % 256)::INT AS r, (p_partkey * 13 % 256)::INT AS g, (p_partkey * 29 % 256)::INT AS b FROM part)"""


@query(f"""WITH c AS ({_COLOR}), m AS (SELECT photo_id, r / 255.0::DOUBLE AS r, g / 255.0::DOUBLE AS g, b / 255.0::DOUBLE AS b FROM c), s AS (SELECT *, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS d FROM m),
h AS (SELECT *, CASE WHEN v = 0 THEN 0 ELSE d / v END AS sat, CASE WHEN d = 0 THEN 0 WHEN v = r THEN CASE WHEN (g - b) / d < 0 THEN 60 * (g - b) / d + 360 ELSE 60 * (g - b) / d END WHEN v = g THEN 60 * ((b - r) / d + 2) ELSE 60 * ((r - g) / d + 4) END AS hue FROM s)
SELECT photo_id, CASE WHEN v < 0.18 THEN 'black' WHEN sat < 0.12 THEN CASE WHEN v > 0.82 THEN 'white' ELSE 'gray' END WHEN hue >= 18 AND hue < 48 AND v < 0.62 AND sat > 0.32 THEN 'brown' WHEN hue >= 18 AND hue < 45 THEN 'orange'
WHEN hue >= 45 AND hue < 70 THEN 'yellow' WHEN hue >= 70 AND hue < 165 THEN 'green' WHEN hue >= 165 AND hue < 250 THEN 'blue' WHEN hue >= 250 AND hue < 292 THEN 'purple' WHEN hue >= 292 AND hue < 340 THEN 'pink' ELSE 'red' END AS color FROM h""")
def color_names(spark, sf_dir):
    """M11."""
    k = F.col("p_partkey")
    return S.read(spark, sf_dir, "part").select(k.alias("photo_id"), media.color_name(k * 7 % 256, k * 13 % 256, k * 29 % 256).alias("color"))


@query(f"""{W} SELECT photo_id, CASE WHEN instr(filename, '.') > 0 THEN lower(regexp_extract(filename, '\\.([^.]*)$', 1)) ELSE '' END AS ext,
 (photo_id * 45 - 400) % 360 + CASE WHEN (photo_id * 45 - 400) % 360 < 0 THEN 360 ELSE 0 END AS rotation, sha256(filename) AS digest, photo_id % 3 = 0 AS truthy FROM photo""")
def scalar_values(spark, sf_dir):
    """Rotation, digests (M8) and truth of loose values."""
    k = F.col("photo_id")
    loose = F.when(k % 3 == 0, "Yes").when(k % 3 == 1, "0").otherwise("no")
    return S.photos(spark, sf_dir).select("photo_id", text.file_extension(F.col("filename")).alias("ext"), media.rotation((k * 45 - 400).cast("string")).cast("long").alias("rotation"), F.sha2("filename", 256).alias("digest"), media.truthy(loose).alias("truthy"))


@query("""SELECT p_partkey AS photo_id, CASE WHEN p_partkey % 11 = 0 AND p_partkey % 2 = 1 THEN 'checksum of a chunk' WHEN p_partkey % 7 = 0 THEN 'truncated' END AS problem FROM part""")
def image_integrity(spark, sf_dir):
    """SC7: planted images, walked to their ends. A changed byte of metadata is told by a PNG's checksum; a JPEG has none."""
    rows = files.integrity(S.image_files(spark, sf_dir))
    return rows.select(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("photo_id"), "problem")


@query("""SELECT p_partkey AS photo_id, CASE WHEN p_partkey % 11 = 0 THEN '?' || substr(p_brand, 2) ELSE p_brand END AS make, '6' AS orientation,
  strftime(DATE '2020-06-01' + p_size, '%Y:%m:%d 10:20:30') AS captured, round(-(p_partkey % 90 + (p_partkey % 60) / 60.0 + (p_partkey * 7 % 6000) / 100.0 / 3600), 6)::DOUBLE AS latitude,
  round(p_partkey % 180 + (p_partkey % 59) / 60.0 + (p_partkey * 3 % 6000) / 100.0 / 3600, 6)::DOUBLE AS longitude FROM part""")
def image_metadata(spark, sf_dir):
    """SC8, F16: entries of planted images' EXIF and GPS directories, whether or not their ends are there."""
    rows = metadata.metadata(S.image_files(spark, sf_dir))
    of = lambda k: F.try_element_at("exif", F.lit(k))
    place = {c: F.round(of(f"GPS.{c.title()}Decimal").cast("double"), 6).alias(c) for c in ("latitude", "longitude")}
    return rows.select(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("photo_id"), of("Make").alias("make"), of("Orientation").alias("orientation"), of("DateTimeOriginal").alias("captured"), place["latitude"], place["longitude"])


@query(f"""{W}, place AS (SELECT c_custkey AS place_id, radians((c_custkey * 7919 % 180000) / 1000.0 - 90) AS y, radians((c_custkey * 104729 % 360000) / 1000.0 - 180) AS x,
    c_name AS address, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE 'Town ' || c_nationkey END AS city, n_name AS country FROM customer JOIN nation ON c_nationkey = n_nationkey),
  spot AS (SELECT place_id, address, city, country, cos(y) * cos(x) AS a, cos(y) * sin(x) AS b, sin(y) AS c FROM place),
  asked AS (SELECT photo_id, radians(TRY_CAST(latitude AS DOUBLE)) AS y, radians(TRY_CAST(longitude AS DOUBLE)) AS x FROM photo),
  here AS (SELECT DISTINCT y, x, cos(y) * cos(x) AS a, cos(y) * sin(x) AS b, sin(y) AS c FROM asked WHERE y IS NOT NULL AND x IS NOT NULL),
  best AS (SELECT y, x, min({{'d': power(here.a - spot.a, 2) + power(here.b - spot.b, 2) + power(here.c - spot.c, 2), 'p': place_id}}) AS best FROM here, spot GROUP BY y, x)
SELECT photo_id, best.p AS place_id, CASE WHEN best.d IS NOT NULL THEN round(2 * 6371.0088 * asin(least(1, sqrt(best.d) / 2)), 3) END AS distance_km, address, city, country
FROM asked LEFT JOIN best USING (y, x) LEFT JOIN spot ON place_id = best.p""")
def nearest_place(spark, sf_dir):
    """SC12: photos with the address of the nearest place by their coordinates, anywhere on the globe."""
    k = F.col("c_custkey")
    c = S.read(spark, sf_dir, "customer").join(S.read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    known = c.select(
        k.alias("place_id"), ((k * 7919 % 180000) / 1000.0 - 90).alias("latitude"), ((k * 104729 % 360000) / 1000.0 - 180).alias("longitude"), F.col("c_name").alias("address"),
        F.when(k % 3 == 0, F.col("c_mktsegment")).alias("city"), F.concat(F.lit("Town "), F.col("c_nationkey").cast("string")).alias("town"), F.lit("").alias("village"), F.lit(None).cast("string").alias("state"), F.col("n_name").alias("country"),
    )
    found = G.nearest_places(S.photos(spark, sf_dir).select("photo_id", "latitude", "longitude"), known)
    return found.join(G.address_of(known), "place_id", "left").select("photo_id", "place_id", F.round("distance_km", 3).alias("distance_km"), "address", "city", "country")
