"""The logical tables of a media library, mapped onto the given tables; and the same mappings as SQL.

photo = part, face = embeddings, person = its labels, event = events, album = orders and lineitem, account =
customer, library = nation, text = documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumen.operators.once import computed_once

NOW = "2024-01-31 00:00:00"
STATES = ("done", "queued", "pending", "running", "failed", "no_data")


def read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def photos(spark, sf_dir: str, spread: bool = False) -> DataFrame:
    """With `spread`, rows are dealt to all tasks by their keys, for columns that cost far more than reading the few
    bytes a row has: a small file is few tasks."""
    k, e = F.col("p_partkey"), F.expr
    part = read(spark, sf_dir, "part")
    part = part.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), k) if spread else part
    return part.select(
        k.alias("photo_id"),
        F.concat(F.lit("lib"), (k % 4).cast("string")).alias("library_id"),
        F.concat(F.regexp_replace("p_name", " ", "_"), F.lit("_"), k.cast("string"), F.element_at(F.array(*map(F.lit, (".jpg", ".nef", ".mp4", ".png", ".heic"))), (k % 5 + 1).cast("int"))).alias("filename"),
        F.when(k % 17 != 0, F.col("p_size") % 6).alias("rating"),
        F.when(k % 19 != 0, F.col("p_size") % 11).alias("likes"),
        F.when(k % 23 != 0, F.timestamp_add("MINUTE", (k * 37).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp"))).alias("uploaded"),
        F.when(k % 7 != 0, F.date_format(F.date_add(F.lit("2020-06-01").cast("date"), F.col("p_size")), "yyyy:MM:dd' 10:20:30'")).alias("captured"),
        F.when(k % 13 == 0, "n/a").when(k % 11 != 0, F.concat(((k % 170) - 85).cast("string"), F.lit(".5"))).alias("latitude"),
        F.when(k % 11 != 0, F.concat(((k % 340) - 170).cast("string"), F.lit(".25"))).alias("longitude"),
        F.concat("p_brand", F.lit(" Street")).alias("address"),
        F.when(k % 9 != 0, F.col("p_brand")).alias("city"),
        F.when(k % 6 != 0, F.col("p_type")).alias("country"),
        F.concat(F.split("p_name", " "), F.array(F.lower("p_type"))).alias("tags"),
        F.array(F.col("p_brand"), F.element_at(F.split("p_name", " "), 1)).alias("objects"),
        F.array(F.concat(F.lit("p"), (k % 10).cast("string")), F.concat(F.lit("p"), (k % 4).cast("string"))).alias("people"),
        F.md5(F.concat("p_name", F.col("p_size").cast("string")).cast("binary")).alias("file_hash"),
        F.array(F.concat(F.lit("u"), (k % 5).cast("string"))).alias("liked_by"),
        (k % 3 == 0).alias("liked"),
        k.alias("pos"),
    )


PHOTOS = """photo AS (SELECT p_partkey AS photo_id, 'lib' || (p_partkey % 4) AS library_id,
  replace(p_name, ' ', '_') || '_' || p_partkey || ['.jpg', '.nef', '.mp4', '.png', '.heic'][p_partkey % 5 + 1] AS filename,
  CASE WHEN p_partkey % 17 <> 0 THEN p_size % 6 END AS rating, CASE WHEN p_partkey % 19 <> 0 THEN p_size % 11 END AS likes,
  CASE WHEN p_partkey % 23 <> 0 THEN TIMESTAMP '2024-01-01' + to_minutes(p_partkey * 37) END AS uploaded,
  CASE WHEN p_partkey % 7 <> 0 THEN DATE '2020-06-01' + p_size END AS cap_date,
  CASE WHEN p_partkey % 7 <> 0 THEN strftime(DATE '2020-06-01' + p_size, '%Y:%m:%d 10:20:30') END AS captured,
  CASE WHEN p_partkey % 13 = 0 THEN 'n/a' WHEN p_partkey % 11 <> 0 THEN (p_partkey % 170 - 85) || '.5' END AS latitude,
  CASE WHEN p_partkey % 11 <> 0 THEN (p_partkey % 340 - 170) || '.25' END AS longitude,
  p_brand || ' Street' AS address, CASE WHEN p_partkey % 9 <> 0 THEN p_brand END AS city, CASE WHEN p_partkey % 6 <> 0 THEN p_type END AS country,
  list_append(string_split(p_name, ' '), lower(p_type)) AS tags, [p_brand, string_split(p_name, ' ')[1]] AS objects, ['p' || (p_partkey % 10), 'p' || (p_partkey % 4)] AS people,
  md5(p_name || p_size) AS file_hash, ['u' || (p_partkey % 5)] AS liked_by, p_partkey % 3 = 0 AS liked, p_partkey AS pos FROM part)"""


def states(spark, sf_dir: str) -> DataFrame:
    """Processing states of every photo, one column per stage."""
    from albumen.operators.status import STAGES

    df = photos(spark, sf_dir)
    item = lambda step, status, reason: F.struct(F.lit(step).alias("step"), F.lit(status).alias("status"), F.lit(reason).alias("reason"))
    table = F.array(*map(F.lit, STATES))
    cols = {f"{s}_status": F.element_at(table, ((F.col("photo_id") * (i + 3) + F.floor(F.col("photo_id") / 7)) % 6 + 1).cast("int")) for i, s in enumerate(STAGES)}
    return df.withColumns(cols).withColumns({
        "updated": F.coalesce("uploaded", F.lit("2024-01-01").cast("timestamp")),
        "lease_expires": F.when(F.col("photo_id") % 2 == 0, F.lit("2024-02-10").cast("timestamp")).otherwise(F.lit("2024-01-20").cast("timestamp")),
        "accepted_ai": F.col("photo_id") % 16 == 1,
        "fallback_ai": F.col("photo_id") % 32 == 1,
        "deferred": F.when(F.col("photo_id") % 12 == 0, "Background_Throttled"),
        "report": F.filter(F.array(
            F.when(F.col("photo_id") % 3 == 0, item("ai_vision", "failed", "model_load_failed")),
            F.when(F.col("photo_id") % 3 == 1, item("ai_vision", "done", "model_load_failed")),
            F.when(F.col("photo_id") % 18 == 5, item("face", "skipped", "background_throttled")),
        ), lambda x: x.isNotNull()),
        "processing_state": F.when(F.col("photo_id") % 29 == 0, "deleted"),
    })


_STAGES = ("thumbnail", "exif", "ocr", "ai_vision", "map_detection", "face", "verify")
_STATE_LIST = "['done', 'queued', 'pending', 'running', 'failed', 'no_data']"
STATES_SQL = (
    PHOTOS
    + ", state AS (SELECT *, coalesce(uploaded, TIMESTAMP '2024-01-01') AS updated, CASE WHEN photo_id % 2 = 0 THEN TIMESTAMP '2024-02-10' ELSE TIMESTAMP '2024-01-20' END AS lease_expires, ends_with(filename, '.nef') AND CASE WHEN photo_id % 16 = 1 THEN photo_id % 32 = 1 ELSE photo_id % 3 = 0 END AS retry_ai, photo_id % 12 = 0 OR photo_id % 18 = 5 AS face_throttled, CASE WHEN photo_id % 29 = 0 THEN 'deleted' END AS processing_state, "
    + ", ".join(f"{_STATE_LIST}[(photo_id * {i + 3} + photo_id // 7) % 6 + 1] AS {s}_status" for i, s in enumerate(_STAGES))
    + " FROM photo), long_state AS ("
    + " UNION ALL ".join(f"SELECT photo_id, '{s}' AS stage, {s}_status AS status FROM state" for s in _STAGES)
    + ")"
)


def faces(spark, sf_dir: str) -> DataFrame:
    k = F.col("vec_id")
    return read(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("f"), F.lpad(k.cast("string"), 6, "0")).alias("face_id"), k.alias("pos"), F.when(k % 14 != 0, F.concat(F.lit("p"), F.col("label").cast("string"))).alias("person_id"),
        ((k * 37 % 100) / 100.0).alias("confidence"), (k % 5 == 0).alias("confirmed"), (k % 29 == 0).alias("rejected"),
        F.when(k % 31 == 0, "suspicious").otherwise("").alias("review"), F.concat(F.lit("photo"), (k % 120).cast("string")).alias("filename"),
        F.concat(F.lit("key"), F.floor(k / 2).cast("string")).alias("identity_key"), F.col("embedding").cast("array<double>").alias("embedding"),
        F.concat(F.lit("lib"), (k % 4).cast("string")).alias("library_id"), (k % 80).alias("left"), (k % 70).alias("top"),
        (k % 50 + 1).alias("width"), (k % 40 + 1).alias("height"), F.lit(100).alias("image_width"), F.lit(90).alias("image_height"),
    )


FACES = """face AS (SELECT 'f' || lpad(vec_id::VARCHAR, 6, '0') AS face_id, vec_id AS pos, CASE WHEN vec_id % 14 <> 0 THEN 'p' || label END AS person_id,
  (vec_id * 37 % 100) / 100.0 AS confidence, vec_id % 5 = 0 AS confirmed, vec_id % 29 = 0 AS rejected, CASE WHEN vec_id % 31 = 0 THEN 'suspicious' ELSE '' END AS review,
  'photo' || (vec_id % 120) AS filename, 'key' || (vec_id // 2) AS identity_key, embedding::DOUBLE[] AS embedding,
  'lib' || (vec_id % 4) AS library_id, vec_id % 80 AS "left", vec_id % 70 AS top, vec_id % 50 + 1 AS width, vec_id % 40 + 1 AS height, 100 AS image_width, 90 AS image_height FROM embeddings)"""


def people(spark, sf_dir: str) -> DataFrame:
    """Person p8 has no row (orphans), and lists hold a rejected and a dangling face."""
    f = faces(spark, sf_dir).where("person_id is not null and person_id <> 'p8'")
    lists = f.groupBy("person_id").agg(F.array_sort(F.collect_set("face_id")).alias("face_ids"))
    n = F.substring("person_id", 2, 9).cast("int")
    return lists.select("person_id", F.when(n % 3 != 0, F.concat(F.lit("Ann "), F.col("person_id"))).otherwise("").alias("name"), F.concat("face_ids", F.array(F.concat(F.lit("gone"), "person_id"))).alias("face_ids"))


PEOPLE = (
    FACES
    + """, person AS (SELECT person_id, CASE WHEN substr(person_id, 2)::INT % 3 <> 0 THEN 'Ann ' || person_id ELSE '' END AS name,
  list_append(list_sort(list(DISTINCT face_id)), 'gone' || person_id) AS face_ids FROM face WHERE person_id IS NOT NULL AND person_id <> 'p8' GROUP BY person_id),
  member AS (SELECT person_id, unnest(face_ids) AS face_id FROM person)"""
)


def metrics(spark, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", "ts", F.col("event_type").alias("metric"), F.col("value").alias("bytes"), "user_id")


def albums(spark, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("album_id"), F.concat(F.lit("Album "), F.col("o_orderkey").cast("string")).alias("name"), (F.col("o_orderstatus") == "O").alias("is_public"),
        F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("t"), F.col("o_orderkey").cast("string"))).alias("token"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderdate")).alias("expires"),
    )


ALBUMS = """album AS (SELECT o_orderkey AS album_id, 'Album ' || o_orderkey AS name, o_orderstatus = 'O' AS is_public,
  CASE WHEN o_orderkey % 3 <> 0 THEN 't' || o_orderkey END AS token, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate END AS expires FROM orders)"""


def album_files(spark, sf_dir: str) -> DataFrame:
    """(album_id, filenames) from order lines, in the order of their numbers; some name photos that do not exist."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("album_id"), "l_linenumber", F.concat(F.lit("photo"), F.col("l_partkey").cast("string")).alias("filename"))
    return rows.groupBy("album_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "filename"))), lambda x: x["filename"]).alias("filenames"))


ALBUM_FILES = """entry AS (SELECT l_orderkey AS album_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, 'photo' || l_partkey) - 1 AS pos,
  'photo' || l_partkey AS filename FROM lineitem)"""


def named_photos(spark, sf_dir: str) -> DataFrame:
    """(filename, photo_id) under the names that albums use; every tenth is missing."""
    return read(spark, sf_dir, "part").where("p_partkey % 10 <> 0").select(F.concat(F.lit("photo"), F.col("p_partkey").cast("string")).alias("filename"), F.col("p_partkey").alias("photo_id"))


NAMED = "named AS (SELECT 'photo' || p_partkey AS filename, p_partkey AS photo_id FROM part WHERE p_partkey % 10 <> 0)"


def memberships(spark, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    first = c.groupBy("c_nationkey").agg(F.min("c_custkey").alias("owner"))
    return c.join(first, "c_nationkey").select(F.col("c_nationkey").alias("library_id"), F.col("c_custkey").alias("user_id"), (F.col("c_custkey") == F.col("owner")).alias("is_owner"))


MEMBERS = "membership AS (SELECT c_nationkey AS library_id, c_custkey AS user_id, c_custkey = min(c_custkey) OVER (PARTITION BY c_nationkey) AS is_owner FROM customer)"


def invites(spark, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("invite_id"), (F.col("o_custkey") % 25).cast("int").alias("library_id"), F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "O", "accepted").otherwise("revoked").alias("status"),
        F.when(F.col("o_orderkey") % 2 == 0, "join").otherwise("fresh").alias("target"), F.col("o_orderdate").alias("expires"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("token_hash"),
    )


INVITES = """invite AS (SELECT o_orderkey AS invite_id, (o_custkey % 25)::INT AS library_id, CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'O' THEN 'accepted' ELSE 'revoked' END AS status,
  CASE WHEN o_orderkey % 2 = 0 THEN 'join' ELSE 'fresh' END AS target, o_orderdate AS expires, sha256(o_orderkey::VARCHAR) AS token_hash FROM orders)"""


def image_files(spark, sf_dir: str) -> DataFrame:
    """(photo_id, path, kind, content): a small JPEG or PNG for each part, with its brand, a date and a place as EXIF. Every
    seventh lacks its last byte, and in every eleventh a byte of the EXIF block is another one."""
    k, text = F.col("p_partkey"), lambda b: F.lit(b.hex())
    word = lambda c, n=8: F.lpad(F.hex(c), n, "0")
    triple = lambda *v: F.concat(*(word(F.lit(x) if isinstance(x, int) else x) for x in v))
    of_text = lambda c, n: F.rpad(F.hex(c.cast("binary")), n * 2, "0")
    date = F.date_format(F.date_add(F.lit("2020-06-01").cast("date"), F.col("p_size")), "yyyy:MM:dd' 10:20:30'")
    # Directories at 8, 62 and 80, values from 134 on.
    tiff = F.concat(
        text(b"MM\0*\0\0\0\x08" + bytes.fromhex("0004 010f0002 00000020 00000086 01120003 00000001 00060000 87690004 00000001 0000003e 88250004 00000001 00000050 00000000")),
        text(bytes.fromhex("0001 90030002 00000014 000000a6 00000000 0004 00010002 00000002 53000000 00020005 00000003 000000ba 00030002 00000002 45000000 00040005 00000003 000000d2 00000000")),
        of_text(F.col("p_brand"), 32), of_text(date, 20), triple(k % 90, 1, k % 60, 1, (k * 7) % 6000, 100), triple(k % 180, 1, k % 59, 1, (k * 3) % 6000, 100),
    )
    rows = computed_once(read(spark, sf_dir, "part").select(k.alias("photo_id"), tiff.alias("tiff"), F.hex(F.md5(k.cast("string"))).alias("body")))
    k, block, body = F.col("photo_id"), F.col("tiff"), F.col("body")
    chunk = lambda kind, c: F.concat(word(F.floor(F.length(c) / 2)), text(kind), c, word(F.crc32(F.unhex(F.concat(text(kind), c)))))
    jpeg = F.concat(text(b"\xff\xd8\xff\xe1"), word(F.floor(F.length(block) / 2) + 8, 4), text(b"Exif\0\0"), block, text(b"\xff\xc0\0\x0b\x08\0\1\0\1\1\1\x11\0\xff\xda\0\x08\1\1\0\0\x3f\0"), body, text(b"\0\xff\0\xff\xd9"))
    png = F.concat(text(b"\x89PNG\r\n\x1a\n"), chunk(b"IHDR", text(bytes((0, 0, 0, 1, 0, 0, 0, 1, 8, 0, 0, 0, 0)))), chunk(b"eXIf", block), chunk(b"IDAT", body), chunk(b"IEND", F.lit("")))
    rows = computed_once(rows.select("photo_id", F.when(k % 2 == 0, jpeg).otherwise(png).alias("hex")))
    # A byte of the brand, which starts 134 bytes after the block does.
    rows = rows.withColumn("at", F.locate("4d4d002a", F.lower("hex")) + 2 * 134)
    changed = F.when(k % 11 == 0, F.overlay("hex", F.lit("3F"), F.col("at"))).otherwise(F.col("hex"))
    size = F.length("hex") - F.when(k % 7 == 0, 2).otherwise(0)
    name = F.concat(F.lit("photo"), k.cast("string"), F.when(k % 2 == 0, ".jpg").otherwise(".png"))
    return rows.select("photo_id", name.alias("path"), F.lit("native").alias("kind"), F.unhex(F.substring(changed, F.lit(1), size)).alias("content"))
