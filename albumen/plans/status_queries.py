"""Processing states, throughput, smart albums, members and limits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from albumen.functions import text
from albumen.operators import grouping as G
from albumen.operators import ingest as I
from albumen.operators import maintenance as X
from albumen.operators import membership as M
from albumen.operators import status as T
from albumen.plans import standins as S
from albumen.plans.registry import query

W, ST = "WITH " + S.PHOTOS, "WITH " + S.STATES_SQL


def now():
    return F.lit(S.NOW).cast("timestamp")


@query(f"""{ST} SELECT stage, count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'running') AS running,
count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'no_data') AS no_data, count(*) FILTER (status IN ('queued', 'pending')) AS pending_total FROM long_state GROUP BY stage""")
def status_matrix(spark, sf_dir):
    """A1: over all rows."""
    return T.matrix(S.states(spark, sf_dir))


@query("""WITH m(metric) AS (VALUES ('click'), ('view'), ('purchase'), ('upload')), s AS (SELECT event_type AS metric, count(*) AS n, sum(value) AS bytes FROM events
WHERE ts > TIMESTAMP '2024-01-30 00:00:00' AND ts <= TIMESTAMP '2024-01-31 00:00:00' GROUP BY 1)
SELECT m.metric, coalesce(n, 0) AS n, round(coalesce(bytes, 0), 6) AS bytes, round(coalesce(bytes, 0) / 86400, 6) AS bytes_per_s, round(coalesce(bytes, 0) / 86400 / 1e6, 2) AS mb_per_s FROM m LEFT JOIN s USING (metric)""")
def throughput_window(spark, sf_dir):
    """A2: the last day; metrics without events get zeros."""
    wanted = spark.createDataFrame([(m,) for m in ("click", "view", "purchase", "upload")], "metric string")
    out = T.throughput(S.metrics(spark, sf_dir), now(), 24 * 60, wanted)
    return out.withColumns({c: F.round(c, 6) for c in ("bytes", "bytes_per_s")})


@query(f"{ST} SELECT photo_id FROM state WHERE ocr_status = 'failed'")
def stage_filter(spark, sf_dir):
    """F9, one stage."""
    return T.stage_filter(S.states(spark, sf_dir), "ocr", "failed").select("photo_id")


@query(f"{ST} SELECT DISTINCT photo_id FROM long_state WHERE status = 'running'")
def stage_filter_any(spark, sf_dir):
    """F9, any stage."""
    return T.stage_filter(S.states(spark, sf_dir), "all", "running").select("photo_id")


@query(f"{ST} SELECT DISTINCT photo_id FROM long_state WHERE status IN ('failed', 'no_data')")
def needs_attention(spark, sf_dir):
    """F10."""
    return T.needs_attention(S.states(spark, sf_dir)).select("photo_id")


_PENDING = f"""{ST}, e AS (SELECT l.photo_id, l.stage, s.updated, CASE WHEN l.stage = 'face' AND s.face_throttled AND l.status <> 'done' THEN 'pending'
 WHEN l.stage = 'ai_vision' AND s.retry_ai AND l.status IN ('failed', 'no_data', 'skipped', 'timeout') THEN 'pending'
 WHEN l.status = 'running' AND s.lease_expires > TIMESTAMP '{S.NOW}' THEN 'held' WHEN l.status = 'running' THEN 'pending' ELSE l.status END AS status
 FROM long_state l JOIN state s USING (photo_id) WHERE coalesce(s.processing_state, '') <> 'deleted' AND l.stage <> 'verify')
SELECT photo_id, string_agg(stage, ',' ORDER BY list_position(['thumbnail', 'exif', 'ocr', 'ai_vision', 'map_detection', 'face'], stage)) AS stages, min(updated) AS updated
FROM e WHERE status NOT IN ('held', 'done', 'no_data', 'deleted', 'skipped', 'unsupported', 'failed', 'timeout') GROUP BY photo_id"""


@query(_PENDING)
def pending_work(spark, sf_dir):
    """F11."""
    return T.pending(S.states(spark, sf_dir), now())


@query(f"SELECT * FROM ({_PENDING}) ORDER BY updated, photo_id LIMIT 25")
def pending_queue(spark, sf_dir):
    """T5: the limit of 25 is the feature."""
    return T.pending_queue(S.states(spark, sf_dir), now(), 100)


@query(f"{ST} SELECT photo_id FROM state WHERE exif_status = 'running' AND updated < TIMESTAMP '{S.NOW}' - INTERVAL 900 SECOND")
def stuck_running(spark, sf_dir):
    """ST5."""
    return T.stuck(S.states(spark, sf_dir), now(), "exif").select("photo_id")


@query(f"{ST} SELECT photo_id, CASE WHEN exif_status = 'done' THEN 'already_done' WHEN exif_status = 'running' AND NOT (updated < TIMESTAMP '2024-01-20') THEN 'already_running' ELSE 'queued' END AS result FROM state")
def requeue_steps(spark, sf_dir):
    """ST7."""
    return S.states(spark, sf_dir).select("photo_id", T.requeue(F.col("exif_status"), F.col("updated") < F.lit("2024-01-20").cast("timestamp"), False).alias("result"))


_REPORTS = """report AS (SELECT row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, user_id AS key, ['exif', 'ocr', 'face', 'ai_vision'][event_id % 4 + 1] AS step,
 ['done', 'failed', 'skipped', 'timeout', 'unsupported', 'other'][event_id // 4 % 6 + 1] AS status, ['none', 'background_throttled', 'model_unavailable', 'raw_preview_missing'][event_id // 24 % 4 + 1] AS reason FROM events e)"""


@query(f"""WITH {_REPORTS}, cur AS (SELECT u.user_id AS key, s.stage, ['done', 'running', 'queued', 'no_data'][(u.user_id + length(s.stage)) % 4 + 1] AS status FROM (SELECT DISTINCT user_id FROM events WHERE event_id % 3 = 0) u, (VALUES ('exif'), ('ocr'), ('face'), ('verify')) s(stage)),
n0 AS (SELECT * FROM report WHERE pos < 20), n AS (SELECT key, step, pos, CASE WHEN status = 'done' THEN 'done' WHEN status IN ('failed', 'timeout') THEN CASE WHEN step = 'ai_vision' AND reason IN ('model_unavailable', 'raw_preview_missing') THEN 'pending' ELSE 'failed' END
 WHEN status = 'unsupported' THEN 'unsupported' WHEN status = 'skipped' THEN CASE WHEN step = 'face' AND reason = 'background_throttled' OR step = 'ai_vision' AND reason IN ('model_unavailable', 'raw_preview_missing') THEN 'pending' WHEN reason = 'raw_preview_missing' THEN 'no_data' ELSE 'skipped' END END AS new FROM n0),
l AS (SELECT key, step AS stage, coalesce(min_by(new, pos) FILTER (new IN ('done', 'no_data')), max_by(new, pos)) AS new FROM n WHERE new IS NOT NULL GROUP BY 1, 2)
SELECT c.key, c.stage, CASE WHEN c.status IN ('done', 'no_data') THEN c.status WHEN l.new IS NOT NULL THEN l.new WHEN c.status = 'running' AND c.stage <> 'verify' AND c.key IN (SELECT key FROM l) THEN 'no_data' ELSE c.status END AS status
FROM cur c LEFT JOIN l ON c.key = l.key AND c.stage = l.stage""")
def report_merge(spark, sf_dir):
    """Reports merged into states."""
    pick = lambda n, *v: F.element_at(F.array(*map(F.lit, v)), (n + 1).cast("int"))
    e = S.read(spark, sf_dir, "events")
    k = F.col("event_id")
    reports = e.select((F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).alias("pos"), F.col("user_id").alias("key"), pick(k % 4, "exif", "ocr", "face", "ai_vision").alias("step"), pick(F.floor(k / 4) % 6, "done", "failed", "skipped", "timeout", "unsupported", "other").alias("status"), pick(F.floor(k / 24) % 4, "none", "background_throttled", "model_unavailable", "raw_preview_missing").alias("reason"))
    cur = e.where("event_id % 3 = 0").select(F.col("user_id").alias("key")).distinct().select("key", F.explode(F.array(*map(F.lit, ("exif", "ocr", "face", "verify")))).alias("stage"))
    cur = cur.withColumn("status", pick((F.col("key") + F.length("stage")) % 4, "done", "running", "queued", "no_data"))
    return T.merge_reports(cur, reports)


@query(f"""{ST} SELECT photo_id, CASE WHEN photo_id % 2 = 0 THEN 'done' ELSE thumbnail_status END AS thumbnail_status, CASE WHEN photo_id % 3 <> 0 THEN 'done' ELSE exif_status END AS exif_status,
 CASE WHEN photo_id % 5 = 1 THEN 'done' WHEN photo_id % 5 = 2 THEN 'no_data' ELSE ocr_status END AS ocr_status, CASE WHEN photo_id % 7 = 3 AND photo_id % 200 <= 90 THEN 'done' WHEN photo_id % 3 = 1 THEN 'done' WHEN photo_id % 3 = 2 THEN 'no_data' ELSE map_detection_status END AS map_detection_status,
 CASE WHEN photo_id % 11 = 4 THEN 'no_data' WHEN photo_id % 11 = 5 THEN 'done' ELSE ai_vision_status END AS ai_vision_status, CASE photo_id % 4 WHEN 1 THEN 'done' WHEN 2 THEN 'pending' WHEN 3 THEN 'failed' ELSE face_status END AS face_status,
 CASE photo_id % 4 WHEN 1 THEN 2 WHEN 0 THEN 9 ELSE 0 END AS face_count, CASE WHEN photo_id % 5 = 1 THEN 'read me' ELSE '' END AS ocr_text, CASE WHEN photo_id % 7 = 3 AND photo_id % 200 <= 90 THEN (photo_id % 200)::DOUBLE WHEN photo_id % 3 = 1 THEN 12.5 END AS latitude FROM state""")
def ingest_merge(spark, sf_dir):
    """All six results of an upload applied to its row."""
    k, df = F.col("photo_id"), S.states(spark, sf_dir)
    text_ = lambda c: c.cast("string")
    none, no, yes = F.lit(None).cast("string"), F.lit(False), F.lit(True)
    face = lambda score: F.struct(F.lit(score).alias("confidence"), *[F.lit(10.0).alias(c) for c in ("width", "height")], *[F.lit(100.0).alias(c) for c in ("image_width", "image_height")], F.array(F.lit(1.0)).alias("embedding"))
    found = F.when(k % 4 == 1, F.array(face(0.9), face(0.5), face(0.1))).otherwise(F.array(face(0.1)))
    parts = {
        "thumbnail": F.struct((k % 2 == 0).alias("uploaded")),
        "exif": F.when(k % 3 != 0, F.struct(yes.alias("has_data"), F.create_map(F.lit("Make"), F.lit("m")).alias("data"), F.when(k % 3 == 1, "12.5").otherwise("").alias("latitude"), F.lit("7").alias("longitude"))),
        "ocr": F.when(k % 5 > 0, F.struct((k % 5 != 2).alias("has_data"), F.when(k % 5 == 1, " read me ").otherwise("").alias("text"))),
        "map": F.when(k % 7 == 3, F.struct(yes.alias("has_data"), text_(k % 200).alias("latitude"), F.lit("8").alias("longitude"), *[none.alias(c) for c in ("address", "city", "country")])),
        "face": F.when(k % 4 > 0, F.struct(yes.alias("has_data"), found.alias("faces"), F.when(k % 4 == 2, "background_throttled").otherwise("").alias("deferred"), F.when(k % 4 == 3, "descriptor_failed").otherwise("").alias("failure_stage"))),
        "ai": F.when((k % 11).isin(4, 5, 6), F.struct(yes.alias("has_data"), (k % 11 != 6).alias("model_ready"), (k % 11 == 4).alias("fallback"), F.array(F.lit("dogs")).alias("tags"), *[none.alias(c) for c in ("caption", "ocr_text", "person_label", "person_score")], no.alias("person_candidate"))),
    }
    df = df.withColumns({f"r_{n}": p.cast(I.RESULT[n]) for n, p in parts.items()}).withColumns({c: F.lit("") for c in ("ocr_text", "caption", "person_label", "lease_owner")})
    df = df.withColumns({"latitude": none, "longitude": none, "exif": F.lit(None).cast("map<string,string>"), "face_count": F.lit(9), "person_score": F.lit(0.0), "person_candidate": no, "faces": F.lit(None).cast(I.RESULT["face"].split("faces:")[1].split(",deferred")[0])})
    return I.merge_results(df).select("photo_id", *[f"{s}_status" for s in T.CLIENT_STAGES], "face_count", "ocr_text", F.col("latitude").cast("double").alias("latitude"))


_MESSAGES = ("no idea", "BACKGROUND_THROTTLED", "unsupported_runtime: timeout", "model_budget_exceeded", "ArcFace_model_load_failed", "face_api_load_failed", "module_import_failed")
_MARKS = ((), ("model_load_started",), ("model_load_started", "model_load_done", "detection_started"), ("descriptor_started", "detection_started", "detection_done"), ("embedding_model_load_started", "descriptor_started"), ("descriptor_started", "descriptor_done"))


@query(f"""WITH x AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'dedupe_failed' END AS stated, {list(_MESSAGES)}[event_id % 7 + 1] AS message, event_id % 6 AS m FROM events)
SELECT event_id, CASE WHEN stated IS NOT NULL THEN stated WHEN contains(lower(message), 'background_throttled') THEN 'background_throttled' WHEN contains(message, 'unsupported_runtime') THEN 'unsupported_runtime'
 WHEN contains(message, 'model_budget_exceeded') THEN 'timeout' WHEN contains(lower(message), 'arcface_model_load_failed') THEN 'embedding_model_load_failed' WHEN contains(message, 'face_api_load_failed') THEN 'face_api_load_failed' WHEN contains(message, 'module_import_failed') THEN 'model_load_failed'
 ELSE ['unknown', 'model_load_failed', 'detection_failed', 'descriptor_failed', 'embedding_model_load_failed', 'unknown'][m + 1] END AS stage FROM x""")
def failure_stage(spark, sf_dir):
    """X23."""
    k = F.col("event_id")
    pick = lambda values, n: F.element_at(F.array(*values), (n + 1).cast("int"))
    marks = [F.array(*map(F.lit, m)).cast("array<string>") for m in _MARKS]
    return S.read(spark, sf_dir, "events").select("event_id", T.failure_stage(F.when(k % 11 == 0, "dedupe_failed"), pick(map(F.lit, _MESSAGES), k % 7), pick(marks, k % 6)).alias("stage"))


_N = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_TAKEN = "coalesce(strptime(captured, '%Y:%m:%d %H:%M:%S'), uploaded)"
_PLACE = "coalesce(nullif(concat_ws(', ', city, country), ''), address)"
# Rule: label, rows, time, key, order of rows.
_RULES = {
    "location": (f"'Location: ' || {_PLACE}", "photo", _TAKEN, _N.format(_PLACE), "pos"),
    "recent": ("'Uploaded: ' || strftime(uploaded, '%b %-d, %Y')", "photo", "uploaded", "strftime(uploaded, '%Y-%m-%d')", "pos"),
    "event": (f"'Event: ' || strftime({_TAKEN}, '%b %-d, %Y')", "photo", _TAKEN, f"strftime({_TAKEN}, '%Y-%m-%d')", "pos"),
    "tag": ("'Tag/Object: ' || CASE WHEN tag = lower(tag) THEN upper(tag[1]) || tag[2:] ELSE tag END", "(SELECT *, unnest(list_concat(tags, objects)) AS tag, generate_subscripts(list_concat(tags, objects), 1) AS k FROM photo)", _TAKEN, _N.format("tag"), "pos * 1000 + k"),
    "person": ("'Person: ' || CASE WHEN substr(person, 2)::INT % 3 <> 0 THEN 'Ann ' || person ELSE 'Person ' || person END", "(SELECT *, unnest(list_distinct(people)) AS person FROM photo)", _TAKEN, "person", "pos"),
}
_ORDER = {"recent": "latest DESC NULLS LAST, n DESC", "event": "latest DESC NULLS LAST, n DESC"}


def _names(spark):
    n = F.col("id").cast("string")
    return spark.range(10).select(F.concat(F.lit("p"), n).alias("person_id"), F.when(F.col("id") % 3 != 0, F.concat(F.lit("Ann p"), n)).otherwise("").alias("name"))


for _rule, (_label, _from, _at, _key, _pos) in _RULES.items():
    _sql = f"{W}, r AS (SELECT {_key} AS key, {_label} AS label, filename, {_at} AS moment, {_pos} AS pos FROM {_from}), g AS (SELECT key, min_by(label, pos) AS name, max(moment) AS latest, count(DISTINCT filename) AS n FROM r WHERE key <> '' GROUP BY key) "

    def _groups(spark, sf_dir, rule=_rule):
        return G.fold(G.keyed(S.photos(spark, sf_dir, spread=True), rule, _names(spark)))

    _groups.__name__, _groups.__doc__ = f"smart_album_{_rule}", "A3-A8: the groups of this rule."
    query(_sql + "SELECT * FROM g")(_groups)

    def _next(spark, sf_dir, rule=_rule):
        groups = G.fold(G.keyed(S.photos(spark, sf_dir, spread=True), rule, _names(spark)))
        return G.next_album(groups, rule, groups.where(F.col("key").rlike("[02468]$")).select("name"))

    _next.__name__, _next.__doc__ = f"next_smart_album_{_rule}", "T6, J5: the best group whose name no album has."
    query(_sql + f"SELECT * FROM g WHERE lower(trim(name)) NOT IN (SELECT lower(trim(name)) FROM g WHERE regexp_matches(key, '[02468]$')) ORDER BY {_ORDER.get(_rule, 'n DESC, latest DESC NULLS LAST')}, name DESC NULLS LAST, key LIMIT 1")(_next)


@query(f"{W}, r AS (SELECT DISTINCT country, filename, photo_id FROM photo WHERE country IS NOT NULL) SELECT lower(country) AS key, string_agg(filename, ',' ORDER BY photo_id) AS filenames FROM r GROUP BY 1")
def group_files(spark, sf_dir):
    """Distinct files in the order first seen."""
    rows = S.photos(spark, sf_dir).where("country is not null").select(F.lower("country").alias("key"), "filename", "pos")
    return G.files_in_order(rows.unionByName(rows)).select("key", F.array_join("filenames", ",").alias("filenames"))


@query(f"WITH {S.MEMBERS} SELECT m.library_id, user_id, is_owner, coalesce(n_name, '') AS name FROM membership m LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 5 <> 0) ON m.library_id = n_nationkey")
def member_libraries(spark, sf_dir):
    """J6."""
    lib = S.read(spark, sf_dir, "nation").where("n_nationkey % 5 <> 0").select(F.col("n_nationkey").alias("library_id"), F.col("n_name").alias("name"))
    return M.libraries_of(S.memberships(spark, sf_dir), lib)


@query(f"WITH {S.MEMBERS} SELECT user_id, is_owner, c_name || '@x.org' AS email FROM membership JOIN customer ON user_id = c_custkey WHERE library_id = 7")
def library_members(spark, sf_dir):
    """J7."""
    accounts = S.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.concat("c_name", F.lit("@x.org")).alias("email"))
    return M.members_of(S.memberships(spark, sf_dir), accounts, 7).select("user_id", "is_owner", "email")


@query(f"""WITH {S.MEMBERS}, {S.INVITES}, m AS (SELECT library_id, count(*) AS members FROM membership GROUP BY 1), i AS (SELECT library_id, count(*) AS n FROM invite WHERE status = 'pending' AND target = 'join' AND expires > TIMESTAMP '2001-07-25' GROUP BY 1)
SELECT coalesce(m.library_id, i.library_id) AS library_id, coalesce(members, 0) AS members, coalesce(n, 0) AS open_invites, coalesce(members, 0) + coalesce(n, 0) < 15 AS may_invite FROM m FULL JOIN i ON m.library_id = i.library_id""")
def invite_capacity(spark, sf_dir):
    """A15."""
    return M.capacity(S.memberships(spark, sf_dir), S.invites(spark, sf_dir), F.lit("2001-07-25").cast("timestamp"))


@query(f"WITH {S.MEMBERS} SELECT library_id, count(*) AS members, count(*) < 15 AS may_accept FROM membership GROUP BY 1")
def accept_capacity(spark, sf_dir):
    """A23."""
    return M.may_accept(S.memberships(spark, sf_dir))


@query(f"WITH {S.INVITES} SELECT invite_id, library_id FROM invite WHERE token_hash = sha256('1234') AND status IN ('pending', 'accepted', 'revoked') AND status = 'pending' AND expires > TIMESTAMP '1990-01-01'")
def invite_lookup(spark, sf_dir):
    """J16."""
    import hashlib

    return M.invite_by_token(S.invites(spark, sf_dir), hashlib.sha256(b"1234").hexdigest(), F.lit("1990-01-01").cast("timestamp")).select("invite_id", "library_id")


@query(f"""WITH {S.MEMBERS}, a AS (SELECT c_custkey AS user_id, (c_custkey % 3)::INT AS token_version, 1000 + c_custkey AS own_library FROM customer WHERE c_custkey % 10 <> 0),
q AS (SELECT o_custkey AS user_id, CASE WHEN o_orderkey % 4 = 0 THEN 1000 + o_custkey ELSE o_orderkey % 25 END AS library_id, (o_orderkey % 3)::INT AS version FROM orders)
SELECT q.user_id, q.library_id FROM q JOIN a USING (user_id) WHERE version = token_version AND (q.library_id = own_library OR EXISTS (SELECT 1 FROM membership m WHERE m.user_id = q.user_id AND m.library_id = q.library_id))""")
def access_gate(spark, sf_dir):
    """J18."""
    c = S.read(spark, sf_dir, "customer").where("c_custkey % 10 <> 0")
    accounts = c.select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 3).cast("int").alias("token_version"), (1000 + F.col("c_custkey")).alias("own_library"))
    o, k = S.read(spark, sf_dir, "orders"), F.col("o_orderkey")
    requests = o.select(F.col("o_custkey").alias("user_id"), F.when(k % 4 == 0, 1000 + F.col("o_custkey")).otherwise(k % 25).alias("library_id"), (k % 3).cast("int").alias("version"))
    return M.may_enter(requests, accounts, S.memberships(spark, sf_dir).withColumn("library_id", F.col("library_id").cast("long")))


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS "at" FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY "at", event_id, user_id) AS k FROM e),
r AS (SELECT user_id, k, event_id, "at", TRUE AS allowed, "at" AS last, "at" AS start, 1 AS n FROM k WHERE k = 1 UNION ALL
 SELECT user_id, k, event_id, "at", ok, CASE WHEN ok THEN "at" ELSE last END, start, n0 + ok::INT FROM (SELECT *, near AND n0 < 3 AS ok FROM (SELECT k.user_id, k.k, k.event_id, k."at", k."at" - last >= 600 AS near, last,
  CASE WHEN k."at" - last >= 600 AND k."at" - start >= 3600 THEN k."at" ELSE start END AS start, CASE WHEN k."at" - last >= 600 AND k."at" - start >= 3600 THEN 0 ELSE n END AS n0 FROM r JOIN k ON r.user_id = k.user_id AND k.k = r.k + 1)))
SELECT event_id, user_id, "at", allowed FROM r""")
def rate_limiter(spark, sf_dir):
    """Which events pass a gap of an hour and 3 a window, per user; decided in order."""
    e = S.read(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return M.rate_limited(e.select("event_id", "user_id", F.floor(F.col("us") / 1_000_000).alias("at")), "user_id", "at", gap=600, per_window=3)


@query("""WITH e AS (SELECT event_id, user_id, epoch_us(ts) // 24000000 AS "at" FROM events WHERE event_type = 'error'), g AS (SELECT *, CASE WHEN "at" - lag("at") OVER w > 3600 THEN 1 ELSE 0 END AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY "at", event_id)),
 s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY "at", event_id) AS part FROM g), n AS (SELECT *, row_number() OVER (PARTITION BY user_id, part ORDER BY "at", event_id) AS n FROM s)
SELECT event_id, user_id, "at", CASE WHEN n > 5 THEN least(30 * power(2, least(n - 6, 30)), 900) ELSE 0 END::INT AS lock_seconds FROM n""")
def login_lockout(spark, sf_dir):
    """Seconds of lock after each failure of an account, a day counted as an hour."""
    e = S.read(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", "user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 24_000_000).alias("at"))
    return M.locked_out(e, "user_id", "at")


@query("SELECT coalesce(max(TRY_CAST(regexp_extract(name, '^unnamed *([0-9]+)$', 1, 'i') AS BIGINT)), 0) + 1 AS next FROM (SELECT CASE WHEN c_custkey % 3 = 0 THEN 'Unnamed ' || c_custkey WHEN c_custkey % 3 = 1 THEN 'uNNamed' || 2 * c_custkey ELSE c_name END AS name FROM customer)")
def next_unnamed(spark, sf_dir):
    """A18."""
    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("Unnamed "), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit("uNNamed"), (2 * k).cast("string"))).otherwise(F.col("c_name"))
    return X.next_unnamed(S.read(spark, sf_dir, "customer").select(name.alias("name")))


@query("SELECT c_custkey AS person_id, c_custkey % 5 < 3 AS unnamed FROM customer")
def unnamed_names(spark, sf_dir):
    """Names that stand for no name."""
    k = F.col("c_custkey")
    name = F.when(k % 5 == 0, " unnamed ").when(k % 5 == 1, F.concat(F.lit("Unnamed"), k.cast("string"))).when(k % 5 == 2, "UNNAMED  12").when(k % 5 == 3, "unnamed x")
    return S.read(spark, sf_dir, "customer").select(k.alias("person_id"), text.is_unnamed(name).alias("unnamed"))


@query("""WITH p AS (SELECT c_custkey AS person_id, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name END AS name FROM customer), d AS (SELECT *, CASE WHEN name = '' THEN 'Unnamed ' || count(*) FILTER (name = '') OVER (ORDER BY person_id) ELSE name END AS display_name FROM p)
SELECT * FROM d WHERE contains(lower(display_name), '12')""")
def person_search(spark, sf_dir):
    """Nameless people are numbered by key, and names searched."""
    p = S.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person_id"), F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.col("c_name")).alias("name"))
    return X.numbered(p).where(F.lower("display_name").contains("12"))


@query("SELECT c_custkey AS user_id, lower(c_name) || '@x.org' AS email, upper(substr(c_name, 1, 1)) || '***@X.org' AS masked FROM customer")
def email_values(spark, sf_dir):
    """X22."""
    e = F.concat(F.lit(" "), "c_name", F.lit("@X.org "))
    return S.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), text.normalize_email(e).alias("email"), text.mask_email(F.trim(e)).alias("masked"))


@query(f"""{W} SELECT photo_id, CASE WHEN photo_id % 2 = 0 OR photo_id % 5 = 0 OR photo_id % 7 = 0 OR photo_id % 11 = 0 OR photo_id % 13 = 0 THEN 'clear' ELSE 'delete' END AS action FROM photo WHERE photo_id % 3 = 0 OR photo_id % 4 = 1""")
def failed_upload_cleanup(spark, sf_dir):
    """P19."""
    k, some = F.col("photo_id"), lambda n, v: F.when(F.col("photo_id") % n == 0, v).otherwise("")
    df = S.photos(spark, sf_dir).select(
        "photo_id", F.when(k % 3 == 0, F.lit("[]")).alias("received_ranges"), F.when(k % 4 == 1, F.lit(0)).alias("upload_total_size"),
        some(2, "h").alias("file_hash"), some(5, "p").alias("perceptual_hash"), some(7, "image/png").alias("mime_type"), some(11, "queued").alias("thumbnail_status"), some(13, "failed").alias("verification_status"),
    )
    return X.clean_failed_uploads(df)


_JOB_KEYS = ("processing:u1:a.jpg:exif", "u1:a.jpg", "a.jpg-7", "processing:u2:a.jpg:exif", "exif:a.jpg", "b.jpg")


@query(f"""WITH j AS (SELECT o_orderkey AS n, CASE WHEN o_orderkey % 50 = 7 THEN 'a.jpg' END AS filename, CASE o_orderkey % 3 WHEN 0 THEN 'u1' WHEN 1 THEN 'u2' END AS user_id,
 CASE WHEN o_orderkey % 90 = 3 THEN 'a.jpg' WHEN o_orderkey % 90 = 4 THEN 'u1:a.jpg:9' END AS correlation_id, CASE WHEN o_orderkey % 60 < 6 THEN {list(_JOB_KEYS)}[o_orderkey % 60 + 1] END AS job_id, CASE WHEN o_orderkey % 70 < 6 THEN {list(_JOB_KEYS)}[o_orderkey % 70 + 1] END AS row_key FROM orders)
SELECT n FROM j WHERE (filename = 'a.jpg' OR correlation_id = 'a.jpg') AND coalesce(user_id, 'u1') = 'u1' OR regexp_matches(concat_ws(chr(10), job_id, row_key, correlation_id), '(^|\n)(processing:u1:a[.]jpg|u1:a[.]jpg|a[.]jpg)')""")
def job_matching(spark, sf_dir):
    """P20: jobs of a user's photo, by name, user and keys."""
    k = F.col("o_orderkey")
    key = lambda n: F.when(k % n < 6, F.element_at(F.array(*map(F.lit, _JOB_KEYS)), F.least(k % n + 1, F.lit(6)).cast("int")))
    jobs = S.read(spark, sf_dir, "orders").select(
        k.alias("n"), F.when(k % 50 == 7, "a.jpg").alias("filename"), F.when(k % 3 == 0, "u1").when(k % 3 == 1, "u2").alias("user_id"),
        F.when(k % 90 == 3, "a.jpg").when(k % 90 == 4, "u1:a.jpg:9").alias("correlation_id"), key(60).alias("job_id"), key(70).alias("row_key"),
    )
    return X.jobs_of(jobs, "u1", "a.jpg").select("n")


@query("""WITH c AS (SELECT c_custkey AS face_id, 'now' AS person_id, TRUE AS confirmed, c_acctbal AS confidence, c_name AS filename FROM customer WHERE c_custkey % 2 = 0),
 s AS (SELECT c_custkey AS face_id, 'then' AS person_id, FALSE AS confirmed, -1.0::DOUBLE AS confidence, 'old ' || c_name AS filename FROM customer WHERE c_custkey % 3 = 0)
SELECT coalesce(c.face_id, s.face_id) AS face_id, s.person_id, s.confirmed, CASE WHEN s.face_id IS NULL THEN c.confidence ELSE s.confidence END AS confidence, coalesce(c.filename, s.filename) AS filename,
 CASE WHEN c.face_id IS NULL THEN 'inserted' WHEN s.face_id IS NULL THEN 'cleared' ELSE 'restored' END AS what FROM c FULL JOIN s ON c.face_id = s.face_id""")
def snapshot_restore(spark, sf_dir):
    """Faces only in the table lose owner and confirmation, and keep the rest."""
    c, k = S.read(spark, sf_dir, "customer"), F.col("c_custkey")
    make = lambda rows, who, sure, score, name: rows.select(k.alias("face_id"), F.lit(who).alias("person_id"), F.lit(sure).alias("confirmed"), score.alias("confidence"), name.alias("filename"))
    now_ = make(c.where("c_custkey % 2 = 0"), "now", True, F.col("c_acctbal"), F.col("c_name"))
    then = make(c.where("c_custkey % 3 = 0"), "then", False, F.lit(-1.0), F.concat(F.lit("old "), F.col("c_name")))
    return X.restore_snapshot(now_, then)


@query(f"WITH {S.ALBUM_FILES}, e AS (SELECT album_id, pos, filename FROM entry WHERE substr(filename, 6)::INT % 7 <> 0) SELECT o_orderkey AS album_id, coalesce((SELECT string_agg(filename, ',' ORDER BY pos) FROM e WHERE e.album_id = o_orderkey), '') AS filenames FROM orders WHERE o_orderkey IN (SELECT album_id FROM entry)")
def cascade_delete(spark, sf_dir):
    """Albums without the deleted photos."""
    gone = S.read(spark, sf_dir, "part").where("p_partkey % 7 = 0").select(F.concat(F.lit("photo"), F.col("p_partkey").cast("string")).alias("filename"))
    none = gone.limit(0)
    _, _, albums = X.delete_photos(gone, none, none, S.album_files(spark, sf_dir))
    return albums.select("album_id", F.array_join("filenames", ",").alias("filenames"))


@query(f"""WITH {S.PEOPLE}, gone AS (SELECT DISTINCT filename FROM face WHERE substr(filename, 6)::INT % 7 = 0), dead AS (SELECT face_id FROM face WHERE filename IN (FROM gone)),
 lost AS (SELECT DISTINCT person_id FROM face WHERE filename IN (FROM gone) AND person_id NOT IN (SELECT person_id FROM person))
SELECT 'person' AS what, person_id AS key, string_agg(face_id, ',' ORDER BY face_id) AS value FROM member WHERE face_id NOT IN (FROM dead) GROUP BY person_id
UNION ALL SELECT 'photo', filename, coalesce(string_agg(DISTINCT person_id, ',' ORDER BY person_id) FILTER (person_id NOT IN (FROM lost)), '') FROM face WHERE person_id IS NOT NULL AND filename NOT IN (FROM gone) GROUP BY filename""")
def cascade_people(spark, sf_dir):
    """people's lists without the deleted photos' faces, and photos without people who are not there."""
    faces = S.faces(spark, sf_dir)
    photos = faces.where("person_id is not null").groupBy("filename").agg(F.array_sort(F.collect_set("person_id")).alias("people_ids"))
    gone = faces.where(F.substring("filename", 6, 9).cast("int") % 7 == 0).select("filename").distinct()
    people, rest = X.delete_people_of(gone, photos, faces, S.people(spark, sf_dir))
    shown = people.select(F.lit("person").alias("what"), F.col("person_id").alias("key"), F.array_join(F.array_sort("face_ids"), ",").alias("value"))
    return shown.unionByName(rest.select(F.lit("photo").alias("what"), F.col("filename").alias("key"), F.array_join("people_ids", ",").alias("value")))
