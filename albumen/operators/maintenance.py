"""Changes as functions from tables to new tables: merge and undo, split, repair, snapshots, deletion."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from albumen.functions import media, text
from albumen.operators.people import SUSPICIOUS, clusterable, confirmed, rejected, suspicious


def _confirmed(faces: DataFrame, hit: Column) -> DataFrame:
    """faces of which those hit are confirmed by a user: no longer rejected, with a confidence of 1 at least."""
    of = {"confirmed": F.lit(True), "rejected": F.lit(False), "review": F.lit("confirmed"), "confidence": F.greatest(F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)), F.lit(1.0))}
    return faces.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in of.items()})


def _unlisted(people: DataFrame, gone: DataFrame) -> DataFrame:
    """people (person_id, name, face_ids) without the entries of gone (person_id, face_id); whose list is then empty, goes."""
    people = people.select("person_id", "name", "face_ids")
    entries = people.select("person_id", F.posexplode("face_ids").alias("pos", "face_id"))
    touched = entries.join(gone, ["person_id", "face_id"], "left_semi").select("person_id").distinct()
    left = entries.join(touched, "person_id", "left_semi").join(gone, ["person_id", "face_id"], "left_anti")
    lists = left.groupBy("person_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "face_id"))), lambda x: x["face_id"]).alias("face_ids"))
    return people.join(touched, "person_id", "left_anti").unionByName(people.drop("face_ids").join(lists, "person_id"))


def _listed_elsewhere(people: DataFrame, ids: DataFrame, keep: str) -> DataFrame:
    """(person_id, face_id) of all entries of faces (face_id) in lists of others than `keep`."""
    entries = people.where(F.col("person_id") != keep).select("person_id", F.explode("face_ids").alias("face_id"))
    return entries.join(ids.select("face_id"), "face_id", "left_semi").select("person_id", "face_id")


def merge_people(people: DataFrame, faces: DataFrame, base: str, merged: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(people, faces, undo): base lists the merged people's faces that exist and are not rejected, after its own; they
    become its own and confirmed, and leave the list of the person who had them. An `Unnamed n` base takes the name of the
    merged person with most faces who has a real one, the first of several in the order of `merged`. The merged go.
    `undo` holds what undo_merge needs. Without base, nothing changes. people: person_id, name, face_ids."""
    people = people.select("person_id", "name", "face_ids")
    payload = people.where(F.col("person_id").isin([base, *merged]))
    place = F.array_position(F.array(*map(F.lit, merged)), F.col("person_id")) if merged else F.lit(0)
    here = people.where(F.col("person_id") == base)
    sources = people.where(F.col("person_id").isin(merged)).join(here.select(F.lit(True).alias("there")), F.lit(True), "left_semi")
    entries = sources.select(place.alias("place"), F.posexplode("face_ids").alias("pos", "face_id"))
    fit = faces.where(~rejected()).select("face_id", F.col("person_id").alias("owner"))
    moved = entries.join(fit, "face_id").groupBy("face_id").agg(F.min(F.struct("place", "pos")).alias("at"), F.first("owner").alias("owner"))
    real = (F.trim(F.coalesce("name", F.lit(""))) != "") & ~text.is_unnamed(F.col("name"))
    name = sources.where(real).agg(F.max_by(F.trim("name"), F.struct(F.size("face_ids"), -place)).alias("best"))
    more = moved.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "face_id"))), lambda x: x["face_id"]).alias("more"))
    one = here.join(name, F.lit(True), "left").join(more, F.lit(True), "left")
    taken = F.when(text.is_unnamed(F.col("name")), F.coalesce("best", "name")).otherwise(F.col("name"))
    target = one.select("person_id", taken.alias("name"), F.array_distinct(F.concat("face_ids", "more")).alias("face_ids"))
    others = people.where(~F.col("person_id").isin([base, *merged]))
    rest = _unlisted(others, moved.where("owner is not null").select(F.col("owner").alias("person_id"), "face_id"))
    stay = people.where(F.col("person_id").isin(merged)).join(here.select(F.lit(True).alias("there")), F.lit(True), "left_anti")
    face = _marked(faces, moved)
    face = _confirmed(face, F.col("__hit")).withColumn("person_id", F.when(F.col("__hit"), F.lit(base)).otherwise(F.col("person_id")))
    return rest.unionByName(target).unionByName(stay), face.select(*faces.columns), payload


# What the kinds of rows begin with that are snapshots and no merges.
SNAPSHOTS = ("recluster_snapshot", "face_dedupe_snapshot", "suspicious_face_snapshot", "face_membership_snapshot")


def merge_history(rows: DataFrame) -> DataFrame:
    """rows without snapshots; a target or names that a row lacks are taken from stored_target and stored_names."""
    kind = F.coalesce("kind", F.lit(""))
    rows = rows.where(~reduce(or_, [kind.startswith(s) for s in SNAPSHOTS]))
    stored = F.filter("stored_names", lambda n: F.coalesce(n, F.lit("")) != "")
    return rows.withColumns({"target": F.coalesce(F.nullif("target", F.lit("")), "stored_target"), "names": F.when(F.size("names") > 0, F.col("names")).otherwise(stored)}).drop("stored_target", "stored_names")


def undo_merge(people: DataFrame, faces: DataFrame, undo: DataFrame) -> tuple[DataFrame, DataFrame]:
    """People as they were, each face with who listed it; confirmation goes, and confidence is 0.95 at most."""
    ids = undo.select("person_id")
    back = people.join(ids, "person_id", "left_anti").unionByName(undo.select(*people.columns))
    owner = undo.select(F.explode("face_ids").alias("face_id"), F.col("person_id").alias("was")).groupBy("face_id").agg(F.min("was").alias("was"))
    rows = faces.join(owner, "face_id", "left")
    touched = F.col("was").isNotNull() & (F.col("was") != F.col("person_id"))
    rows = rows.withColumn("confirmed", F.when(touched, F.lit(False)).otherwise(F.col("confirmed"))).withColumn("confidence", F.when(touched, F.least("confidence", F.lit(0.95))).otherwise(F.col("confidence")))
    return back, rows.withColumn("person_id", F.coalesce("was", "person_id")).select(*faces.columns)


def _marked(faces: DataFrame, ids: DataFrame) -> DataFrame:
    """faces with __hit: whether a table of one column, face_id, has them."""
    return faces.join(ids.select("face_id").distinct().withColumn("__hit", F.lit(True)), "face_id", "left").withColumn("__hit", F.coalesce("__hit", F.lit(False)))


def split_person(people: DataFrame, faces: DataFrame, person: str, moved: DataFrame, new_id: str) -> tuple[DataFrame, DataFrame]:
    """(people, faces): faces (face_id) that the person owns and lists become a person of their own, named by the next
    `Unnamed n`; they are confirmed and leave all other lists. A person left without faces goes."""
    people = people.select("person_id", "name", "face_ids")
    listed = people.where(F.col("person_id") == person).select(F.posexplode("face_ids").alias("pos", "face_id"))
    owned = faces.where(F.col("person_id") == person).select("face_id")
    taken = listed.join(owned, "face_id", "left_semi").join(moved.select("face_id"), "face_id", "left_semi")
    lists = taken.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "face_id"))), lambda x: x["face_id"]).alias("face_ids")).where(F.size("face_ids") > 0)
    new = lists.join(next_unnamed(people), F.lit(True)).select(F.lit(new_id).alias("person_id"), F.concat(F.lit("Unnamed "), F.col("next").cast("string")).alias("name"), F.array_distinct("face_ids").alias("face_ids"))
    face = _confirmed(_marked(faces, taken), F.col("__hit")).withColumn("person_id", F.when(F.col("__hit"), F.lit(new_id)).otherwise(F.col("person_id")))
    return _unlisted(people, _listed_elsewhere(people, taken, new_id)).unionByName(new), face.select(*faces.columns)


def confirm_faces(people: DataFrame, faces: DataFrame, person: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(people, faces): faces (face_id) become a person's and confirmed, and leave all other lists. The person lists them
    last, but for those that were rejected or suspicious. Without the person, nothing changes."""
    people = people.select("person_id", "name", "face_ids")
    there = people.where(F.col("person_id") == person).select(F.lit(True).alias("there"))
    known = faces.select("face_id", "person_id", (~rejected() & ~suspicious()).alias("fit")).join(ids.select("face_id"), "face_id", "left_semi").join(there, F.lit(True), "left_semi")
    more = known.where("fit").agg(F.array_sort(F.collect_set("face_id")).alias("more"))
    rest = _unlisted(people, _listed_elsewhere(people, known, person)).join(more, F.lit(True))
    lists = F.when(F.col("person_id") == person, F.array_distinct(F.concat("face_ids", "more"))).otherwise(F.col("face_ids"))
    face = _confirmed(_marked(faces, known), F.col("__hit")).withColumn("person_id", F.when(F.col("__hit"), F.lit(person)).otherwise(F.col("person_id")))
    return rest.select("person_id", "name", lists.alias("face_ids")), face.select(*faces.columns)


def review(faces: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    """Confirm or reject the faces of a table (face_id); a rejected face has no owner."""
    face = _marked(faces, ids)
    if status == "confirmed":
        return _confirmed(face, F.col("__hit")).select(*faces.columns)
    set_ = lambda c, v: F.when(F.col("__hit"), v).otherwise(F.col(c))
    of = {"confirmed": F.lit(False), "rejected": F.lit(True), "review": F.lit(status), "person_id": F.lit(None)}
    return face.withColumns({c: set_(c, v) for c, v in of.items()}).select(*faces.columns)


def label_person(people: DataFrame, faces: DataFrame, person: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(people, faces): the person has the name, and the faces of the person's list are confirmed."""
    listed = people.where(F.col("person_id") == person).select(F.explode("face_ids").alias("face_id"))
    face = _confirmed(_marked(faces, listed), F.col("__hit")).select(*faces.columns)
    return people.withColumn("name", F.when(F.col("person_id") == person, F.lit(name)).otherwise(F.col("name"))), face


def delete_person(people: DataFrame, faces: DataFrame, person: str) -> tuple[DataFrame, DataFrame]:
    return people.where(F.col("person_id") != person), faces.withColumn("person_id", F.when(F.col("person_id") == person, F.lit(None)).otherwise(F.col("person_id")))


def apply_plan(people: DataFrame, faces: DataFrame, planned: DataFrame, assignments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(people, faces) after a plan of people (person_id, name, face_ids) and assignments (face_id, person_id).

    Planned people get the plan's list, and its name or else the one they have. A clusterable face gets its person, and
    goes from the lists of all others; faces that are not clusterable are skipped. Of the people outside the plan,
    those go whose lists hold no face that is theirs and not rejected.
    """
    can = faces.where(clusterable()).select("face_id")
    moved = assignments.join(can, "face_id", "left_semi").select("face_id", F.col("person_id").alias("to"))
    face = faces.join(moved, "face_id", "left").withColumn("person_id", F.coalesce("to", "person_id")).drop("to").select(*faces.columns)
    names = people.select("person_id", F.col("name").alias("old"))
    blank = F.trim(F.coalesce("name", F.lit(""))) == ""
    given = planned.select("person_id", "name", F.array_distinct("face_ids").alias("face_ids")).join(names, "person_id", "left")
    given = given.select("person_id", F.when(blank, F.coalesce("old", F.lit(""))).otherwise(F.col("name")).alias("name"), "face_ids")
    rest = people.join(planned.select("person_id"), "person_id", "left_anti").select("person_id", "name", F.posexplode("face_ids").alias("pos", "face_id"))
    rest = rest.join(moved, "face_id", "left_anti")
    alive = face.where(~rejected()).select("face_id", F.col("person_id").alias("owner"))
    rest = rest.join(alive, "face_id", "left").groupBy("person_id").agg(
        F.first("name").alias("name"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "face_id"))), lambda x: x["face_id"]).alias("face_ids"),
        F.count_if(F.col("owner") == F.col("person_id")).alias("own"),
    )
    return given.unionByName(rest.where("own > 0").drop("own")), face


def incomplete(candidates: DataFrame, assigned: DataFrame, key: str = "face_id") -> DataFrame:
    """Rows that break a complete assignment: missing or extra, with multiplicity."""
    a, b = candidates.select(key), assigned.select(key)
    return a.exceptAll(b).withColumn("what", F.lit("missing")).unionByName(b.exceptAll(a).withColumn("what", F.lit("extra")))


def repair_lists(people: DataFrame, faces: DataFrame) -> DataFrame:
    """People whose lists are the faces that exist, are not rejected, and have them as owners; idempotent."""
    owned = faces.where(F.col("person_id").isNotNull() & ~rejected()).groupBy("person_id").agg(F.array_sort(F.collect_set("face_id")).alias("face_ids"))
    return people.select("person_id", "name").join(owned, "person_id", "left").withColumn("face_ids", F.coalesce("face_ids", F.array().cast("array<string>")))


def suppress_suspicious(people: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(people, faces): faces of low confidence, neither rejected nor confirmed, lose their owner. Those that the gate of
    stored faces would not let in are rejected and leave their owner's list; the others are marked suspicious and stay
    listed. An unnamed person whose only face is among them goes."""
    low = ~rejected() & ~confirmed() & (F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)) < SUSPICIOUS)
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    false_face = low & ~media.face_passes(*map(number, ("confidence", "width", "height", "image_width", "image_height")))
    rows = faces.withColumns({"__low": low, "__false": false_face})
    hit = rows.where("__low and person_id is not null").select("person_id", "face_id", "__false")
    people = people.select("person_id", "name", "face_ids")
    only = people.where((F.size("face_ids") == 1) & text.is_unnamed(F.col("name"))).select("person_id", F.col("face_ids")[0].alias("face_id"))
    people = people.join(only.join(hit, ["person_id", "face_id"], "left_semi"), "person_id", "left_anti")
    dropped = hit.where("__false").groupBy("person_id").agg(F.collect_set("face_id").alias("gone"))
    lists = people.join(dropped, "person_id", "left")
    left = F.when(F.col("gone").isNull(), F.col("face_ids")).otherwise(F.filter("face_ids", lambda x: ~F.array_contains("gone", x)))
    out = rows.withColumns({
        "review": F.when(F.col("__false"), "rejected").when(F.col("__low"), "suspicious").otherwise(F.col("review")),
        "rejected": F.when(F.col("__low"), F.col("__false")).otherwise(F.col("rejected")),
        "confirmed": F.when(F.col("__false"), F.lit(False)).otherwise(F.col("confirmed")),
        "person_id": F.when(~F.col("__low"), F.col("person_id")),
    })
    return lists.select("person_id", "name", left.alias("face_ids")), out.select(*faces.columns)


def photo_people(faces: DataFrame, people: DataFrame) -> DataFrame:
    """Per photo: its faces that are not rejected, and the distinct named people in them, both in order."""
    rows = faces.where(~rejected()).join(people.select("person_id", "name"), "person_id", "left")
    named = F.trim(F.coalesce("name", F.lit(""))) != ""
    return rows.groupBy("filename").agg(F.array_sort(F.collect_set("face_id")).alias("faces"), F.count("*").alias("face_count"), F.array_sort(F.collect_set(F.when(named, F.col("name")))).alias("names"))


def people_changes(before: Column, after: Column) -> Column:
    """How many came and went."""
    return F.struct(F.size(F.array_except(after, before)).alias("added"), F.size(F.array_except(before, after)).alias("removed"))


def restore_snapshot(current: DataFrame, snapshot: DataFrame, key: str = "face_id", fields=("person_id", "confirmed", "confidence"), cleared=("person_id", "confirmed")) -> DataFrame:
    """current's columns and `what`. Rows in both keep their columns but for `fields`, which are the snapshot's; rows
    only in current lose `cleared`; rows only in the snapshot come back whole, with what columns they have there."""
    old = snapshot.select(*[F.col(c).alias(f"__{c}") for c in snapshot.columns])
    rows = current.join(old, F.col(key) == F.col(f"__{key}"), "full_outer")
    gone, added = F.col(key).isNull(), F.col(f"__{key}").isNull()
    what = F.when(gone, "inserted").when(added, "cleared").otherwise("restored")

    def value(c: str) -> Column:
        then = F.col(f"__{c}") if c in snapshot.columns else F.lit(None).cast(current.schema[c].dataType)
        both = then if c in fields else F.col(c)
        return F.when(gone, then).when(added, F.lit(None) if c in cleared else F.col(c)).otherwise(both).alias(c)

    return rows.select(*[value(c) for c in current.columns], what.alias("what"))


def delete_photos(names: DataFrame, photos: DataFrame, faces: DataFrame, albums: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Without the photos: themselves, their faces, and their places in albums."""
    keep = photos.join(names, "filename", "left_anti")
    face = faces.join(names, "filename", "left_anti")
    listed = albums.select("album_id", F.posexplode("filenames").alias("pos", "filename")).join(names, "filename", "left_anti")
    lists = listed.groupBy("album_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "filename"))), lambda x: x["filename"]).alias("filenames"))
    rest = albums.drop("filenames").join(lists, "album_id", "left").withColumn("filenames", F.coalesce("filenames", F.array().cast("array<string>")))
    return keep, face, rest


def _without(df: DataFrame, key: str, col: str, gone: DataFrame) -> DataFrame:
    """df with the values in `gone` (one column) taken out of its lists, in their order; `touched` tells which lost any."""
    rows = df.select(key, F.posexplode(col).alias("pos", "__x")).join(gone.toDF("__x").distinct().withColumn("__gone", F.lit(True)), "__x", "left")
    stay = F.collect_list(F.when(F.col("__gone").isNull(), F.struct("pos", F.col("__x").alias("x"))))
    lists = rows.groupBy(key).agg(F.transform(F.array_sort(stay), lambda e: e["x"]).alias("__list"), F.coalesce(F.bool_or("__gone"), F.lit(False)).alias("touched"))
    rest = df.join(lists, key, "left").withColumn(col, F.coalesce("__list", col))
    return rest.withColumn("touched", F.coalesce("touched", F.lit(False))).drop("__list")


def delete_people_of(names: DataFrame, photos: DataFrame, faces: DataFrame, people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(people, photos) of a library after photos are deleted. Their faces leave all people's lists, and a person whose
    list that empties goes. A person whom a deleted photo shows, but who is not there (any more), leaves the people
    of the photos that stay. names: filename; photos: filename (unique), people_ids; people: person_id, face_ids."""
    dead = faces.join(names, "filename", "left_semi").select("face_id")
    left = _without(people, "person_id", "face_ids", dead)
    left = left.where(~F.col("touched") | (F.size("face_ids") > 0)).drop("touched")
    shown = photos.join(names, "filename", "left_semi").select(F.explode("people_ids").alias("person_id")).distinct()
    lost = shown.join(left, "person_id", "left_anti")
    return left, _without(photos.join(names, "filename", "left_anti"), "filename", "people_ids", lost).drop("touched")


def delete_jobs_of(names: DataFrame, jobs: DataFrame, user: str, key: str = "row_key") -> DataFrame:
    """The jobs that stay when a user's photos are deleted: jobs_of for a table of names. A key is looked up by its
    beginnings, of the lengths that the photos' keys have, so there is no pair of every job and photo. Jobs are told
    apart by `key`, which is unique."""
    name = F.col("filename")
    starts = names.where(name != "").select(F.explode(F.array(F.concat(F.lit(f"processing:{user}:"), name), F.concat(F.lit(f"{user}:"), name), name)).alias("__start")).distinct()
    lengths = starts.select(F.length("__start").alias("__n")).distinct()
    keys = jobs.select(F.col(key).alias("__key"), F.explode(F.array_distinct(F.array_compact(F.array("job_id", "row_key", "correlation_id")))).alias("__k"))
    begun = keys.join(lengths, F.length("__k") >= F.col("__n")).select("__key", F.substring(F.col("__k"), F.lit(1), F.col("__n")).alias("__start"))
    mine = F.coalesce(F.col("user_id"), F.lit("")).isin("", user)
    named = jobs.where(mine).select(F.col(key).alias("__key"), F.explode(F.array_compact(F.array("filename", "correlation_id"))).alias("filename")).join(names, "filename", "left_semi").select("__key")
    hit = begun.join(starts, "__start", "left_semi").select("__key").unionByName(named).distinct()
    return jobs.join(hit, jobs[key] == hit["__key"], "left_anti")


def purge_library(tables: dict[str, DataFrame], library) -> dict[str, DataFrame]:
    return {name: t.where(~F.col("library_id").eqNullSafe(F.lit(library))) for name, t in tables.items()}


# Columns that track an upload, and those that tell that it completed.
TRACKING = ("received_ranges", "upload_total_size", "upload_started_at", "upload_last_chunk_at", "upload_sha256_expected", "upload_sha256_actual", "upload_sha256_match")
EVIDENCE = ("file_hash", "perceptual_hash", "mime_type", "thumbnail_status", "verification_status")


def clean_failed_uploads(photos: DataFrame) -> DataFrame:
    """Rows with any upload tracking: `clear` (the tracking columns) where anything tells that the upload completed,
    else `delete`; others are not returned. Columns that the table lacks count as absent."""
    some = lambda names, test: reduce(or_, [test(F.col(c)) for c in names if c in photos.columns], F.lit(False))
    tracked = some(TRACKING, lambda c: c.isNotNull())
    complete = some(EVIDENCE, lambda c: F.coalesce(c.cast("string"), F.lit("")) != "")
    return photos.where(tracked).select("photo_id", F.when(complete, "clear").otherwise("delete").alias("action"))


def jobs_of(jobs: DataFrame, user: str, filename: str) -> DataFrame:
    """Jobs of a user's photo: its filename or correlation id is the photo's and its user this one or none, or one of
    job id, row key and correlation id begins with a key of the photo. jobs: row_key, job_id, filename, user_id,
    correlation_id."""
    col = lambda c: F.coalesce(F.col(c), F.lit(""))
    mine = (col("user_id") == "") | (col("user_id") == user)
    hit = mine & ((col("filename") == filename) | (col("correlation_id") == filename))
    for prefix in (f"processing:{user}:{filename}", f"{user}:{filename}", filename):
        for c in ("job_id", "row_key", "correlation_id"):
            hit = hit | col(c).startswith(prefix)
    return jobs.where(hit)


def next_unnamed(people: DataFrame) -> DataFrame:
    """The number after the largest of names like `Unnamed 7` or `unnamed7`: one row, next."""
    n = F.regexp_extract(F.trim(F.coalesce("name", F.lit(""))), r"(?i)^unnamed\s*([0-9]+)$", 1).try_cast("long")
    return people.agg((F.coalesce(F.max(n), F.lit(0)) + 1).alias("next"))


def numbered(people: DataFrame, key: str = "person_id") -> DataFrame:
    """display_name: the name, or `Unnamed n` with n counting nameless people in the order of keys.

    Ranks are counted by ranges: a task numbers its sorted range, and adds the sizes of the ranges before.
    """
    from albumen.operators.ranking import global_rank

    blank = F.trim(F.coalesce("name", F.lit(""))) == ""
    ranks = global_rank(people.where(blank).select(key), key)
    label = F.when(blank, F.concat(F.lit("Unnamed "), F.col("rank").cast("string"))).otherwise(F.col("name"))
    return people.join(ranks, key, "left").select(*people.columns, label.alias("display_name"))
