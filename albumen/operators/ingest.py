"""What a client's results of an upload change in its photo's row: one projection over all six stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from albumen.functions import media, text

# The longest texts of each field; face states after which the lease ends.
OCR_CHARS, CAPTION_CHARS, ADDRESS_CHARS, PLACE_CHARS = 2048, 512, 512, 256
LEASE_ENDS = ("done", "no_data", "failed", "unsupported")
#: The parts of a result, as columns of the table that is merged: structs, null where a client sent nothing.
RESULT = {
    "thumbnail": "struct<uploaded:boolean>",
    "exif": "struct<has_data:boolean,data:map<string,string>,latitude:string,longitude:string>",
    "ocr": "struct<has_data:boolean,text:string>",
    "map": "struct<has_data:boolean,latitude:string,longitude:string,address:string,city:string,country:string>",
    "face": "struct<has_data:boolean,faces:array<struct<confidence:double,width:double,height:double,image_width:double,image_height:double,embedding:array<double>>>,deferred:string,failure_stage:string>",
    "ai": "struct<has_data:boolean,model_ready:boolean,fallback:boolean,tags:array<string>,caption:string,ocr_text:string,person_label:string,person_score:string,person_candidate:boolean>",
}


def _filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def merge_results(rows: DataFrame, throttled: Column | None = None) -> DataFrame:
    """rows after their results: states of the six stages, texts, place, tags, faces and lease.

    rows: filename, <stage>_status, ocr_text, caption, latitude, longitude, address, city, country, exif (map), tags,
    faces, face_count, person_label, person_score, person_candidate, lease_owner, and the structs of RESULT as r_<part>.
    States of reports are merged before (status.merge_reports); `throttled` tells that a report put the face stage off.
    A part that is null changes nothing. Coordinates count as a pair, each within its range. Faces need a vector and to
    pass the quality gate. An AI result counts only with a model that is named; a fallback's result is no data.
    """
    r = {k: F.col(f"r_{k}") for k in RESULT}
    given = {k: c.isNotNull() for k, c in r.items()}
    out: dict[str, Column] = {}
    out["thumbnail_status"] = F.when(r["thumbnail"]["uploaded"], "done").otherwise(F.col("thumbnail_status"))

    # Capture data, with its coordinates; then those of the map stage.
    e = r["exif"]
    has_exif = given["exif"] & F.coalesce(e["has_data"], F.lit(False))
    data = lambda k: F.try_element_at(e["data"], F.lit(k))
    lat = media.coordinate(F.coalesce(_filled(e["latitude"]), data("GPS.LatitudeDecimal")), 90)
    lon = media.coordinate(F.coalesce(_filled(e["longitude"]), data("GPS.LongitudeDecimal")), 180)
    located = has_exif & lat.isNotNull() & lon.isNotNull()
    m = r["map"]
    map_lat, map_lon = media.coordinate(m["latitude"], 90), media.coordinate(m["longitude"], 180)
    mapped = given["map"] & map_lat.isNotNull() & map_lon.isNotNull()
    out["latitude"] = F.when(mapped, map_lat.cast("string")).when(located, lat.cast("string")).otherwise(F.col("latitude"))
    out["longitude"] = F.when(mapped, map_lon.cast("string")).when(located, lon.cast("string")).otherwise(F.col("longitude"))
    place = F.map_from_arrays(F.array(F.lit("GPS.LatitudeDecimal"), F.lit("GPS.LongitudeDecimal")), F.array(lat.cast("string"), lon.cast("string")))
    clean = F.map_filter(e["data"], lambda k, v: ~(located & k.isin("GPS.LatitudeDecimal", "GPS.LongitudeDecimal")))
    out["exif"] = F.when(has_exif, F.map_concat(clean, F.when(located, place).otherwise(F.map_filter(place, lambda k, v: F.lit(False))))).otherwise(F.col("exif"))
    out["exif_status"] = F.when(has_exif, "done").otherwise(F.col("exif_status"))
    for name, size in (("address", ADDRESS_CHARS), ("city", PLACE_CHARS), ("country", PLACE_CHARS)):
        out[name] = F.when(mapped, text.sanitize_text(m[name], size)).otherwise(F.col(name))
    by_exif = F.when(located, "done").when(has_exif, "no_data")
    by_map = F.when(mapped, "done")
    none = given["map"] & ~mapped & (F.coalesce(m["has_data"], F.lit(True)) == F.lit(False))
    out["map_detection_status"] = F.coalesce(by_map, by_exif, F.when(none, "no_data"), F.col("map_detection_status"))

    # Texts: the AI stage's are read after the OCR stage's.
    a = r["ai"]
    fallback = F.coalesce(a["fallback"], F.lit(False))
    ready = given["ai"] & F.coalesce(a["model_ready"], F.lit(False))
    no_ai = ready & ((F.coalesce(a["has_data"], F.lit(True)) == F.lit(False)) | fallback)
    seen = ready & F.coalesce(a["has_data"], F.lit(False)) & ~no_ai
    read, said = text.sanitize_text(r["ocr"]["text"], OCR_CHARS), text.sanitize_text(a["ocr_text"], OCR_CHARS)
    out["ocr_text"] = F.when(seen & (said != ""), said).when(given["ocr"] & (read != ""), read).otherwise(F.col("ocr_text"))
    empty = given["ocr"] & (read == "") & (F.coalesce(r["ocr"]["has_data"], F.lit(True)) == F.lit(False))
    out["ocr_status"] = F.when(given["ocr"] & (read != ""), "done").when(empty, "no_data").otherwise(F.col("ocr_status"))
    caption = text.sanitize_text(a["caption"], CAPTION_CHARS)
    out["caption"] = F.when(seen & (caption != ""), caption).otherwise(F.col("caption"))
    out["tags"] = F.when(seen, text.normalize_tags(F.concat(F.coalesce("tags", F.array().cast("array<string>")), text.sanitize_tags(F.coalesce(a["tags"], F.array().cast("array<string>")))))).otherwise(F.col("tags"))
    label = text.sanitize_tag(a["person_label"])
    score = F.round(F.least(F.greatest(F.coalesce(a["person_score"].try_cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)), 4)
    person = seen & (label != "")
    out["person_label"] = F.when(person, label).otherwise(F.col("person_label"))
    out["person_score"] = F.when(person, score).otherwise(F.col("person_score"))
    out["person_candidate"] = F.when(person, F.coalesce(a["person_candidate"], F.lit(False)) & (score >= 0.2)).otherwise(F.col("person_candidate"))
    out["ai_vision_status"] = F.when(no_ai, "no_data").when(seen, "done").otherwise(F.col("ai_vision_status"))

    # Faces that are good enough to be stored.
    f = r["face"]
    good = F.filter(f["faces"], lambda x: (F.size(F.coalesce(x["embedding"], F.array().cast("array<double>"))) > 0) & media.face_passes(x["confidence"], x["width"], x["height"], x["image_width"], x["image_height"]))
    n = F.when(f["faces"].isNotNull(), F.size(good)).otherwise(0)
    deferred = F.lower(F.trim(F.coalesce(f["deferred"], F.lit(""))))
    late = (deferred == "background_throttled") | (throttled if throttled is not None else F.lit(False))
    failed = f["faces"].isNotNull() & ((deferred == "inference_timeout") | (F.trim(F.coalesce(f["failure_stage"], F.lit(""))) != ""))
    face = F.when(n > 0, "done").when(late, "pending").when(failed, "failed").otherwise("no_data")
    out["face_status"] = F.when(given["face"], face).otherwise(F.col("face_status"))
    out["face_count"] = F.when(given["face"], n).otherwise(F.col("face_count"))
    out["faces"] = F.when(given["face"] & (n > 0), good).otherwise(F.col("faces"))
    out["lease_owner"] = F.when(given["face"] & face.isin(*LEASE_ENDS), "").otherwise(F.col("lease_owner"))
    return rows.withColumns(out).drop(*[f"r_{k}" for k in RESULT])
