"""Text functions as Columns: no Python runs on the executors."""

from __future__ import annotations

import re
import unicodedata
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from albumen import vocabulary as V


def _fold_table() -> tuple[str, str]:
    """Accented Latin letters and the letters they fold to, by Unicode's own decomposition."""
    pairs = ((chr(c), unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore").decode()) for c in range(0xC0, 0x250))
    pairs = [(c, to) for c, to in pairs if len(to) == 1]
    return "".join(c for c, _ in pairs), "".join(to for _, to in pairs)


_FROM, _TO = _fold_table()


def ascii_fold(c: Column) -> Column:
    """Letters without accents; what is left beyond ASCII goes."""
    return F.regexp_replace(F.translate(c, _FROM, _TO), r"[^\x00-\x7F]", "")


def normalize_phrase(c: Column) -> Column:
    """Folded and lower-case, with single spaces for all but letters and digits."""
    return F.trim(F.regexp_replace(F.lower(ascii_fold(c)), r"[^a-z0-9]+", " "))


# Endings and what they become, of which the first that fits a word counts. Singulars of stored words;
# singulars and plurals of a query's words. A word of fewer letters than LEAST_LETTERS is its own singular.
LEAST_LETTERS = 4
SINGULARS = (("^(.{2,})ies$", "y"), ("^(.{2,})ves$", "f"), ("^(.*(?:s|x|z|ch|sh|o))es$", ""), ("^(.*[^s])s$", ""))
QUERY_SINGULARS = (("^(.{2,})ies$", "y"), ("^(.*(?:s|x|z|ch|sh|o))es$", ""), ("^(.*[^s])s$", ""))
PLURALS = (("^(.{2,})y$", "ies"), ("^(.*(?:s|x|z|ch|sh))$", "es"), ("^(.*)$", "s"))


def _ended(word: str, rules) -> str:
    return next((m[1] + end for pattern, end in rules if (m := re.match(pattern, word))), word)


def singularize(w: Column) -> Column:
    """A word's singular by its ending."""
    # Every ending ends in s: most words need no pattern.
    out = F.when((F.length(w) < LEAST_LETTERS) | ~w.endswith("s"), w)
    for pattern, end in SINGULARS:
        out = out.when(w.rlike(pattern), F.regexp_replace(w, F.lit(pattern), F.lit("$1" + end)))
    return out.otherwise(w)


def singular(word: str) -> str:
    """singularize for one string on the driver."""
    return word if len(word) < LEAST_LETTERS else _ended(word, SINGULARS)


def _canonical(w: Column, otherwise: Column) -> Column:
    # A map is searched one by one, and most words are not in it: those are told by one look into a set.
    table = F.create_map(*[F.lit(x) for pair in V.CANONICAL.items() for x in pair])
    return F.when(w.isin(*V.CANONICAL), F.try_element_at(table, w)).otherwise(otherwise)


def normalize_token(c: Column) -> Column:
    """normalize_phrase with each word mapped, made singular, and mapped again: step by step, as what is named twice in
    one step is computed twice."""
    words = F.filter(F.split(normalize_phrase(c), " "), lambda w: w != "")
    words = F.transform(words, lambda w: _canonical(w, w))
    return F.array_join(F.transform(words, lambda w: _canonical(w, singularize(w))), " ")


def normalize_tags(tags: Column, most: int = V.TAGS_KEPT, length: int = V.TAG_LENGTH) -> Column:
    """Distinct one-word tokens in the order they come, cut to a length and a number."""
    tokens = F.filter(F.transform(tags, normalize_token), lambda t: (t != "") & ~t.contains(" "))
    return F.slice(F.array_distinct(F.transform(tokens, lambda t: F.left(t, F.lit(length)))), 1, most)


def token_variants(token: str) -> list[str]:
    """A query's word and its singular, then their plurals; a query is parsed on the driver."""
    if not token:
        return []
    forms = [token, token if len(token) < LEAST_LETTERS else _ended(token, QUERY_SINGULARS)]
    return list(dict.fromkeys(forms + [_ended(form, PLURALS) for form in forms]))


def contains_term(text: Column, token: str, related: bool = True) -> Column:
    """The text has a variant of the token as a whole word or, for 4 letters or more, a word that starts with it."""
    forms = [re.escape(v) for v in token_variants(token)]
    if related and len(token) >= 4:
        forms.append(re.escape(token) + "[a-z0-9]*")
    return text.rlike(r"\b(" + "|".join(forms) + r")\b") if forms else F.lit(False)


def tag_bucket(tag: Column, source: Column) -> Column:
    """The bucket of a normalised tag."""
    out = F.when(F.coalesce(tag, F.lit("")) == "", "background").when(tag.isin(V.PERSON) | source.isin("ai_person", "face"), "person")
    for name, words in (("animal", V.ANIMAL), ("flower", V.FLOWER), ("plant", V.PLANT)):
        out = out.when(tag.isin(words), name)
    out = out.when(tag.isin(V.PLACE) | (source == "location"), "place").when(tag.isin(V.ACTION) | tag.endswith("ing"), "action")
    for name, words in (("season", V.SEASON), ("weather", V.WEATHER), ("scene", V.SCENE), ("background", V.BACKGROUND)):
        out = out.when(tag.isin(words), name)
    return out.otherwise("object")


def _lookup(c: Column, table: dict, default: float) -> Column:
    out = F
    for k, v in table.items():
        out = out.when(c == k, F.lit(v))
    return out.otherwise(F.lit(default))


def coerce_confidence(value: Column, source: Column) -> Column:
    """A number within 0 and 1, 4 places; the source's default where there is none."""
    number = F.coalesce(value.try_cast("double"), _lookup(source, V.SOURCE_CONFIDENCE, 0.5))
    return F.round(F.least(F.greatest(number, F.lit(0.0)), F.lit(1.0)), 4)


def tag_importance(confidence: Column, bucket: Column, source: Column, tag: Column) -> Column:
    role = F.when(bucket.isin(*V.SUBJECT_BUCKETS), 0.45).otherwise(0.0)
    generic = F.when(tag.isin(*V.GENERIC), 2.0).otherwise(0.0)
    return F.round(confidence * 10.0 + _lookup(bucket, V.BUCKET_WEIGHT, 1.0) + _lookup(source, V.SOURCE_WEIGHT, 0.5) + role - generic, 4)


def face_presence_tags(count: Column, label: Column | None = None) -> Column:
    n = F.coalesce(count.try_cast("int"), F.lit(0))
    more = F.when(n == 1, F.array(F.lit("selfie"))).when(n == 2, F.array(F.lit("selfie"), F.lit("pair"))).otherwise(F.array(*map(F.lit, ("people", "group", "family", "crowd"))))
    tags = F.concat(F.array(*map(F.lit, ("face", "person", "portrait", "human"))), more)
    if label is not None:
        tags = F.concat(tags, F.array(F.coalesce(label, F.lit(""))))
    return F.when(n <= 0, F.array().cast("array<string>")).otherwise(normalize_tags(tags))


def prediction_tags(predictions: Column) -> Column:
    """Labels of the first predictions (array of struct<label,score>) with a score that is enough."""
    good = F.filter(F.slice(predictions, 1, V.PREDICTIONS_READ), lambda p: F.coalesce(p["score"].try_cast("double"), F.lit(0.0)) >= V.PREDICTION_MIN)
    return normalize_tags(F.transform(good, lambda p: F.coalesce(p["label"], F.lit(""))))


def location_tags(city: Column, country: Column, address: Column) -> Column:
    return normalize_tags(F.array(*(F.coalesce(x, F.lit("")) for x in (city, country, address))))


def effective_tags(subjects, people, location, stored, objects, background, predicted, face) -> Column:
    """Subjects, people and places first; then the others that are not among them."""
    first = normalize_tags(F.concat(subjects, people, location))
    second = normalize_tags(F.concat(stored, objects, background, predicted, face))
    return F.concat(first, F.array_except(second, first))


def semantic_candidates(subjects: Column, location: Column, effective: Column) -> Column:
    """The normalised subject tags and places; the effective tags only where there are none."""
    own = normalize_tags(F.concat(subjects, location))
    return F.when(F.size(own) > 0, own).otherwise(effective)


def semantic_layers(subjects: Column, location: Column, background: Column, weak: Column, effective: Column) -> Column:
    """A struct of normalised tags by layer: subjects (or else the effective tags), locations, backgrounds and weak ones."""
    return F.struct(
        normalize_tags(F.when(F.size(subjects) > 0, subjects).otherwise(effective)).alias("subjects"), location.alias("locations"),
        normalize_tags(background).alias("backgrounds"), normalize_tags(F.transform(weak, lambda t: F.coalesce(F.trim(t), F.lit("")))).alias("weak"),
    )


def stripped(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def merge_tags(*groups: Column) -> Column:
    """The groups' tags in lower case, each once, in the order of groups."""
    tags = F.flatten(F.array(*[F.coalesce(g, F.array().cast("array<string>")) for g in groups]))
    return F.array_distinct(F.filter(F.transform(tags, lambda t: F.lower(stripped(F.coalesce(t, F.lit(""))))), lambda t: t != ""))


def semantic_text(candidates: Column, fields: list[Column], most: int = 10_000) -> Column:
    """The sorted candidates, and the fields' words among them, each once."""
    words = F.flatten(F.array(*[F.split(normalize_token(F.coalesce(f, F.lit(""))), " ") for f in fields]))
    found = F.filter(words, lambda w: (w != "") & F.array_contains(candidates, w))
    return F.left(F.array_join(F.array_distinct(F.concat(F.array_sort(F.array_distinct(candidates)), found)), " "), F.lit(most))


def title_case(c: Column) -> Column:
    """Underscores to spaces, single spaces; all-lower text gets a capital after anything but a letter."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(c, "_", " "), r"\s+", " "))
    # Cut before each run of letters; raise its first letter.
    parts = F.regexp_extract_all(clean, F.lit(r"([a-z]+|[^a-z]+)"), F.lit(1))
    titled = F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.substring(p, 2, 100_000))), "")
    return F.when((F.lower(clean) == clean) & clean.rlike("[a-z]"), titled).otherwise(clean)


def sanitize_tag(c: Column, length: int = 80) -> Column:
    """Letters, digits, spaces, - and _ in lower case; empty where nothing is left or more than `length` characters."""
    clean = F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N} _-]", ""))
    return F.when(F.length(clean) <= length, clean).otherwise("")


def sanitize_tags(tags: Column, most: int = 400) -> Column:
    return F.slice(F.array_distinct(F.filter(F.transform(tags, lambda t: sanitize_tag(t)), lambda t: t != "")), 1, most)


def sanitize_predictions(predictions: Column, most: int = 400) -> Column:
    """Of the first predictions (array of struct<label,score>) those with a label that is left by sanitize_tag, and
    their scores within 0 and 1, 4 places; no number is 0."""
    score = lambda p: F.coalesce(p["score"].try_cast("double"), F.lit(0.0))
    clean = F.transform(F.slice(predictions, 1, most), lambda p: F.struct(sanitize_tag(p["label"]).alias("label"), F.round(F.least(F.greatest(score(p), F.lit(0.0)), F.lit(1.0)), 4).alias("score")))
    return F.filter(clean, lambda p: p["label"] != "")


#: The version of hashed_embedding; vectors of another version are not comparable.
HASHED_VERSION = "albumen-hash-1"


def hashed_embedding(c: Column, size: int = 1024) -> Column:
    """A text's vector where there is no model: one half counts its words and pairs of words, the other the runs of 3
    to 5 letters of its padded words, each hashed (CRC-32) to a place and scaled to length 1; then the whole is. Null
    and empty texts give a vector of zeros."""
    half = size // 2

    @F.pandas_udf("array<double>")
    def run(phrases: pd.Series) -> pd.Series:
        # Words repeat: a word's places are found once a batch.
        known: dict[str, tuple[bytes, int, np.ndarray]] = {}

        def places(w: str) -> tuple[bytes, int, np.ndarray]:
            raw = w.encode()
            p = f" {w} "
            grams = [zlib.crc32(p[i : i + n].encode()) % half for n in (3, 4, 5) for i in range(max(1, len(p) - n + 1))]
            known[w] = raw, zlib.crc32(raw), np.array(grams)
            return known[w]

        def side(at: np.ndarray | list) -> np.ndarray:
            v = np.bincount(at, minlength=half).astype(float) if len(at) else np.zeros(half)
            return v / (np.linalg.norm(v) or 1.0)

        out = []
        for phrase in phrases:
            words = [known.get(w) or places(w) for w in (phrase or "").split()]
            # A pair's checksum goes on from that of its first word.
            pairs = [zlib.crc32(b" " + b[0], a[1]) % half for a, b in zip(words, words[1:])]
            v = np.concatenate([side([w[1] % half for w in words] + pairs), side(np.concatenate([w[2] for w in words]) if words else [])])
            out.append(v / (np.linalg.norm(v) or 1.0))
        return pd.Series(out)

    return run(normalize_phrase(F.coalesce(c, F.lit(""))))


def sanitize_text(c: Column, length: int) -> Column:
    return F.left(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "\x00", " ")), F.lit(length))


def is_unnamed(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")).rlike(r"(?i)^unnamed\s*[0-9]*$")


def normalize_email(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def mask_email(c: Column) -> Column:
    """The first letter of the name, stars, and the domain."""
    name, domain = F.substring_index(c, "@", 1), F.substring_index(c, "@", -1)
    return F.when(c.contains("@"), F.concat(F.left(name, F.lit(1)), F.lit("***@"), domain)).otherwise(F.lit("***"))


def file_extension(name: Column) -> Column:
    return F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise("")
