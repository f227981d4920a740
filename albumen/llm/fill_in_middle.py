"""Fill-in-the-middle by run-length classes.

A text is stored as its maximal runs of one character class, each with where it ends and how many units have ended
by then. A cut after u units binary-searches the run in which that unit ends, and the place inside the run follows
by arithmetic, as all characters of a run end units alike: each of them, or none but the last. So lines, words and
characters are cut by one rule, and no list of units is built.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from albumen.operators.once import computed_once

#: Fixed values of the format.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM_RATE = 7, 100, 50
#: The characters that count as spaces between words.
SPACES = " \t\n\x0b\x0c\r"


class Runs:
    """The runs of a text: `end`, the place after each; `ended`, the units that have ended there.

    unit 'line': a newline ends a unit, and so does the end of the text after anything else. 'word': each run of
    spaces or of other characters is a unit. 'char': each character is one.
    """

    def __init__(self, text: str, unit: str = "line"):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if unit == "line":
            of = codes == 10
        elif unit == "word":
            of = np.isin(codes, [ord(c) for c in SPACES])
        elif unit == "char":
            of = np.zeros(len(codes), bool)
        else:
            raise ValueError(f"no such unit: {unit}")
        self.end = np.append(np.flatnonzero(of[1:] != of[:-1]) + 1, len(codes)) if len(codes) else np.zeros(0, np.int64)
        start = np.append(0, self.end[:-1]) if len(codes) else self.end
        if unit == "word":
            units = np.ones(len(self.end), np.int64)
        elif unit == "char":
            units = self.end - start
        else:
            units = np.where(of[start], self.end - start, 0)
            units[len(units) - 1 :] += not of[-1] if len(codes) else 0
        self.each = unit == "char" or unit == "line"
        self.ended = np.cumsum(units)
        self.n = int(self.ended[-1]) if len(units) else 0

    def cut(self, units: int) -> int:
        """Characters up to the end of so many units."""
        if units <= 0:
            return 0
        run = int(np.searchsorted(self.ended, units))
        # A run whose characters each end a unit holds its last (ended - units) units after the cut; others end whole.
        return int(self.end[run]) - (int(self.ended[run]) - units if self.each else 0)


def draws(doc_id, seed: int = SEED) -> list[int]:
    """The four numbers that decide how a document is cut; a null id counts as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if pd.isna(doc_id) else int(doc_id)}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]


def transform(text: str, h: list[int], unit: str = "line", rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple:
    """(units, form, prefix characters, middle characters, output) of one text."""
    runs = Runs(text, unit)
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h[2] % 100 >= rate:
        return runs.n, "plain", None, None, text
    a, b = sorted((h[0] % (runs.n + 1), h[1] % (runs.n + 1)))
    a, b = runs.cut(a), runs.cut(b)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm_rate:
        return runs.n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return runs.n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """One row per row of df: doc_id, n, form, prefix_chars, middle_chars, output.

    `rate` per cent of the documents are cut, of which `spm_rate` per cent start with the suffix; both depend on seed
    and id only, so repeated rows have equal results. Texts that are empty, null (an empty text) or hold a
    marker stay as they are: form plain, prefix_chars and middle_chars null. A null id draws as an empty one.
    Characters are code points. Texts of any length are cut whole; a text that cannot be encoded as UTF-8 does not
    occur in Spark's strings. An empty table gives no rows. Only id and text are read, and no row moves.
    """

    def run(batches):
        for pdf in batches:
            out = [transform(text or "", draws(doc_id, seed), unit, rate, spm_rate) for doc_id, text in zip(pdf["doc_id"], pdf["text"])]
            frame = pd.DataFrame(out, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
            for name in ("prefix_chars", "middle_chars"):
                frame[name] = frame[name].astype("Int64")
            frame.insert(0, "doc_id", pdf["doc_id"].astype("Int64"))
            yield frame

    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInPandas(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Markers are found in the order that the form gives; as no part holds a
    marker and no marker overlaps another, the first of each is the real one. Null for a null output."""
    size = len(PREFIX)
    second = F.when(form == "psm", F.locate(SUFFIX, output)).otherwise(F.locate(PREFIX, output))
    third = F.locate(MIDDLE, output)
    first_part, second_part = F.substring(output, F.lit(size + 1), second - size - 1), F.substring(output, second + size, third - second - size)
    middle = F.substring(output, third + size, F.length(output))
    parts = F.when(form == "psm", F.concat(first_part, middle, second_part)).otherwise(F.concat(second_part, middle, first_part))
    return F.when(form == "plain", output).otherwise(parts)


SQL = """
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS lines,
         sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS digest
  FROM documents
), k AS (
  SELECT *, len(lines) AS n, ('0x' || substr(digest, 1, 8))::BIGINT % (len(lines) + 1) AS k1, ('0x' || substr(digest, 9, 8))::BIGINT % (len(lines) + 1) AS k2,
         ('0x' || substr(digest, 17, 8))::BIGINT % 100 >= 100 OR text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') AS plain,
         ('0x' || substr(digest, 25, 8))::BIGINT % 100 < 50 AS spm
  FROM h
), parts AS (
  SELECT *, array_to_string(lines[:least(k1, k2)], '') AS prefix, array_to_string(lines[least(k1, k2) + 1:greatest(k1, k2)], '') AS middle,
         array_to_string(lines[greatest(k1, k2) + 1:], '') AS suffix
  FROM k
)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
       CASE WHEN NOT plain THEN length(prefix) END AS prefix_chars, CASE WHEN NOT plain THEN length(middle) END AS middle_chars,
       sha256(CASE WHEN plain THEN text WHEN spm THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
                   ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """Every document's fill-in-the-middle form by lines, and what is restored of it. Nulls, long texts, repeated rows and an
    empty table: as fill_in_middle() says."""
    made = computed_once(fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    text = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))
