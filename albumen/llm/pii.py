"""Personal data by patterns and a skip-chain conditional random field.

Patterns find emails, IP addresses, card and phone numbers. The field's variables are a text's pattern
matches, its long runs like numbers, and the name-like tokens that resemble a match. Occurrences of equal or
similar tokens (equal but for one sign) are joined by skip edges however far apart, neighbours in the text by
chain edges, and loopy message passing spreads the labels. Matches are clamped to their kind, and tokens that
then take a kind with high probability are added as spans. Potentials are counted over all documents, on top of
counts that stand for what is known before.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
#: Links by which tokens share potentials: the same text, the same after folding, a part of the other, and the same
#: but for one sign.
LINKS = ("same", "folded", "part", "similar")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Starting within a run of digits never helps: a run is read from its start, and never given back.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SIGNS = re.compile(r"[0-9@]")
#: What every run like a number of seven digits has.
RUN = re.compile(r"[0-9][\x20().-]{0,2}[0-9][\x20().-]{0,2}[0-9]")
DIGITS = re.compile(r"[^0-9]+")
#: Tokens that may be joined to a match: runs like numbers, and words like the names in addresses.
NUMBERS = re.compile(r"(?<![0-9A-Za-z])[0-9](?:[\x20().-]{0,2}[0-9])*+(?![0-9A-Za-z])")
NAMES = re.compile(r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9][A-Za-z0-9._%+-]*+(?![@A-Za-z0-9])")
#: Digits, or characters of a name, that a part must have; rounds of message passing; what a new span needs.
PART_DIGITS, PART_NAME, ROUNDS, DAMPING, ACCEPT = 7, 6, 200, 0.3, 0.9
#: Digits of a run that is compared by similarity: those of the longest card number.
MOST_DIGITS = 19
#: Counts that stand for what is known before any text is read: linked tokens agree, loose tokens are no data.
AGREE, DISAGREE, LOOSE = 95.0, 5.0, 20.0


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns, leftmost and without overlap per kind, by kind and then start.

    Matches with an impossible number, length or check digit are dropped and not tried again. Linear in the text.
    """
    if not SIGNS.search(text):
        return []
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = DIGITS.sub("", m[0])
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(DIGITS.sub("", m[0])) <= 15]
    return out


def _shape(token: str) -> str:
    digits = sum("0" <= c <= "9" for c in token)
    if digits and digits >= len(token) / 2:
        return f"number{min(digits, 20)}"
    return f"name{min(len(token), 20)}{'d' * bool(digits)}{'p' * any(c in '._%+-' for c in token)}"


def _keys(kind: str, token: str) -> dict[str, str]:
    """What a match can be known by elsewhere: key -> sort of link."""
    if kind == "email":
        low = token.lower()
        name = low.split("@", 1)[0]
        return {low: "same"} | ({name: "part"} if len(name) >= PART_NAME and re.search("[0-9._%+-]", name) else {})
    digits = DIGITS.sub("", token)
    if kind == "ip":
        return {token: "same"}
    keys = {digits: "folded"}
    if kind == "phone" and len(digits) >= PART_DIGITS + 3:
        keys[digits[-10:]] = "part"
    return keys | _masked(digits)


def _masked(digits: str) -> dict[str, str]:
    """Keys that long runs share if they are equal but for one digit."""
    if not PART_DIGITS + 2 <= len(digits) <= MOST_DIGITS:
        return {}
    return {digits[:i] + "?" + digits[i + 1 :]: "similar" for i in range(len(digits))}


def _tokens(text: str, taken: list[tuple[int, int]], wanted: set[str]) -> list[tuple[int, int, dict[str, str]]]:
    """(start, end, keys) of tokens outside the matches: all runs like numbers of PART_DIGITS digits or more, and shorter
    runs and names of which a match has the key."""
    starts = np.array([s for s, _ in taken])
    most = np.maximum.accumulate(np.array([e for _, e in taken])) if taken else starts
    out: dict[tuple[int, int], dict[str, str]] = {}

    def free(start: int, end: int) -> bool:
        k = int(np.searchsorted(starts, end)) - 1 if taken else -1
        return k < 0 or most[k] <= start

    for m in NUMBERS.finditer(text):
        token = m[0].rstrip(".")
        digits = DIGITS.sub("", token)
        if (len(digits) >= PART_DIGITS or not wanted.isdisjoint((token, digits))) and free(m.start(), m.start() + len(token)):
            out[m.start(), m.start() + len(token)] = {digits: "folded", token: "same"} | _masked(digits)
    if wanted:
        for m in NAMES.finditer(text):
            token = m[0].rstrip(".")
            if token.lower() in wanted and free(m.start(), m.start() + len(token)):
                out.setdefault((m.start(), m.start() + len(token)), {})[token.lower()] = "part"
    return [(s, e, keys) for (s, e), keys in out.items()]


def graph(text: str, base: list[tuple[str, int, int]]):
    """Nodes (start, end, kind or '', shape) in the order of the text, and skip edges (i, j, link).

    Occurrences of a key are joined to the one before and to the first match that has it, so edges grow with tokens
    and not with their pairs. Of several links of two nodes, the closest counts.
    """
    matches = [(s, e, kind, _keys(kind, text[s:e])) for kind, s, e in base]
    wanted = {key: link for _, _, _, keys in reversed(matches) for key, link in keys.items()}
    loose = [(s, e, "", keys) for s, e, keys in _tokens(text, sorted((s, e) for _, s, e in base), set(wanted))]
    nodes = sorted(matches + loose, key=lambda n: n[:3])
    last: dict[str, int] = {}
    first_base: dict[str, int] = {}
    edges: dict[tuple[int, int], int] = {}
    for i, (_, _, kind, keys) in enumerate(nodes):
        if kind:
            for key in keys:
                first_base.setdefault(key, i)
    for i, (_, _, _, keys) in enumerate(nodes):
        for key, link in keys.items():
            rank = LINKS.index(wanted.get(key, link))
            for j in (last.get(key), first_base.get(key)):
                if j is not None and j != i:
                    pair = (min(i, j), max(i, j))
                    edges[pair] = min(edges.get(pair, rank), rank)
            last[key] = i
    return [(s, e, kind, _shape(text[s:e])) for s, e, kind, _ in nodes], [(i, j, LINKS[r]) for (i, j), r in sorted(edges.items())]


def _count(batches):
    """Counts that the potentials are made of: ('unary', shape, label), ('skip', link, agree) and ('chain', agree)."""
    counts: Counter = Counter()
    for pdf in batches:
        for text in pdf["text"]:
            if not text or not SIGNS.search(text):
                continue
            nodes, edges = graph(text, base_spans(text))
            for _, _, kind, shape in nodes:
                counts["unary", shape, kind or "none"] += 1
            for i, j, link in edges:
                if nodes[i][2] and nodes[j][2]:  # tokens that no pattern labels say nothing about agreement
                    counts["skip", link, str(nodes[i][2] == nodes[j][2])] += 1
            for a, b in zip(nodes, nodes[1:]):
                if a[2] and b[2]:
                    counts["chain", "", str(a[2] == b[2])] += 1
    if counts:
        yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["what", "key", "value", "n"])


def potentials(docs: DataFrame, text_col: str = "text") -> dict:
    """Log potentials from counts over all documents; the table of counts has a fixed number of keys."""
    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInPandas(_count, "what string, key string, value string, n long")
    n: dict = defaultdict(float)
    for r in rows.groupBy("what", "key", "value").agg(F.sum("n").alias("n")).collect():
        n[r.what, r["key"], r["value"]] = float(r.n)
    unary: dict = {}
    for shape in {k for w, k, _ in n if w == "unary"}:
        # A loose token's own look says little for a kind: the patterns have taken what they can tell.
        each = np.array([n["unary", shape, x] for x in LABELS]) + np.array([LOOSE, *[1.0] * len(KINDS)])
        each[1:] = np.minimum(each[1:], each[0])
        unary[shape] = np.log(each / each.sum())

    def table(same: float, other: float) -> np.ndarray:
        p = same / (same + other)
        return np.log(np.where(np.eye(len(LABELS)) > 0, p, (1 - p) / (len(LABELS) - 1)))

    skip = {x: table(AGREE + n["skip", x, "True"], DISAGREE + n["skip", x, "False"]) for x in LINKS}
    # Neighbours in the text: a weak chain potential.
    agree = n["chain", "", "True"] + 1
    chain = table(agree + AGREE, n["chain", "", "False"] + AGREE) * 0.1
    return {"unary": unary, "skip": skip, "chain": chain}


def marginals(nodes: list, edges: list, model: dict) -> np.ndarray:
    """Label probabilities by loopy sum-product in logs; matches are clamped."""
    k = len(LABELS)
    plain = np.log(np.array([LOOSE, *[1.0] * len(KINDS)]) / (LOOSE + len(KINDS)))
    own = np.array([model["unary"].get(shape, plain) for _, _, _, shape in nodes])
    for i, (_, _, kind, _) in enumerate(nodes):
        if kind:
            own[i] = -1e3
            own[i, LABELS.index(kind)] = 0
    links = [(i, j, model["skip"][x]) for i, j, x in edges] + [(i, i + 1, model["chain"]) for i in range(len(nodes) - 1)]
    if not links:
        return np.exp(own - np.logaddexp.reduce(own, axis=1, keepdims=True))
    src = np.array([i for i, _, _ in links] + [j for _, j, _ in links])
    dst = np.array([j for _, j, _ in links] + [i for i, _, _ in links])
    pair = np.array([t for _, _, t in links] * 2)  # tables are symmetric
    back = (np.arange(len(src)) + len(links)) % len(src)
    msg = np.zeros((len(src), k))
    for _ in range(ROUNDS):  # damped messages settle within some 20; a graph that has not by then keeps its last
        belief = own.copy()
        np.add.at(belief, dst, msg)
        new = np.logaddexp.reduce((belief[src] - msg[back])[:, :, None] + pair, axis=1)
        new -= np.logaddexp.reduce(new, axis=1, keepdims=True)
        moved = np.abs(new - msg).max()
        msg = DAMPING * msg + (1 - DAMPING) * new
        if moved < 1e-4:
            break
    belief = own.copy()
    np.add.at(belief, dst, msg)
    return np.exp(belief - np.logaddexp.reduce(belief, axis=1, keepdims=True))


def all_spans(text: str | None, model: dict) -> tuple[list, list]:
    """The pattern spans, and those with the spans that the field adds, both by kind and start."""
    base = base_spans(text or "")
    if not base and not RUN.search(text or ""):
        return [], []
    nodes, edges = graph(text, base)
    if all(kind for _, _, kind, _ in nodes):
        return base, base
    p, added = marginals(nodes, edges, model), []
    for (s, e, kind, _), q in zip(nodes, p):
        best = int(q[1:].argmax()) + 1
        if not kind and q[best] >= ACCEPT:
            added.append((LABELS[best], s, e))
    return base, sorted(set(base + added), key=lambda x: (KINDS.index(x[0]), x[1:]))


def spell(spans: list) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _find(model, redact: bool):
    def run(batches):
        m = model.value
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                base, spans = all_spans(text, m)
                counts = Counter(k for k, _, _ in base)
                row = [*(counts[k] for k in KINDS), hashlib.sha256(spell(base).encode()).hexdigest(), spell(spans)]
                out.append(row + [mask(text, spans)] if redact else row)
            yield pd.concat([pdf.drop(columns="text"), pd.DataFrame(out, columns=COLUMNS + ["masked"] * redact, index=pdf.index)], axis=1)

    return run


COLUMNS = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans"]


def mask(text: str | None, spans: list) -> str | None:
    """The text with each span replaced by its kind in brackets; of overlapping spans, the first and longest names it."""
    if not spans:
        return text
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Counts and digest are of the pattern spans, `spans` also has what the field adds. Null and empty texts
    have none: zero counts, the digest of the empty string, an empty string. Null ids and repeated rows are
    kept as they are. Only id and text are read. Two narrow passes; only a small table of counts is shuffled.
    """
    model = docs.sparkSession.sparkContext.broadcast(potentials(docs, text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

    def run(batches):
        for pdf in _find(model, False)(batches):
            pdf["doc_id"] = pdf["doc_id"].astype("Int64")
            yield pdf

    return rows.mapInPandas(run, schema)


def with_masked(docs: DataFrame, text_col: str = "text", name: str = "masked") -> DataFrame:
    """docs with `name`: the text with its personal data masked; null stays null, empty and long texts are masked like
    any other, repeated rows are kept, and an empty table gives no rows."""
    model = docs.sparkSession.sparkContext.broadcast(potentials(docs, text_col))

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: mask(t, all_spans(t, model.value)[1]), na_action="ignore")

    return docs.withColumn(name, run(F.col(text_col).cast("string")))


def op10_pii(spark, sf_dir: str) -> DataFrame:
    """Spans of personal data in every text. Null and empty texts, repeated rows and an empty table: as find_pii() says."""
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
