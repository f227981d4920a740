import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
import zstandard
from tokenizers import Tokenizer

from albumen.llm import fingerprint, packing, pii, piece_encoding, substring_dedup, toxicity, url_filter, warc
from albumen.llm.common import new_path

EDGE = [(1, None), (2, ""), (3, " \n"), (4, "a b c"), (5, "a b c"), (5, "a b c"), (None, "a b c"), (None, None), (7, "x" * 50_000), (8, "é中🙂 " * 4000)]


def docs_df(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, score string, length int")


def some_texts():
    random.seed(8)
    words = ["the", "River", "über", "ciónraí", "x9", "loser", "lowei", "a", "don't", "3.14"]
    return [" ".join(random.choice(words) + random.choice(["", ",", ".", "\n"]) for _ in range(n)) for n in (1, 5, 60, 400)]


# -- url filter


def judge_brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule, verdict in rules.items():
        h, p = rule.split("/", 1)[0], "/" + rule.split("/", 1)[1]
        if host and (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(rule) > len(best)):
            best = rule
    return host, path, best, rules.get(best, "allow")


def test_urls_against_brute_force(spark):
    rules = {r: "allow" for r in url_filter.ALLOW} | {r: "block" for r in url_filter.BLOCK}
    random.seed(1)
    part = lambda *x: random.choice(x)
    urls = [None, "", "no scheme", "http://", "http://com", "http://com/", "HTTP://Example.COM/en/?q=http://x", "a://b://c/d"]
    urls += [part("http://", "x://", "") + part("www.", "m.", "", "xwww.") + part("example.", "Example.", "") + part("com", "net", "org") + part("", "/", "/en/", "/en/a", "/es/b?c", "/fr/", "/EN/") + part("", "#f", "?q/en/") for _ in range(600)]
    rows = list(enumerate(urls)) + [(None, "http://x.net/es/"), (3, "http://com")]
    df = spark.createDataFrame([(i, u, "clash") for i, u in rows], "page_id long, url string, host string")
    got = url_filter.judge(df, list(url_filter.ALLOW), list(url_filter.BLOCK)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(i, *judge_brute(u, rules)) for i, u in rows], key=str)
    assert url_filter.judge(df.limit(0), list(url_filter.ALLOW), list(url_filter.BLOCK)).collect() == []


def test_cascade_is_exact_for_its_universe(spark):
    listed = [f"bad{i}/" for i in range(300)]
    universe = [f"ok{i}/" for i in range(20_000)] + listed[:100]
    c = url_filter.build(spark, listed, spark.createDataFrame([(k,) for k in universe], "key string"))
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(k,) for k in {*universe, *listed}], "key string").select("key", F.xxhash64("key", F.lit(1)).alias("a"), F.xxhash64("key", F.lit(2)).alias("b")).toPandas()
    assert (c.holds(rows["a"].to_numpy(), rows["b"].to_numpy()) == rows["key"].isin(listed).to_numpy()).all()
    assert len(c.levels) > 1


# -- pieces


def test_pieces_equal_the_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_encoding.default_model())
    v = piece_encoding.Vocabulary(piece_encoding.default_model())
    random.seed(2)
    texts = some_texts() + ["", " ", "  a   b ", "▁ x▁▁y", "\x00the\x01", "中文🙂é" * 40] + ["".join(random.choice(["abthe ing  ", "é中🙂▁ a\n\t"][k % 2]) for _ in range(k % 90)) for k in range(300)]
    for t in texts:
        ids = v.encode(t)
        assert ids.tolist() == sp.encode(t)
        assert v.decode(ids) == sp.decode(sp.encode(t))
    rows = docs_df(spark, EDGE)
    got = piece_encoding.decode(piece_encoding.encode(rows)).collect()
    assert sorted([(r.doc_id, r.ids, r.decoded) for r in got], key=str) == sorted([(i, sp.encode(t or ""), t or "") for i, t in EDGE], key=str)


# -- warc


def warc_brute(rows):
    data = [(i, (h or "").encode()) for i, h in rows]
    first = {}
    for i, b in data:
        if len(b) >= 100 and i is not None:
            first[b] = min(i, first.get(b, i))
    out = []
    for i, b in data:
        ref = first.get(b) if len(b) >= 100 and i != first.get(b) else None
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if ref is not None else "response", ref))
    return sorted(out, key=str)


def test_archives_against_brute_force(spark):
    long = "é" * 60 + "\r\n\r\nWARC/1.1\r\n\r\n"
    rows = [(9, long), (3, long), (4, long), (3, long), (None, long), (5, "short"), (6, "short"), (7, None), (8, ""), (11, "a\r\nb" * 50), (None, "z" * 200), (12, "y" * 99), (13, "y" * 99), (14, "w" * 100), (15, "w" * 100)]
    df = spark.createDataFrame([(i, f"http://x/{i}\n y", h, "clash") for i, h in rows], "page_id long, url string, html string, digest string")
    got = warc.archive(df.repartition(3), new_path(spark, "warc")).drop("uri", "payload").collect()
    assert sorted(map(tuple, got), key=str) == warc_brute(rows)
    assert warc.archive(df.limit(0), new_path(spark, "warc")).collect() == []


def test_payloads_come_back_whole(spark):
    rows = [(i, "http://x", t) for i, t in enumerate([x for x in some_texts()] + ["", "\r\n\r\n"])]
    got = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string"), new_path(spark, "warc")).collect()
    assert {r.page_id: r.payload for r in got} == {i: t for i, _, t in rows}


# -- fingerprints


def test_entropy_classes_against_counts():
    rng = np.random.default_rng(1)
    buf = np.concatenate([rng.integers(0, 9, 300), rng.integers(0, 256, 200), np.full(60, 7)]).astype(np.uint8)
    for i, c in enumerate(fingerprint.entropy_classes(buf)):
        total = sum(int(fingerprint._STEP[:k].sum()) for k in np.bincount(buf[i : i + fingerprint.B]) if k)
        assert c == total * (fingerprint.CLASSES - 1) // fingerprint._MOST


def test_digests_against_one_by_one(spark):
    random.seed(5)
    rows = [(i, t) for i, t in EDGE if i != 5] + [(5, "only once")] + [(100 + 3 * k, " ".join(random.choice(some_texts()[3].split()) + str(random.randrange(99)) for _ in range(k))) for k in range(0, 200, 7)]
    fingerprint_rows, fingerprint.RANGE_ROWS = fingerprint.RANGE_ROWS, 5
    try:
        df = docs_df(spark, rows).repartition(4)
        got = fingerprint.digests(df).collect()
        rank = fingerprint.corpus_ranks(df)
    finally:
        fingerprint.RANGE_ROWS = fingerprint_rows
    assert len(got) == len(rows)
    known = {r.doc_id: r for r in got if r.doc_id is not None}
    order = sorted((i, t or "") for i, t in rows if i is not None)
    chain = lambda t: fingerprint.chains([t.encode()], rank)[0]
    for (i, t), (_, after) in zip(order, order[1:]):
        e = fingerprint.edited(t, after)
        r = known[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert r.fingerprint == chain(t).tobytes().hex() and r.edited_fingerprint == chain(e).tobytes().hex()
        assert r.near_edited == pytest.approx(fingerprint.likeness(chain(t), chain(e))) and r.near_next == pytest.approx(fingerprint.likeness(chain(t), chain(after)))
    assert fingerprint.digests(docs_df(spark, [])).collect() == []
    lone = fingerprint.digests(docs_df(spark, [(1, "a lone text")])).collect()
    assert lone[0].near_next == 1.0


# -- substring dedup


def pieces_by_letters(text):
    """The same cuts, letter by letter."""
    out, at, i = [], 0, 0
    while i < len(text):
        if text[i] == "\n":
            i += 1
        elif text[i] in ".!?。！？":
            wide = text[i] in "。！？"
            while i < len(text) and text[i] in ".!?。！？":
                wide |= text[i] in "。！？"
                i += 1
            if i < len(text) and text[i] not in " \t\n" and not wide:
                continue
            while i < len(text) and text[i] in " \t":
                i += 1
            i += i < len(text) and text[i] == "\n"
        else:
            i += 1
            if i < len(text):
                continue
        out.append((at, i))
        at = i
    return out


def repeats_brute(rows, least):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        t = t or ""
        cut = [(s, e, " ".join(t[s:e].casefold().split())) for s, e in pieces_by_letters(t)]
        cut = [x for x in cut if x[2]]
        gone = set()
        for a in range(len(cut)):
            group = next((cut[a : b + 1] for b in range(a, len(cut)) if sum(len(x[2]) for x in cut[a : b + 1]) >= least), cut if a == 0 else None)
            if group:
                key = tuple(x[2] for x in group)
                if key in seen:
                    gone.update(range(group[0][0], group[-1][1]))
                seen.add(key)
        out[i] = "".join(c for k, c in enumerate(t) if k not in gone)
    return out


def test_pieces_cover_the_text():
    for t in [*some_texts(), "a.b c. d!  e\n\nf... g", "", "\n", "x" * 100_000, ". . .", "1.5 2.5.", "一二。三！ 四\n五？六", "a.。b"]:
        spans = substring_dedup.pieces(t)
        assert spans == pieces_by_letters(t) and "".join(t[s:e] for s, e in spans) == t


@pytest.mark.parametrize("least", [1, 30, 100])
def test_repeats_against_brute_force(spark, least):
    random.seed(6)
    pool = [" ".join(random.choice("abcdefgh") * 3 for _ in range(random.randint(3, 9))) for _ in range(12)]
    rows = [(k, random.choice(["", "Intro. ", "mid sentence "]) + random.choice(["\n", ". ", "。"]).join(random.choice(pool) for _ in range(6))) for k in range(60)]
    rows += [(90, None), (91, ""), (None, pool[0]), (92, "spam. " * 300), (93, "Read more\nAn own line\n\n"), (94, "Another\nread  MORE\n\n"), (95, "本文書是一個測試。" * 3), (96, "其他。" + "本文書是一個測試。" * 3)]
    got = substring_dedup.remove_repeats(docs_df(spark, rows).repartition(5), min_chars=least).collect()
    assert {r.doc_id: r.kept_text for r in got} == repeats_brute(rows, least)
    texts = dict(rows)
    for r in got:
        spans = [tuple(map(int, x.split(":"))) for x in r.removed.split(",") if x]
        t = texts[r.doc_id] or ""
        assert r.n_removed == len(spans) and r.removed_chars == len(t) - len(r.kept_text)
        assert "".join(c for k, c in enumerate(t) if not any(a <= k < b for a, b in spans)) == r.kept_text
    assert substring_dedup.remove_repeats(docs_df(spark, [])).collect() == []


# -- toxicity


def test_toxicity_learns_and_leaves_held_out_rows(spark):
    random.seed(7)
    plain = "river stone water lantern meadow copper window harvest autumn thunder".split()
    bad = "gruxle vorpik snazzot".split()
    docs, labels = [], []
    for k in range(400):
        words = [random.choice(plain) + random.choice(["", "s", "ing", "ed"]) for _ in range(40)]
        y = int(k % 4 == 0)
        if y:
            for _ in range(3):
                words[random.randrange(40)] = random.choice(bad) + random.choice(["", "s", "ed"])
        docs.append((k, " ".join(words)))
        labels.append((k, y))
    docs += [(None, "x"), (1000, None), (1001, ""), (1001, "")]
    lab = spark.createDataFrame(labels + [(5, None), (None, 1), (7, 3)], "doc_id long, toxic int")
    got = toxicity.toxic_scores(docs_df(spark, docs), lab).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert {r.doc_id for r in held} == {k for k in truth if zlib.crc32(str(k).encode()) % 3 == 1}
    assert sum((r.predicted == 1) == (truth[r.doc_id] == 1) for r in held) >= 0.9 * len(held)
    none = toxicity.toxic_scores(docs_df(spark, docs[:3]), lab.limit(0)).collect()
    assert [r.score for r in none] == [0.0] * 3
    assert toxicity.toxic_scores(docs_df(spark, []), lab).collect() == []


def test_scores_against_plain_compression(spark):
    """Each word compressed by itself with a fresh compressor, and the score worked out from the lengths."""
    random.seed(9)
    plain = "river stone water lantern meadow copper window harvest autumn thunder".split()
    rows = [(" ".join([random.choice(plain) for _ in range(20)] + ["gruxle", "vorpiks"] * (k % 3 == 0)), int(k % 3 == 0)) for k in range(60)]
    model = toxicity.fit(rows)

    def length(word, content):
        data = zstandard.ZstdCompressionDict(content + toxicity.TAIL, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters(
            window_log=17, hash_log=13, chain_log=13, search_log=5, min_match=4, target_length=32, strategy=zstandard.STRATEGY_LAZY2,
            write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        )
        return len(zstandard.ZstdCompressor(dict_data=data, compression_params=how).compress(b" " + word.encode() + toxicity.TAIL))

    def score(text):
        words = (text or "").lower().split()
        d = sorted((length(w, model["dictionaries"][1]) - length(w, model["dictionaries"][0]) for w in words), reverse=True)
        top = [*d, *[0] * 8][:8] if len(d) < 8 else d[:8]
        x = np.array([top[0], top[1], top[2], sum(top[:4]), sum(top), np.log1p(len(words))])
        return 1 / (1 + np.exp(-((x - model["mean"]) / model["scale"] @ model["weights"][:-1] + model["weights"][-1])))

    texts = [t for t, _ in rows[:12]] + [None, "", "Gruxle!", "unknown words here"]
    df = docs_df(spark, list(enumerate(texts)))
    got = {r.doc_id: r.p for r in toxicity.with_score(df, model, name="p").collect()}
    assert all(abs(got[k] - score(t)) < 1e-6 for k, t in enumerate(texts))


# -- packing


def test_packing_covers_every_id_once(spark):
    rows = EDGE + list(enumerate(some_texts(), 50)) + [(60, "İ. Σς <|endoftext|> a\x1cb")]
    t = Tokenizer.from_file(packing.default_tokenizer())
    ids = lambda x: t.encode(x or "", add_special_tokens=False).ids + [2]
    got = packing.pack(docs_df(spark, rows).repartition(3)).collect()
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append(r)
        by_doc[r.doc_id].append(r)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096 and at & (at - 1) == 0
    unique = Counter(i for i, _ in rows)
    for i, text in rows:
        if unique[i] == 1:
            want, at = ids(text), 0
            for p in sorted(by_doc[i], key=lambda p: p.start):
                part = want[p.start : p.start + p.length]
                assert p.start == at and p.doc_tokens == len(want) and p.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
                at += p.length
            assert at == len(want)
    assert sum(r.length for r in got) == sum(len(ids(x)) for _, x in rows)
    assert packing.pack(docs_df(spark, [])).collect() == []


def test_blocks_have_no_padding_and_whole_windows():
    random.seed(3)
    lengths = [random.choice([1, 2, 511, 512, 513, 4095, 4096, 4097, 9000, 37]) for _ in range(700)]
    sequences = packing.pack_block(lengths)
    covered = defaultdict(list)
    for s in sequences:
        n = sum(x for _, _, x in s)
        assert n <= 4096 and n & (n - 1) == 0
        for d, a, n in s:
            covered[d].append((a, n))
    for d, n in enumerate(lengths):
        at = 0
        for a, m in sorted(covered[d]):
            assert a == at
            at += m
        assert at == n


# -- personal data


def pii_brute(text):
    out = []
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
            if (kind == "email") or (kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (kind == "card" and 13 <= len(digits) <= 19 and luhn) or (kind == "phone" and 9 <= len(digits) <= 15):
                out.append((kind, *m.span()))
    return out


def test_base_spans_against_patterns():
    random.seed(4)
    for _ in range(20_000):
        letters = random.choice(["a.@-+_ b", "019. 2-+()", "0123456789 ", "1.2@a-", "+1 ()5.-x"])
        t = "".join(random.choice(letters) for _ in range(random.randint(0, 40)))
        assert pii.base_spans(t) == pii_brute(t)
    assert pii.base_spans("a" * 300_000 + "1" * 300_000 + "@" * 99) == []


def test_found_spans_keep_the_base(spark):
    text = "Call +1 (626) 555-5759, later 626-555-5759 and 626 555 5759. Mail jo.doe42@mail.example.com from 10.1.2.3; card 4041894974608795 or 4041 8949 7460 8795."
    rows = EDGE + [(30, text), (31, text), (32, "nothing 12345")]
    got = pii.find_pii(docs_df(spark, rows)).collect()
    want = sorted([(i, *(Counter(k for k, _, _ in pii_brute(t or ""))[k] for k in pii.KINDS), hashlib.sha256(pii.spell(pii_brute(t or "")).encode()).hexdigest()) for i, t in rows], key=str)
    assert sorted([tuple(r)[:6] for r in got], key=str) == want
    spans = {r.doc_id: r.spans.split(",") for r in got}
    assert set(pii.spell(pii_brute(text)).split(",")) < set(spans[30])  # the repeated number is added
    assert pii.find_pii(docs_df(spark, [])).collect() == []
    masked = {r.doc_id: r.masked for r in pii.with_masked(docs_df(spark, rows)).collect()}
    assert masked[1] is None and masked[32] == "nothing 12345" and "5759" not in masked[30] and "[EMAIL]" in masked[30]


def test_loopy_messages_spread_a_label():
    table = np.log(np.where(np.eye(5) > 0, 0.95, 0.0125))
    model = {"unary": {}, "skip": dict.fromkeys(pii.LINKS, table), "chain": np.zeros((5, 5))}
    nodes = [(0, 1, "phone", "s"), (2, 3, "", "s"), (4, 5, "", "s"), (6, 7, "", "s")]
    p = pii.marginals(nodes, [(0, 1, "folded"), (0, 2, "folded"), (1, 2, "folded")], model)
    assert p[0].argmax() == 4 and p[1].argmax() == 4 and p[2].argmax() == 4 and p[3].argmax() == 0


def marginals_by_enumeration(nodes, edges, model):
    k, n = len(pii.LABELS), len(nodes)
    plain = np.log(np.array([pii.LOOSE, *[1.0] * 4]) / (pii.LOOSE + 4))
    total = np.zeros((n, k))
    for labels in itertools.product(range(k), repeat=n):
        if any(kind and pii.LABELS[x] != kind for x, (_, _, kind, _) in zip(labels, nodes)):
            continue
        score = sum(model["unary"].get(s, plain)[x] for x, (_, _, kind, s) in zip(labels, nodes) if not kind)
        score += sum(model["skip"][link][labels[i], labels[j]] for i, j, link in edges) + sum(model["chain"][a, b] for a, b in zip(labels, labels[1:]))
        for i, x in enumerate(labels):
            total[i, x] += np.exp(score)
    return total / total.sum(axis=1, keepdims=True)


def test_messages_against_enumeration():
    rng = np.random.default_rng(2)
    table = lambda p: np.log(np.where(np.eye(5) > 0, p, (1 - p) / 4))
    for case in range(40):
        n = int(rng.integers(1, 6))
        model = {"unary": {"a": np.log(rng.dirichlet(np.ones(5))), "b": np.log(rng.dirichlet(np.ones(5)))}, "skip": {x: table(rng.uniform(0.5, 0.97)) for x in pii.LINKS}, "chain": table(0.3) * 0.1}
        nodes = [(2 * i, 2 * i + 1, str(rng.choice(["", "", "card", "phone"])), str(rng.choice(["a", "b", "c"]))) for i in range(n)]
        edges = [(i, j, str(rng.choice(pii.LINKS))) for i in range(n) for j in range(i + 2, n) if rng.random() < 0.4]
        got, want = pii.marginals(nodes, edges, model), marginals_by_enumeration(nodes, edges, model)
        loops = len(edges) > 0
        assert np.abs(got - want).max() < (0.2 if loops else 1e-3), case
        clear = want.max(axis=1) > 0.7
        assert (got.argmax(axis=1) == want.argmax(axis=1))[clear].all()


def test_similar_runs_are_linked():
    text = "card 4041894974608795, so 4041894974608796 or 4041 8949 7460 8796; not 4041894974608111"
    nodes, edges = pii.graph(text, pii.base_spans(text))
    assert [text[s:e] for s, e, _, _ in nodes] == ["4041894974608795", "4041894974608796", "4041 8949 7460 8796", "4041894974608111"]
    assert {(i, j): link for i, j, link in edges} == {(0, 1): "similar", (0, 2): "similar", (1, 2): "folded"}
    nodes, edges = pii.graph("call 555 010 4477 or 555-010-4477", [])
    assert len(nodes) == 2 and edges == [(0, 1, "folded")]


def test_step_groups_are_balanced(monkeypatch):
    monkeypatch.setattr(packing, "STEP_TOKENS", 16_384)
    random.seed(3)
    sequences = packing.pack_block([random.choice([random.randint(1, 300), random.randint(300, 5000)]) for _ in range(400)])
    groups: dict = {}
    for pieces, g in zip(sequences, packing.step_groups(sequences)):
        groups.setdefault(g, []).append(pieces)
    sizes: dict = {}
    for rows in groups.values():
        lengths = {sum(n for _, _, n in pieces) for pieces in rows}
        assert len(lengths) == 1 and len(rows) * min(lengths) <= packing.STEP_TOKENS
        sizes.setdefault(lengths.pop(), []).append((len(rows), sum(n * n for pieces in rows for _, _, n in pieces)))
    assert sorted(groups) == list(range(len(groups)))
    for length, rows in sizes.items():
        assert max(n for n, _ in rows) - min(n for n, _ in rows) <= 1
        if len(rows) > 1 and min(n for n, _ in rows) == max(n for n, _ in rows) > 1:
            assert max(c for _, c in rows) - min(c for _, c in rows) <= length * length


def test_long_tiers_take_what_is_long():
    sequences = packing.pack_block([3000, 900, 400, 100, 60, 30, 1500, 20])
    first = next(p for p in sequences if any(d == 0 for d, _, _ in p))
    assert [(d, n) for d, _, n in first] == [(0, 3000), (1, 900), (3, 100), (4, 60), (5, 30), (7, 6)]


def test_very_long_urls(spark):
    urls = ["http://" + "a." * 20_000 + "net/es/x", "http://" + "a" * 100_000 + "/en/", "http://b." + "x" * 50_000 + ".example.com/en/" + "y" * 50_000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(df, list(url_filter.ALLOW), list(url_filter.BLOCK)).collect()}
    assert got == {0: ("net/es/", "block"), 1: (None, "allow"), 2: ("example.com/en/", "block")}


def test_many_rules(spark):
    rules = [f"s{k}.org/" for k in range(3000)]
    df = spark.createDataFrame([(k, f"http://s{k}.org/a") for k in range(2500, 4500)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.judge(df, [], rules).collect()}
    assert got == {k: "block" if k < 3000 else "allow" for k in range(2500, 4500)}


def test_archives_of_long_payloads(spark, monkeypatch):
    rows = [(k, None if k % 5 == 0 else f"http://h/{k} x", "é" * (400_000 if k == 3 else 20 * k)) for k in range(12)] + [(None, "u", None), (3, "again", "other " * 50), (20, "copy", "é" * 400_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    monkeypatch.setattr(warc, "FILE_BYTES", 200_000)
    path = new_path(spark, "warc")
    out = warc.archive(df, path).collect()
    assert len(out) == len(rows) and sorted((r.page_id is None, r.page_id or 0, r.payload_bytes) for r in out) == sorted((i is None, i or 0, len((t or "").encode())) for i, _, t in rows)
    assert {(r.page_id, r.refers_to, r.payload) for r in out if r.record_type == "revisit"} == {(20, 3, None)}
    raw = [h for row in spark.read.format("binaryFile").load(path).collect() for h, _ in warc.parse(bytes(row.content))]
    assert spark.read.format("binaryFile").load(path).count() > 1 and len({h["warc-record-id"] for h in raw}) == len(rows)
    copy = next(h for h in raw if h["warc-type"] == "revisit")
    assert copy["warc-refers-to-target-uri"] == "http://h/3%20x" and copy["warc-refers-to-date"] == warc.DATE
