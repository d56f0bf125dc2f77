"""Odd inputs: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandwise.llm import dac, exact_dedup, host_reputation, lang_id, partenum, raking, secret_scan, suffix_decontam, toxicity, warc_fixity

# column names that the operators use inside
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, row string, node string, hits string, p double"


def docs(spark, texts, ids=None):
    rows = [(i, t, "en", None if i and i % 3 == 0 else "s", 1, 7, "x", "y", "z", 0.5) for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, DOCS)


LONG = "word " * 30_000 + "end"
ODD = [None, "", " \n\t ", "x", "The same text. Ünï", "the SAME text. Ünï", "The same text. Ünï", LONG, LONG.upper(), "a\x00b　c", "token = 'abcdefghijklmnop'"]


def brute_dedup(texts):
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for t in texts]
    groups = {}
    for i, t in enumerate(low):
        groups.setdefault(t, []).append(i)
    return {i: (max(groups[t]), len(groups[t]), i == max(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in enumerate(low)}


def test_exact_dedup(spark):
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.report(docs(spark, ODD)).collect()}
    assert got == brute_dedup(ODD)
    assert sorted(r.doc_id for r in exact_dedup.remove(docs(spark, ODD)).collect()) == sorted(i for i, x in got.items() if x[2])
    assert exact_dedup.remove(docs(spark, ODD)).columns == docs(spark, ODD).columns
    assert exact_dedup.report(docs(spark, ODD).limit(0)).count() == 0
    nulls = exact_dedup.report(docs(spark, ["a", "a", "b"], [None, 4, None])).collect()
    assert sorted((r.keep_id or -1, r.group_size, r.kept) for r in nulls) == [(-1, 1, True), (4, 2, False), (4, 2, True)]


def test_exact_dedup_with_full_filters(spark, monkeypatch):
    """Filters that let everything through change nothing."""
    monkeypatch.setattr(exact_dedup, "LENGTH_BITS", 8)
    monkeypatch.setattr(exact_dedup, "PREFIX_BITS", 8)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.report(docs(spark, ODD)).collect()}
    assert got == brute_dedup(ODD)


RULES = [
    ("assign", re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), lambda m: len(m[2]) >= 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
    ("pem", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"), lambda m: True),
    ("jwt", re.compile(r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"), lambda m: True),
]


def brute_spans(text):
    return sorted((m.start(), k, m.end()) for k, (_, rule, ok) in enumerate(RULES) for m in rule.finditer(text) if ok(m))


def test_secret_automaton_matches_regular_expressions():
    a = secret_scan.compile_rules()
    for text in ("secret=password: token=abcdefghij12", "token: secret = 'x' token=abcdefghijkl", "api_key=short passwd:" + "y" * 20):
        assert secret_scan.scan(a, text.encode()) == brute_spans(text), text
    rng = random.Random(1)
    parts = ["token", "SECRET", "passwd", "password", "api_key", "apikey", "=", ":", " ", "'", '"', "a", "0123456789abcdef", "abc.def", "AKIA", "AKIAABCDEFGHIJKLMN", "Z9", "eyJ", "eyJab", ".", "-----BEGIN ", "PRIVATE KEY-----", "x" * 12, "\n", "=="]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert secret_scan.scan(a, text.encode()) == brute_spans(text), text


def test_secret_spans_count_code_points(spark):
    texts = ["é token = abcdefghijkl ü", None, "", "日本 0123456789abcdef", "AKIA" + "A" * 14 + " password:short"]
    got = {r.doc_id: r.spans for r in secret_scan.report(secret_scan.find(docs(spark, texts))).collect()}
    names = [r[0] for r in RULES]
    assert got == {i: ",".join(f"{names[k]}:{s}:{e}" for s, k, e in brute_spans(t or "")) for i, t in enumerate(texts)}
    clean = {r.id: r.text for r in secret_scan.redact(docs(spark, texts)).collect()}
    assert clean[0] == "é [secret] ü" and clean[3] == "日本 [secret]"


def test_rules_that_overlap_ambiguously_are_refused():
    rule = secret_scan.Rule("bad", (secret_scan.some("ab"), secret_scan.literal("c"), secret_scan.some("abc"), secret_scan.literal("d")))
    other = secret_scan.Rule("worse", (secret_scan.literal("xax"), secret_scan.some("y")))
    secret_scan.compile_rules((other,))
    assert secret_scan.compile_rules((rule,))  # matches only after the first start's own match


def test_directly_addressable_codes():
    rng = np.random.default_rng(4)
    ids = np.concatenate([rng.integers(0, 256, 3000), rng.integers(0, 1 << 32, 500), rng.integers(0, 70000, 3000)]).astype(np.uint32)
    s = dac.Segment(dac.pack([5, None, 9], np.array([0, 6000, 500]), ids))
    assert s.doc_ids == [5, None, 9]
    at = rng.integers(0, len(ids), 2000)
    assert (s.access(at) == ids[at]).all() and (s.document(1) == ids[:6000]).all() and len(s.document(0)) == 0
    assert len(dac.Segment(dac.pack([], np.zeros(0, int), np.zeros(0, np.uint32))).access(np.zeros(0, int))) == 0


def test_encoder_equals_the_tokenizer(spark):
    e = dac.Encoder(dac.public_tokenizer(), cache=50)
    rng = random.Random(3)
    parts = ["a", "Bc", " ", "  ", "\n", "\t", "é", " ", "　", "'s", "<|endoftext|>", "<|", "12", "!", "​", "\x1c", "\r\n", "日本", "–"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(2000)]
    data, off = dac.text_bytes(pa.array(texts))
    want = e.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [x.tolist() for x in e.encode(data, off)] == [x.ids for x in want]
    # small segments, through the files
    rows = sorted(enumerate(ODD), key=lambda r: r[0])
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in dac.report(docs(spark, ODD), segment=20).collect()}
    at = 0
    for i, t in rows:
        ids = np.array([*e.tokenizer.encode(t or "", add_special_tokens=False).ids, dac.END_ID], "<u4")
        assert got[i] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert dac.report(docs(spark, ODD).limit(0)).count() == 0


def brute_components(texts, size, num, den):
    sets = []
    for t in texts:
        x = (t or "").encode().lower().split()
        sets.append({tuple(x[i : i + size]) for i in range(len(x) - size + 1)} if len(x) >= size else {tuple(x)} if x else set())
    root = list(range(len(texts)))
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a and b and den * len(a & b) >= num * len(a | b)]
    for _ in texts:
        before = list(root)
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
        if root == before:
            break
    return {i: (len(s), root[i]) for i, s in enumerate(sets)}


@pytest.mark.parametrize("size, num, hot", [(4, 85, 1 << 20), (5, 80, 3)])
def test_partenum_finds_every_link(spark, size, num, hot, monkeypatch):
    for name, value in (("BLOCK_ITEMS", 300), ("GROUP_BYTES", 2000), ("HOT_ROWS", hot), ("HOT_TIMES", 0 if hot < 1000 else 16)):
        monkeypatch.setattr(partenum, name, value)
    rng = random.Random(size)
    words = [f"w{i}" for i in range(400)]
    texts = list(ODD)
    base = [rng.choice(words) for _ in range(70)]
    for _ in range(45):  # a dense family on both sides of the threshold
        own = list(base)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(70)] = rng.choice(words)
        texts.append(" ".join(own))
    for n in (3, 4, 5, 6, 7, 8, 12, 20, 30):
        own = [rng.choice(words) for _ in range(n)]
        texts += [" ".join(own), " ".join(own), " ".join([*own, "more"]), " ".join(own[:-1])]
    found = partenum.classes(partenum.join(docs(spark, texts), size=size, num=num))
    assert {r.id: (r.n, r.component) for r in found.collect()} == brute_components(texts, size, num, 100)


def test_partenum_on_empty_tables_and_removal(spark):
    assert partenum.report(docs(spark, ["a"]).limit(0)).count() == 0
    texts = ["one two three four five six", "One two three four five six", None, "", "other words are in this one here"]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    kept = partenum.remove(docs(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 4] and kept.columns == docs(spark, texts).columns
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    # null ids: one with a partner that has an id goes, of others each text stays once; repeated ids may have other texts
    texts = ["a b c d e f g", "A b c d e f g", "q r s t u v", "q r s t u v", "q r s t u w x", "lone one", "n n n", ""]
    kept = partenum.remove(docs(spark, texts, [None, 5, None, None, 5, 9, None, None])).collect()
    assert sorted((r.doc_id or -1, r.text) for r in kept) == [(-1, ""), (-1, "n n n"), (-1, "q r s t u v"), (-1, "q r s t u v"), (5, "A b c d e f g"), (5, "q r s t u w x"), (9, "lone one")]


def thue_morse(n):
    """A word over a and b and its complement, which every polynomial modulo 2^64 takes for one."""
    text = "a"
    while len(text) < n:
        text += text.translate(str.maketrans("ab", "ba"))
    return text[:n], text[:n].translate(str.maketrans("ab", "ba"))


def test_words_that_polynomial_hashes_confuse(spark):
    x, y = thue_morse(1024)
    rest = " b c d e f g h i j k l"
    assert len({r.component_id for r in partenum.report(docs(spark, [x, y, x])).collect()}) == 2
    bench = spark.createDataFrame([(1, x), (2, x + rest)], "item_id long, text string")
    found = {r.doc_id: r.n_hit for r in suffix_decontam.report(suffix_decontam.matches(docs(spark, [y, x, y + rest]), bench)).collect()}
    assert found == {0: 0, 1: 1, 2: 11}
    e = dac.Encoder(dac.public_tokenizer())
    data, off = dac.text_bytes(pa.array([x, y, x + " " + y]))
    assert [i.tolist() for i in e.encode(data, off)] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in (x, y, x + " " + y)]


def test_partenum_on_a_large_family(spark):
    """5000 near copies of a text, none alike enough to the text itself, 60 components among them, and 5000 exact copies."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for n in range(5000):
        own = list(base)
        own[n % 60], own[(n + 30) % 60] = f"x{n}", "y"
        texts.append(" ".join(own))
    texts += [" ".join(base)] * 5000 + [" ".join(rng.sample(base, 60)) for _ in range(5)]
    sample = [*range(0, 240), 5000]
    want = brute_components([texts[i] for i in sample], 4, 85, 100)
    assert all(sample[want[n][1]] == (i % 60 if i < 5000 else i) for n, i in enumerate(sample))
    got = {r.doc_id: r.component_id for r in partenum.report(docs(spark, texts)).collect()}
    assert all(got[i] == (i % 60 if i < 5000 else 5000 if i < 10000 else i) for i in range(10005))


WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(texts, items, window=10):
    split = lambda t: WORD.findall((t or "").encode().lower())
    grams = {}
    for i, t in items:
        x = split(t)
        n = min(window, len(x))
        for j in range(len(x) - n + 1 if n else 0):
            grams.setdefault(tuple(x[j : j + n]), set()).add(str(i))
    out = {}
    for d, t in enumerate(texts):
        x, hit, who = split(t), set(), set()
        for n in {len(g) for g in grams}:
            for j in range(len(x) - n + 1):
                if tuple(x[j : j + n]) in grams:
                    hit |= set(range(j, j + n))
                    who |= grams[tuple(x[j : j + n])]
        out[d] = (len(x), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 24, 200])
def test_decontamination(spark, block_bytes):
    rng = random.Random(2)
    words = ["alpha", "beta", "Gamma", "délta", "e5", "zeta"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 7, 10, 14, 25])))) for i in range(12)] + [(50, None), (2, "alpha beta!")]
    texts = [*ODD, *(" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(40)), items[5][1] + ", " + (items[6][1] or ""), "x " * 30 + (items[7][1] or "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for i in (1, 2, 5, 6):  # without the one-word items too, which hit everywhere
        some = bench.where(F.length("text") > 5 * i)
        found = suffix_decontam.report(suffix_decontam.matches(docs(spark, texts), some, block_bytes=block_bytes)).collect()
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found}
        want = brute_hits(texts, [x for x in items if x[1] and len(x[1]) > 5 * i])
        assert got == want
        assert all((r.longest > 0) == r.contaminated for r in found)
    kept = suffix_decontam.remove(docs(spark, texts), some, block_bytes=block_bytes)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, x in want.items() if not x[4])
    none = suffix_decontam.matches(docs(spark, texts), bench.limit(0)).collect()
    assert len(none) == len(texts) and not any(r.hits for r in none)


def test_longest_match_and_place(spark):
    item = "a b c d e f g h i j k l m n"
    text = "zz " + item + " yy a b c d e f g h i j"
    r = suffix_decontam.matches(docs(spark, [text]), spark.createDataFrame([(3, item)], "item_id long, text string")).first()
    assert (r.longest, r.longest_at, r.longest_item, r.hits) == (14, 1, "3", [1, 15, 16, 26])


def test_language_and_toxicity_on_odd_rows(spark):
    texts = [*ODD, *["the cat and the dog of this"] * 30, *["le chat et le chien de la"] * 30]
    frame = docs(spark, texts).withColumn("lang", F.when(F.col("text").startswith("le"), "fr").when(F.col("text").startswith("the"), "en"))
    got = {r.doc_id: r for r in lang_id.report(frame).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and got[0].score == 0
    assert {got[i].lang_pred for i in range(len(ODD), len(ODD) + 30)} == {"en"}
    assert {got[i].lang_pred for i in range(len(ODD) + 30, len(texts))} == {"fr"}
    assert all(0 <= r.score <= 1 for r in got.values()) and got[5].held_out == (zlib.crc32(b"5") % 4 == 2)
    assert {r.lang_pred for r in lang_id.report(frame.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}

    texts = [*ODD, *["you are a stupid idiot and a clown", "what a nice day it is for a walk"] * 40]
    labels = spark.createDataFrame([(i, 1, (i - len(ODD) + 1) % 2) for i in range(len(ODD), len(texts))] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.report(docs(spark, texts), labels).collect()}
    assert all(got[i].predicted == (i - len(ODD) + 1) % 2 for i in range(len(ODD), len(texts)))
    assert len(got) == len(texts) and all(0 <= r.score <= 1 for r in got.values())
    assert {r.score for r in toxicity.report(docs(spark, texts), labels.limit(0)).collect()} == {0.0}


def test_word_scores_sum_over_all_segmentations():
    pieces = {b"a": 0.2, b"b": 0.1, b"ab": 0.3, b" ": 0.2, b" a": 0.2}
    hashes = np.array([lang_id.bytes_hash(p) for p in pieces], np.uint64)
    order = np.argsort(hashes)
    share = np.append(np.array(list(pieces.values()))[order], 0.0)[:, None]
    model = lang_id.Model(("x",), hashes[order], share)
    data, off = lang_id.text_bytes(pa.array(["ab aab"]))
    w = lang_id.words(data, off)
    place, number = lang_id.distinct_words(w)
    got = np.exp(lang_id.word_scores(model, data, w, place)[number, 0])
    p = pieces
    ab = p[b" "] * (p[b"a"] * p[b"b"] + p[b"ab"]) + p[b" a"] * p[b"b"]
    aab = p[b" "] * p[b"a"] * (p[b"a"] * p[b"b"] + p[b"ab"]) + p[b" a"] * (p[b"a"] * p[b"b"] + p[b"ab"])
    assert np.allclose(got, [ab, aab])


def test_raking_meets_targets(spark):
    cells = [("a", "x", "t", 900.0), ("a", "y", "t", 50.0), ("b", "x", "u", 30.0), ("b", "y", "t", 20.0), ("b", "y", "u", 10.0), ("a", "x", "u", 40.0)]
    targets = {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.6, "y": 0.4}}
    frame = spark.createDataFrame(cells, "source string, lang string, topic string, tokens double")
    got = {(r.source, r.lang, r.topic): r.weight for r in raking.rake(frame, targets, rounds=8, tolerance=1e-4).collect()}
    w = {c[:3]: c[3] / 1050 for c in cells}
    for _ in range(200):
        for k, goal in ((0, targets["source"]), (1, targets["lang"])):
            for v, share in goal.items():
                m = sum(x for c, x in w.items() if c[k] == v)
                w = {c: x * share / m if c[k] == v else x for c, x in w.items()}
    assert all(abs(got[c] - x) < 1e-3 for c, x in w.items())
    p = raking.calibrate(spark.createDataFrame([(*c[:3], c[3], w[c[:3]]) for c in cells], "source string, lang string, topic string, tokens double, weight double"), 0.3).collect()
    assert abs(sum(r.tokens * r.p for r in p) - 0.3 * 1050) < 1
    drawn = raking.sample(docs(spark, ODD))
    assert drawn.columns == docs(spark, ODD).columns and raking.report(docs(spark, ODD)).count() == len(ODD)
    assert raking.sample(docs(spark, ODD).limit(0)).count() == 0


def test_host_reputation(spark):
    urls = [(1, "https://A.Example.NET/en/1?x#y"), (2, "http://example.net/fr/"), (3, "x.org/fr/"), (4, None), (5, "http://q.org/fr/1"), (6, "http://bad.com/1"), (7, "http://good.com/1"), (8, "http://good.com"), (9, "ftp://example.com/de/")]
    urls += [(100 + i, f"http://bad.com/{i}") for i in range(40)] + [(200 + i, f"http://good.com/{i}") for i in range(40)]
    pages = spark.createDataFrame([(*u, "h", "x") for u in urls], "page_id long, url string, html string, host string")
    outcomes = spark.createDataFrame([(100 + i, 0) for i in range(40)] + [(200 + i, 1) for i in range(40)] + [(6, None)], "page_id long, good int")
    got = {r.page_id: r for r in host_reputation.judge(pages, outcomes).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert (got[2].rule, got[2].verdict) == ("net/", "block") and (got[3].host, got[3].path) == ("", "") and got[4].host == ""
    assert got[5].rule == "org/fr/" and got[6].verdict == "block" and got[7].verdict == "allow" and (got[8].path, got[8].verdict) == ("", "allow")
    assert got[9].rule == "example.com/de/" and len(got) == len(urls)
    assert host_reputation.judge(pages, outcomes.limit(0)).count() == len(urls)
    assert host_reputation.keep(pages, outcomes).columns == pages.columns


def test_warc_fixity(spark, tmp_path):
    import gzip

    record = lambda uri, body: f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: {uri}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
    records = [record(f"u{i}", bytes([65 + i % 26]) * (50 * i)) for i in range(300)]
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a/x.warc").write_bytes(b"".join(records))
    spoilt = [r if i not in (7, 250) else r.replace(bytes([65 + i % 26]) * 10, b"?" * 10, 1) for i, r in enumerate(records)]
    (tmp_path / "b/x.warc").write_bytes(b"".join(spoilt))
    read = lambda d: warc_fixity.read_warc(spark, str(tmp_path / d)).withColumn("file", F.element_at(F.split("file", "/"), -1))
    a, b = read("a"), read("b")
    offsets = [sum(map(len, records[:i])) for i in (7, 250)]
    got = sorted((r.offset, r.status) for r in warc_fixity.audit(a, b, span=1 << 12, fanout=4).collect())
    assert got == [(o, "changed") for o in offsets]
    assert warc_fixity.audit(a, a, span=1 << 12, fanout=4).count() == 0
    lost = warc_fixity.audit(a, b.where(F.col("offset") != offsets[0]), span=1 << 12).collect()
    assert sorted((r.offset, r.status) for r in lost) == [(offsets[0], "missing"), (offsets[1], "changed")]
    (tmp_path / "c").mkdir()
    (tmp_path / "c/x.warc").write_bytes(b"".join(gzip.compress(r) for r in records[:5]))
    assert [r.digest for r in read("c").orderBy("offset").collect()] == [r.digest for r in a.orderBy("offset").limit(5).collect()]
    assert warc_fixity.audit(a.limit(0), b.limit(0)).count() == 0
    pages = spark.createDataFrame([(1, "u", None), (None, None, "h"), (2, None, ""), (2, None, "")], "page_id long, url string, html string")
    assert warc_fixity.audit(warc_fixity.page_records(pages), warc_fixity.page_records(pages)).count() == 0


def test_damaged_warc_files():
    import gzip

    record = lambda uri, body: f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: {uri}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
    records = [record(f"u{i}", bytes([65 + i]) * 30) for i in range(5)]
    whole = b"".join(records)
    kinds = lambda data: [(h.get("warc-type"), h.get("warc-target-uri")) for _, _, h, _ in warc_fixity.parse(data)]
    good = [("response", f"u{i}") for i in range(5)]
    assert kinds(whole) == good
    spoilt = records[1].replace(b"Content-Length: 30", b"Content-Length: 3x")
    for bad in (spoilt, records[1].replace(b"WARC/1.0", b"XARC/1.0"), records[1].replace(b"Content-Length: 30", b"Content-Length: -9"), records[1].replace(b": 30", b": 90")):
        assert kinds(records[0] + bad + b"".join(records[2:])) == [good[0], ("unreadable", None), *good[2:]]
    assert kinds(whole[:-20])[-1] == ("unreadable", None) and kinds(b"noise") == [("unreadable", None)] and kinds(b"") == []
    packed = [gzip.compress(r) for r in records]
    assert kinds(b"".join(packed)) == good
    assert kinds(packed[0] + b"\x1f\x8b\x08" + bytes(20) + b"".join(packed[1:]))[0] == good[0]
    assert kinds(b"".join(packed)[:-5])[:4] == good[:4]
    assert sum(size for _, size, _, _ in warc_fixity.parse(b"".join(packed)[:-5])) == len(b"".join(packed)) - 5


def test_toxicity_on_empty_tables_and_long_words(spark):
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.report(docs(spark, ["a"]).limit(0), labels).count() == 0
    assert {r.score for r in toxicity.report(docs(spark, ["a", None, None]), labels).collect()} == {0.0}
    # every n-gram of a long word counts once
    data, off = toxicity.text_bytes(pa.array(["x" * 10, "".join(chr(0x4E00 + i) for i in range(90)), "a"]))
    w = toxicity.words(data, off, toxicity.ALNUM)
    total = np.zeros(3, int)
    for own, buckets in toxicity.grams(data, w, np.arange(3)):
        total += np.bincount(own, minlength=3) * buckets.shape[1]
    size = [10 + 2, 270 + 2, 1 + 2]
    assert total.tolist() == [1 + sum(max(0, n - g + 1) for g in toxicity.GRAMS) for n in size]


def test_token_ids_of_repeated_documents(spark):
    texts, ids = ["b b", "a a", None, "a a", "c"], [7, 7, 7, None, None]
    rows = sorted(dac.report(docs(spark, texts, ids)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, None, 7, 7, 7]
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows[:-1])]).tolist()


def test_sketches_of_unlike_sizes_bound_the_difference():
    rng = np.random.default_rng(4)
    scheme = partenum.Scheme(4, 85, 100)
    for n in (1, 60, 1020, 2040, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for d in (0, n // 12, n // 3, n):
            b = np.unique(np.concatenate([a[d:], rng.integers(0, 1 << 63, d + n // 50).astype(np.uint64)]))
            x, y = scheme.packed(a), scheme.packed(b)
            true = len(np.setxor1d(a, b))
            assert partenum.least_differing([x, y, x, None], [y, x, x, y]).tolist()[2:] == [0, 0]
            least, most = partenum.least_differing([x], [y])[0], scheme.differ(len(a) + len(b))
            assert least <= true
            assert least > most or true < 1.5 * most + 8  # sets far apart are told apart at every size
            rows = [(0, 1, 1, len(a), x), (1, 2, 2, len(b), y), (1, 3, 1, len(a), x)]
            assert (partenum.hopeful(scheme, rows) == [1, 2]) >= scheme.similar(a, b)
