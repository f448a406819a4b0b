"""Each operator against brute force on a small fixture with nulls, empty and long texts, ties, repeated rows and extra columns."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwright.llm import exact_dedup, fingerprint, minhash, packing, pii, sentencepiece_codec, suffix_dedup, toxicity, url_filter, warc

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS = [f"{a}{b}" for a in ("ba", "ko", "lu", "mi", "te", "ra", "so") for b in ("n", "st", "rel", "mo", "da", "x")]


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] for i in rng.integers(0, len(WORDS), n))


BASE = prose(1, 300)
TEXTS = [
    BASE, BASE, BASE.replace("ban", "zzz", 1), None, "", "x", prose(2, 12), prose(3, 4000), "é à " + prose(4, 30), "A  b\tc", "a b C", "idiot " + prose(5, 20), "ａｂ ﬁ", prose(6, 60) + " " + BASE[300:900] + " " + prose(7, 60),
    "mail a.b@c.example.com, +1 (743) 555-3824 and 10.1.2.3 card 4785380592391139", "y" * 2500, prose(8, 3),
]
ROWS = [(i * 3, t, "en", f"s{i % 2}", i, b"extra", 1.5) for i, t in enumerate(TEXTS)] + [(0, BASE, "en", "s0", 0, b"again", 2.5)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h binary, name double"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).coalesce(2)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def text(t):
    return t or ""


def test_packing(docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    got = packing.pack(docs, path, 64).collect()
    want = Counter()
    for d, t, *_ in ROWS:
        ids = np.array([*tok.encode(text(t), add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(ids), 64)):
            want[d, k, at, len(ids[at : at + 64]), zlib.crc32(ids[at : at + 64].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    rows = {}
    for r in got:
        rows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in rows.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 64
    assert len(rows) <= 1.05 * sum(r.length for r in got) / 64 + 2
    assert packing.pack(none, path, 64).count() == 0


def test_word_tokenizer_equals_library():
    tok = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    for x in ["", "a'b 's don't", "É'll x", "ΑΣ foo", "<|endoftext|> a", "a²b³ ½", "éa ́b", "x\x1cy", "foo_bar __ 1b22", "　全角　", "é.é é,é! ", "İI ǅ ß", "é)( «é» é’s 1é2 é😀!"]:
        assert tok.ids(x) == tok.whole(x), x


def test_plan_is_complete():
    rng = np.random.default_rng(2)
    hist = {int(n): int(c) for n, c in zip(rng.choice(np.arange(1, 4097), 300, replace=False), rng.integers(1, 400, 300), strict=True)}
    rows = packing.plan(hist, 4096)
    seen, used = {}, {}
    for length, a, b, seq, off in rows:
        seen.setdefault(length, []).append((a, b))
        for i in range(b - a):
            used.setdefault(seq + i, []).append((off, length))
    for n, spans in seen.items():
        at = 0
        for a, b in sorted(spans):
            assert a == at
            at = b
        assert at == hist[n]
    assert all(sum(x for _, x in v) <= 4096 for v in used.values())
    assert len(used) < 1.08 * sum(n * c for n, c in hist.items()) / 4096 + 1


def test_toxicity(spark, none):
    rows = [(i, f"{prose(i, 40)} {('moron scum' if i % 4 == 0 else '')}", "en") for i in range(400)] + [(900, None, "en"), (901, "", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 1) for i in range(400)] + [(5, None, 0), (5000, 1, 0), (4, 0, 0)], "doc_id long, toxic int, quality int")
    got = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    assert len(got) == 402 and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) for d, r in got.items())
    assert all(got[d].predicted == int(d % 4 == 0) for d in range(400))
    assert got[900].score == got[901].score < 0.3 and got[4].evidence
    assert toxicity.score(none.select("doc_id", "text"), labels).count() == 0
    assert {r.score for r in toxicity.score(docs, labels.where("false")).collect()} == {0.0}


def test_nearest_is_exact():
    rng = np.random.default_rng(3)
    rows = []
    for i in range(500):
        ids = np.sort(rng.choice(40, rng.integers(1, 6), replace=False))
        w = rng.random(len(ids))
        rows.append((i, int(i % 2), int(i % 3), ids, w / np.linalg.norm(w)))
    index = toxicity.BlockMax(rows, 40)
    dense = np.zeros((500, 40))
    for i, d in enumerate(index.docs):
        dense[i, rows[d][3]] = rows[d][4]
    for q in rows[:60]:
        at, sim = index.nearest(q[3], q[4], 8)
        full = dense[:, q[3]] @ q[4]
        assert np.allclose(np.sort(full)[::-1][:8], sim) and np.allclose(full[at], sim)


def test_toxicity_equals_brute_force(spark):
    rows = [(i, f"{prose(i, 30)} {('moron scum' if i % 4 == 0 else '')}") for i in range(160)] + [(900, ""), (901, prose(7, 3000))]
    labels = [(i, int(i % 4 == 0)) for i in range(120)]
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    words = {d: Counter(toxicity.WORD.findall(t.lower())) for d, t in rows}
    train = [(d, y) for d, y in labels if zlib.crc32(str(d).encode()) % 4 != 2]
    place = {w: i for i, w in enumerate(sorted({w for d, _ in train for w in words[d]}))}
    y = np.array([v for _, v in train], float)
    has = np.array([[w in words[d] for w in place] for d, _ in train], float)
    weight = toxicity.relevance(has[y == 0].sum(0), has[y == 1].sum(0), int((y == 0).sum()), int(y.sum())) * (1 + np.log((len(rows) + 1) / np.array([sum(w in c for c in words.values()) for w in place])))

    def vector(d):
        v = np.zeros(len(place))
        for w, n in words[d].items():
            if w in place:
                v[place[w]] = (1 + np.log(n)) * weight[place[w]]
        return v / max(np.sqrt(v @ v), 1e-12)

    dense = np.array([vector(d) for d, _ in train])

    def vote(d, but=None):
        sim = dense @ vector(d)
        near = [i for i in np.argsort(-sim) if i != but and sim[i] > 0][:16]
        w = 1 / (1.05 - np.minimum(sim[near], 1))
        return (w @ y[near] + y.mean()) / (w.sum() + 1)

    x, v = toxicity.isotonic(np.array([vote(d, i) for i, (d, _) in enumerate(train)]), y, np.ones(len(y)))
    assert got[900].score == pytest.approx(y.mean()) and not got[900].evidence
    for d, _ in rows:
        if d != 900:
            assert got[d].score == pytest.approx(np.interp(vote(d), x, v), abs=1e-6) and len(got[d].evidence) == 3


def test_sentencepiece(docs, none):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sentencepiece_codec.encoded(docs, path, frequent=30).persist()
    for r in got.collect():
        want = sp.encode(text(TEXTS[r.doc_id // 3]))
        assert list(r.ids) == want and r.n_tokens == len(want) and r.round_trip
    back = {r.doc_id: r.text for r in sentencepiece_codec.decoded(got, path).collect()}
    assert all(back[3 * i] == text(t) for i, t in enumerate(TEXTS))
    assert sentencepiece_codec.encoded(none, path).count() == 0
    table = sentencepiece_codec.Pieces(path)
    for x in ["  a\n\tb  c é 漢", "a" * 500, "😀 1234 <s> <0x41>", "Σ\x00z"]:
        find = re.compile(table.pattern, re.DOTALL).findall
        assert [k for w in sentencepiece_codec.segments(x, find) for k in table.fold(w)] == sp.encode(x)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(docs, none, weak):
    from pyspark.sql import functions as F

    more = {"block": 64, "hashed": lambda c: F.length(c).cast("long")} if weak else {"block": 512}
    got = exact_dedup.exact_dedup(docs, **more).collect()
    assert len(got) == len(ROWS)
    groups = {}
    for d, t, *_ in ROWS:
        groups.setdefault(text(t), []).append(d)
    for r in got:
        mine = groups[text(TEXTS[r.doc_id // 3])]
        assert (r.keep_id, r.group_size) == (max(mine), len(mine))
        assert r.text_sha256 == hashlib.sha256(text(TEXTS[r.doc_id // 3]).encode()).hexdigest()
    assert sum(r.kept for r in got) == len(groups)
    if not weak:
        assert exact_dedup.exact_dedup(none).count() == 0
        kept = exact_dedup.keep_one(docs)
        assert kept.columns == docs.columns and sorted(text(r.text) for r in kept.collect()) == sorted(groups)


def test_fingerprints(docs, none):
    got = {}
    for r in fingerprint.fingerprints(docs, part_chars=3000).collect():
        got.setdefault(r.doc_id, []).append(r)
    order = sorted(((d, hashlib.sha256(text(t).encode()).hexdigest(), text(t)) for d, t, *_ in ROWS))
    for k, (d, _, t) in enumerate(order):
        after = order[(k + 1) % len(order)][2]
        half = len(t) // 2
        new = t[: len(t) - half] + after[:half]
        form = fingerprint.canonical
        want = (len(t), hashlib.sha256(new.encode()).hexdigest(), fingerprint.digest(form(t)), fingerprint.digest(form(new)), float(form(t) == form(new)), float(form(t) == form(after)))
        assert want in [tuple(r)[1:] for r in got[d]], d
    assert sum(map(len, got.values())) == len(ROWS)
    assert fingerprint.canonical("A  b\tc") == fingerprint.canonical("a b C") and fingerprint.canonical("ａｂ ﬁ") == "ab fi"
    assert fingerprint.fingerprints(none).count() == 0


def test_url_filter(spark):
    urls = ["http://Example.com/en/a?q", "https://www.example.com/en/x", "ftp://a.net/es/", "http://net/fr", "http://b.c.net/fr/z#k", "nothing", None, "", "http://x.org", "http://com/", "http://example.com", "http://.com/é"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    rules = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"), ("block", "example.com/en/")]
    quick = url_filter.url_filter(pages, rules)
    joined = url_filter.url_filter(pages, spark.createDataFrame(rules, "action string, rule string"), max_index_bytes=0)
    assert sorted(map(str, quick.collect())) == sorted(map(str, joined.collect()))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in quick.collect()}
    assert got[0] == ("example.com", "/en/a", "example.com/en/", "block")
    assert got[1][2:] == ("www.example.com/en/", "allow") and got[2][2:] == ("net/es/", "block") and got[3][2:] == (None, "allow")
    assert got[5] == got[6] == ("", "", None, "allow") and got[9][2] == "com/" and got[10][2] is None
    assert url_filter.url_filter(pages.where("false"), rules).count() == 0
    one = url_filter.build([("block", "a.b/x"), ("allow", "c.d/")], digest=lambda _: 7)  # all keys collide
    import tempfile

    with tempfile.NamedTemporaryFile() as f:
        f.write(one)
        f.flush()
        assert url_filter.Index(f.name, digest=lambda _: 7).probe(["q.a.b", "c.d", "e"], ["/xy", "/", "/"]) == (["a.b/x", "c.d/", None], ["block", "allow", "allow"])


def base_spans(t):
    def luhn(s):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0

    digits = lambda h: re.sub("[^0-9]", "", h)
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda h: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda h: all(int(x) <= 255 for x in h.split("."))), ("card", r"[0-9]([\x20-]?[0-9])+", lambda h: 16 <= len(digits(h)) <= 19 and luhn(digits(h))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda h: 8 <= len(digits(h)) <= 15)]
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p, ok in kinds for m in re.finditer(p, t) if ok(m[0]))


def test_pii(spark, docs, none):
    import random

    random.seed(3)
    odd = ["".join(random.choice(a) for _ in range(50)) for a in ("a.b@-1+2 9()_é😀%\n:", "ab@.-_", "0123456789.. -+") for _ in range(300)]
    odd += ["1 " * 3000, "x@" + "a." * 3000, "9" * 5000, "+1" * 500, "4539 1488 0343 6467", "001.2.3.0255"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    for r in pii.report(rows).collect():
        want = base_spans(odd[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), odd[r.doc_id][:60]
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))
    kept = pii.masked(docs)
    assert kept.columns == docs.columns and kept.count() == len(ROWS)
    assert {r.text for r in kept.where("doc_id = 42").collect()} == {"mail <EMAIL>, <PHONE> and <IP> card <CARD>"}
    assert {r.text for r in kept.where("doc_id = 0").collect()} == {BASE}
    assert pii.report(none).count() == 0


def test_reliabilities_prefer_agreement():
    patterns = [((0, 2, 1, 1, 0, 0), 50), ((0, 2, 1, 0, 0, 0), 40), ((0, 0, 0, 0, 0, 0), 60), ((0, 0, 1, 1, 0, 0), 3)]
    post = pii.reliabilities(patterns)
    assert post[0, 2, 1, 1, 0, 0] > post[0, 2, 1, 0, 0, 0] > post[0, 0, 0, 0, 0, 0]


def test_pii_adds_what_strict_patterns_lose(spark):
    plain = [(f"{'call' if i % 4 == 0 else 'und'} +1 ({200 + i}) 555-{4000 + i} or 10.1.{i}.7", None) for i in range(60)] + [(f"no {i} 4111111111111111", None) for i in range(30)]
    lost = [("+1 (826) 555-4081 190.137.223.204 du", "phone:0:17"), ("a +1### (826)*** 555-4081%%% b", "phone:2:25"), ("x 4539148803436467 4111111111111111 y", "card:2:18,card:19:35"),
            ('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" z', "secret:9:49"), ("mot de passe: 5f2b8c1d9e3a7f604b1c2d3e4f5a6b7c8d9e0f1a", "secret:14:54")]
    clean = ["order 4539148803436468 of 2024", "see 12 345 678 9012 there", "the supercalifragilisticexpialidocious", "v1.2.3.999 and 1-2-3", "", None]
    rows = [t for t, _ in plain + lost] + clean
    # names that clash with what the operator needs, an id without a value, and repeated rows
    docs = spark.createDataFrame([(None if i == 3 else i // 2, t, 7, "s", [1], "m") for i, t in enumerate(rows + rows[:2])], "doc_id long, text string, n_chars int, spans string, _s array<int>, _m string")
    got = {r.text: r.spans for r in docs.select("text").distinct().withColumn("doc_id", F.xxhash64("text")).transform(lambda d: pii.spans(d).join(d, "doc_id", "left")).collect() if r.text}
    words = lambda s: ",".join(f"{pii.KINDS[x.kind]}:{x.start}:{x.end}" for x in s)
    for t, want in lost:
        found = words(got[t])
        assert set(want.split(",")) <= set(found.split(",")), (t, found)
        assert set(filter(None, base_spans(t).split(","))) <= set(found.split(","))
    for t in clean[:4]:
        assert words(got[t]) == base_spans(t), t
    kept = pii.masked(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) + 2
    out = Counter(r.text for r in kept.collect())
    assert out["call <PHONE> or <IP>"] + out["und <PHONE> or <IP>"] == 62 and out['token = "<SECRET>" z'] == 1 and out[None] == 1 and out["<PHONE> <IP> du"] == 1
    assert {(r.n_chars == 7) for r in kept.where("text like 'order%'").collect()} == {True}


def test_warc(spark, tmp_path):
    html = ["<p>a</p>", "é" * 9000, None, "", "<p>a</p>", "b\r\n\r\nc"]
    pages = spark.createDataFrame([(i, None if i == 3 else f"http://x/{i}\n", h, 1) for i, h in enumerate(html)], "page_id long, url string, html string, n int")
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    for i, h in enumerate(html):
        b = text(h).encode()
        first = next(j for j, x in enumerate(html) if text(x) == text(h))
        r = got[i]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if i == first else "revisit", None if i == first else first)
    path = f"file://{tmp_path}/w"
    read = warc.archive(pages, path)
    assert {bytes(r.payload) for r in read.where("record_type = 'response'").collect()} == {text(h).encode() for h in html}
    assert read.where("target_uri = 'http://x/1\n'").count() == 1 and read.where("record_id = 'urn:page:0'").count() == 1
    import gzip

    plain = b"".join(gzip.decompress(f.read_bytes()) for f in sorted((tmp_path / "w").glob("*.warc.gz")))
    (tmp_path / "p").mkdir()
    (tmp_path / "p/all.warc").write_bytes(plain)
    (tmp_path / "p/one.warc.gz").write_bytes(gzip.compress(plain))
    again = spark.read.format("warc").option("path", str(tmp_path / "p")).load()
    assert again.count() == 2 * len(html) and again.where("record_type = 'revisit'").count() == 4
    assert spark.read.format("warc").option("path", path).option("payload", "false").load().where("payload is not null").count() == 0
    assert warc.round_trip(pages.where("false")).count() == 0


def test_suffix_dedup(docs, none):
    got = {}
    for r in suffix_dedup.deduplicated(docs, 200).collect():
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    data = [text(t).encode() for _, t, *_ in ROWS]
    seen = Counter(b[p : p + 200] for b in data for p in range(len(b) - 199))
    for (d, *_), b in zip(ROWS, data, strict=True):
        gone = bytearray(len(b))
        for p in range(len(b) - 199):
            if seen[b[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        runs = sum(1 for k, x in enumerate(gone) if x and (not k or not gone[k - 1]))
        assert (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, y in zip(b, gone, strict=True) if not y)).hexdigest()) in got[d], d
    assert sum(map(len, got.values())) == len(ROWS)
    assert suffix_dedup.deduplicated(none, 200).count() == 0


def test_near_duplicates(docs, none):
    got = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
    assert got[0].near_id == got[3].near_id == got[6].near_id == 0 and got[0].near_size == 4
    assert got[9].class_id == got[12].class_id == 9  # null and empty
    assert got[27].class_id == got[30].class_id == 27  # the same words
    assert got[39].near_id == 39 and got[18].near_id == 18
    assert minhash.near_duplicates(none).count() == 0


def test_bagminhash_estimates():
    rng = np.random.default_rng(1)
    u = rng.integers(0, 2**63, 400).astype(np.uint64)
    a = np.sort(np.concatenate([u[:300], np.repeat(u[:20], 5), np.repeat(u[5:6], 37)]))
    b = np.sort(np.concatenate([u[30:330], np.repeat(u[10:30], 3), np.repeat(u[5:6], 90)]))
    s = minhash.signatures([a, b], 4096)
    assert abs((s[0] == s[1]).mean() - minhash.overlap(a, b)) < 0.04


def near_groups(rows):
    """Smallest id of each row's group by all pairs of shingle multisets of at least 0.8."""
    bags, root = {}, {}
    for i, t in rows:
        w = re.findall(r"\w+", text(t).lower())
        bags[i], root[i] = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter(), i

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(bags)
    for a in ids:
        for b in ids:
            if a < b:
                both = sum((bags[a] & bags[b]).values())
                every = sum(bags[a].values()) + sum(bags[b].values()) - both
                if (both >= 0.8 * every) if every else True:
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: find(i) for i in ids}


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline
    from meshwright.llm.common import stored

    sf = "/root/testdata/sf0.001"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "minhash_near_dedup", "pii", "packing"]
    tables = [spark.read.parquet(f"{sf}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(stored(stage(spark, tables[-1], sf)))
    start, clean, once, apart, safe = ({r.doc_id: r.text for r in t.collect()} for t in tables[:5])
    assert all(t.columns == tables[0].columns for t in tables[:5])
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert sum(labels.get(d) == 0 for d in start.keys() - clean.keys()) <= 0.03 * len(start)
    best = {}
    for d, t in clean.items():
        best[text(t)] = max(d, best.get(text(t), d))
    assert once == {d: clean[d] for d in best.values()}
    groups = near_groups(once.items())
    assert apart == {d: t for d, t in once.items() if groups[d] == d}
    secret = re.compile(r"(?=[\w-]*[0-9])(?=[\w-]*[A-Za-z])[A-Za-z0-9_-]{20,}")
    assert safe.keys() == apart.keys() and all(safe[d] == t for d, t in apart.items() if not base_spans(text(t)) and not secret.search(text(t)))
    assert not any(base_spans(text(t)) for t in safe.values())
    assert {r.doc_id for r in tables[5].select("doc_id").distinct().collect()} == safe.keys()


def test_toxicity_of_few_labels(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = {r.doc_id for r in corpus_pipeline.toxicity_stage(spark, docs, sf).select("doc_id").collect()}
    insults = {"trash", "scum", "worthless", "idiot", "clown", "loser", "disgusting", "moron", "pathetic", "stupid"}
    rows = {r.doc_id: len(insults & set(re.findall(r"[^\W\d_]+", text(r.text).lower()))) for r in docs.collect()}
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    plain = {d for d, y in toxic.items() if y and rows.get(d, 0) >= 2}
    assert len(plain) >= 7 and not plain & left
    assert not {d for d, y in toxic.items() if y == 0} & (rows.keys() - left)


def test_toxicity_without_marks_keeps_the_corpus(spark):
    rows = [(i, prose(i, 40) + (" moron scum" if i in (1, 4) else "")) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i in (1, 4))) for i in (0, 1, 2, 3, 4, 5)], "doc_id long, toxic int")  # of few rows, many are toxic
    got = toxicity.score(docs, labels).collect()
    assert not any(r.predicted for r in got) and all(r.evidence for r in got)


def test_relevance_at_any_number_of_rows():
    for k in (1, 4, 40):  # 10 marks among 100 words that say nothing
        a0, a1 = np.array([0] * 10 + [20 * k] * 50 + [40 * k] * 50, float), np.array([4 * k] * 10 + [3 * k] * 50 + [8 * k] * 50, float)
        r = toxicity.relevance(a0, a1, 55 * k, 9 * k)
        assert (r >= 1).all() and r[:10].min() > 4 * r[10:].max()
    assert toxicity.relevance(np.array([1.0] * 400), np.array([0.0] * 400), 20, 9).max() < 1.1


def test_warc_headers_of_any_length(tmp_path):
    rng = np.random.default_rng(4)
    chars = np.array(list("abcdefghijklmnopqrstuvwxyz0123456789-._~ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    urls = [u for n in range(2000, 5001, 20) for u in ("http://x/" + "a" * n, "http://x/" + "".join(rng.choice(chars, n)))] + ["http://x/" + "a" * 70000]
    row = {"record_id": "urn:page:1", "date": "d", "refers_to": "urn:page:0", "payload": b"<p>page</p>" * 9, "payload_bytes": 99}
    raw = [warc.record(row | {"record_type": kind, "target_uri": u}) for u in urls for kind in ("revisit", "response")]
    long = warc.record(row | {"record_type": "response", "target_uri": "http://x/"}).replace(b"Content-Length: 99\r\n", b"X-Long: " + b"y" * 70000 + b"\r\nContent-Length: 99\r\n")
    raw.append(re.sub(rb"Content-Length: (\d+)\r\n\r\nHTTP", lambda m: b"Content-Length: %d\r\n\r\nHTTP" % (int(m[1]) + 70010), long, count=1))
    (tmp_path / "m").mkdir()
    (tmp_path / "p").mkdir()
    (tmp_path / "m/a.warc.gz").write_bytes(b"".join(map(warc.member, raw)))
    (tmp_path / "p/a.warc").write_bytes(b"".join(raw))
    for folder in "mp":
        for payload in ("true", "false"):
            reader = warc.WarcReader({"path": str(tmp_path / folder), "payload": payload})
            got = [r for p in reader.partitions() for r in reader.read(p)]
            assert [r[2] for r in got] == [u for u in urls for _ in range(2)] + ["http://x/"]
            assert {r[6] for r in got} == {99}, (folder, payload)


def removed(rows, length):
    """(doc_id, bytes removed) of each row, by brute force."""
    data = [text(t).encode() for _, t in rows]
    seen = Counter(b[p : p + length] for b in data for p in range(len(b) - length + 1))
    return sorted(((d or -1), len({q for p in range(len(b) - length + 1) if seen[b[p : p + length]] > 1 for q in range(p, p + length)})) for (d, _), b in zip(rows, data, strict=True))


def test_suffix_dedup_of_texts_that_share_an_id(spark):
    parts = [prose(40 + i, 60) for i in range(12)]
    for k in range(6):  # either of the texts that share an id may come first
        part = parts[2 * k]
        rows = [(1, parts[2 * k + 1] + " one"), (1, prose(70 + k, 30) + part[:-9] + " two"), (2, prose(80 + k, 30) + part[9:] + " three")]
        rows = rows[k % 2 :] + rows[: k % 2]
        got = suffix_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), 200).collect()
        assert sorted((r.doc_id, r.n_removed) for r in got) == removed(rows, 200) and sum(r.n_removed for r in got) > 400


def test_rows_without_an_id(spark, tmp_path):
    import corpus_pipeline

    same, near = prose(91, 80), prose(92, 400)
    rows = [(1, same), (None, same), (None, same), (2, near), (None, near.replace("ban", "zzz", 1)), (None, prose(93, 60)), (None, "mail a.b@c.example.com"), (3, "x"), (None, None)]
    rows += [(i, f"{prose(i, 40)} {('moron scum' if i % 4 == 0 else '')}") for i in range(100, 200)] + [(None, prose(94, 40) + " moron scum")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(100, 200)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    key = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    assert key(corpus_pipeline.toxicity_stage(spark, docs, str(tmp_path))) == Counter(r for r in rows if "moron" not in text(r[1]))
    few = spark.createDataFrame(rows[:9], "doc_id long, text string").coalesce(2)
    assert key(corpus_pipeline.exact_dedup_stage(spark, few, "")) == Counter(rows[:1] + rows[3:9])
    assert key(corpus_pipeline.near_dedup_stage(spark, few, "")) == Counter([rows[1]] + rows[4:9]) + Counter([rows[1]])
    assert key(corpus_pipeline.pii_stage(spark, few, "")) == Counter(rows[:6] + [(None, "mail <EMAIL>")] + rows[7:9])
    got = suffix_dedup.deduplicated(few, 200).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in got) == removed(rows[:9], 200)


@pytest.mark.parametrize("margin", [5.0, None])
def test_near_duplicates_equal_all_pairs(spark, margin):
    rng = np.random.default_rng(8)
    rows = []
    for g, (n, words) in enumerate([(60, 120), (40, 60), (20, 700)]):  # families of copies that differ more and less from one text, which is not among them
        base = prose(100 + g, words).split()
        for i in range(n):
            copy = list(base)
            for at in rng.integers(0, words, rng.integers(0, max(2, words // 30))):
                copy[at] = f"w{rng.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + i, prose(i, 30 + i)) for i in range(30)] + [(len(rows) + 40, "a b c d e f " * 50), (len(rows) + 41, "a b c d e f " * 46)]
    minhash_blocks, minhash.BLOCK_WORDS = minhash.BLOCK_WORDS, 3000
    try:
        got = {r.doc_id: r for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), margin=margin).collect()}
    finally:
        minhash.BLOCK_WORDS = minhash_blocks
    want = near_groups(rows)
    assert {d: r.near_id for d, r in got.items()} == want
    sizes = Counter(want.values())
    assert all(r.near_size == sizes[r.near_id] and r.kept == (d == r.near_id) for d, r in got.items())


def test_fingerprints_of_rows_without_id_and_of_many_runs(spark):
    rows = [(None, "b  C"), (None, "é"), (5, "B c"), (7, None), (7, ""), (9, prose(3, 50))] + [(100 + i, prose(i, 20)) for i in range(150)]
    got = fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), part_chars=200).collect()
    assert len(got) == len(rows) and sum(r.doc_id is None for r in got) == 2
    of = {(r.doc_id, r.n_chars): r for r in got}
    assert of[None, 4].fingerprint == of[5, 3].fingerprint == fingerprint.digest("b c")
    assert of[5, 3].edited_sha256 == hashlib.sha256(b"B ").hexdigest()  # the next text is empty
    for i in range(149):
        a, b = prose(i, 20), prose(i + 1, 20)
        half = len(a) // 2
        assert of[100 + i, len(a)].edited_sha256 == hashlib.sha256((a[: len(a) - half] + b[:half]).encode()).hexdigest()


def test_pipeline_of_odd_tables(spark, tmp_path):
    import corpus_pipeline
    from meshwright.llm.common import stored

    near = prose(92, 400)
    rows = [(1, prose(91, 80)), (2, prose(91, 80)), (2, prose(91, 80)), (3, near), (4, near.replace("ban", "zzz", 1)), (5, None), (6, ""), (7, "mail a.b@c.example.com " + prose(95, 9)), (None, prose(96, 20)), (8, prose(97, 9000))]
    # columns whose names the stages use themselves
    names = ("score", "spans", "_s", "_text", "keep_id", "near_id", "c", "kind", "_given2", "weight")
    full = spark.createDataFrame([(d, t, *(f"{n}{d}" for n in names)) for d, t in rows], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    full.write.parquet(f"{tmp_path}/full/documents.parquet")
    full.where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    for folder in ("full", "none"):
        spark.createDataFrame([(1, 0)] if folder == "full" else [], "doc_id long, toxic int").write.parquet(f"{tmp_path}/{folder}/labels.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stored(stage(spark, docs, f"{tmp_path}/{folder}"))
            assert out.columns == docs.columns
            docs = out
        left = {r.doc_id: r for r in docs.collect()}
        assert set(left) == ({2, 3, 6, 7, 8, None} if folder == "full" else set())
        if folder == "full":
            assert left[7].text.startswith("mail <EMAIL>") and left[8].text == prose(97, 9000) and all(left[d][n] == f"{n}{d}" for d in (2, 3, 8) for n in names)
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "")
        assert pieces.select("doc_id").distinct().count() == len(left)


@pytest.mark.parametrize("small", [0, 40, 100_000])
def test_components_of_any_size(spark, small):
    from meshwright.llm.components import components

    order = np.random.default_rng(3).permutation(90).tolist()
    edges = [(order[i], order[i + 1]) for i in range(60)] + [(order[70], order[k]) for k in range(71, 80)] + [(500, 500)]
    weighted = [(int(a), int(b), 1, 2) for a, b in edges]
    got = {r.node: r.component for r in components(spark.createDataFrame(weighted, "a long, b long, wa long, wb long"), small).collect()}
    want = {n: min(order[:61]) for n in order[:61]} | {n: min(order[70:80]) for n in order[70:80]}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long"), small).count() == 0


def test_near_duplicates_leave_few_jobs_and_tables(spark):
    """The driver remembers jobs, and tables that are not released lie about: a chain of texts, each near the next, takes neither many of the one nor of the other."""
    from pathlib import Path

    words = [f"w{i}" for i in range(400)]
    docs = spark.createDataFrame([(i, " ".join(words[i : i + 200])) for i in range(120)], "doc_id long, text string").coalesce(1)
    folder = Path(minhash.stored(docs)._stored_at.removeprefix("file://")).parent
    before, sc = set(folder.iterdir()), spark.sparkContext
    sc.setJobGroup("chain", "")
    out = minhash.near_duplicates(docs)
    got = {(r.near_id, r.near_size) for r in out.collect()}
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert got == {(0, 120)}
    assert len(set(folder.iterdir()) - before) <= 16
    assert len(sc.statusTracker().getJobIdsForGroup("chain")) <= 120


def test_pipeline_hands_over_small_batches(spark):
    import corpus_pipeline

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for set_to, want in (("10000", 1000), ("0", 1000), ("7", 7)):
        spark.conf.set(name, set_to)
        corpus_pipeline.batched(spark)
        assert int(spark.conf.get(name)) == want
    spark.conf.unset(name)


def test_sentencepiece_folds_many_words_at_once(monkeypatch):
    """Words outside the dictionary are folded together, with the results of folding each; only very long ones and those with gaps are folded one by one."""
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    table, rng, alone = sentencepiece_codec.Pieces(path), np.random.default_rng(4), []
    words = {"".join(rng.choice(list("aeionrst.,é"), rng.integers(1, 40))) for _ in range(3000)} | {"y" * 63, "y" * 64, "ab" * 900, "▁▁▁", "漢", "😀"}
    words |= {"▁" + w for w in words}
    want = {w: np.array(table.fold(w), "<u4").tobytes() for w in words}
    fold = table.fold
    monkeypatch.setattr(table, "fold", lambda w: alone.append(w) or fold(w))
    assert table.encode_all(sorted(words)) == want
    assert table.encode_all([]) == {}
    assert all(len(w) > 63 or not set(w) <= set(table.ids) for w in alone)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    assert all(np.frombuffer(table.encode_all([w])[w], "<u4").tolist() == sp.encode(w.replace("▁", "")) for w in sorted(words)[-300:] if w.startswith("▁") and w.strip("▁"))
    few = sentencepiece_codec.Merges({"ab": (-1.0, 5), "bcc": (-2.0, 6), "cc": (-3.0, 9), "c": (-4.0, 7)}, list("abcd"))
    symbols, sizes = few.fold(["abcc", "bcc", "d", "x", "ccc", "abab"], 8)
    assert sizes.tolist() == [2, 1, 1, 1, 2, 2]
    assert symbols.tolist() == [0, 2, 1, 6, -1, 2, 3, 0, 0]


def test_sentencepiece_forgets_words_but_not_the_dictionary(spark, monkeypatch):
    path = public_tokenizers.path("piece_bpe_32k.model")
    import sentencepiece

    monkeypatch.setattr(sentencepiece_codec, "TOGETHER", 50)
    monkeypatch.setattr(sentencepiece_codec, "REMEMBERED", 5)
    texts = [prose(k, 40) + f" q{k * 977}z" for k in range(30)] + ["", None, "漢 字 a▁b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: (r.ids, r.round_trip) for r in sentencepiece_codec.encoded(docs, path, frequent=20).collect()}
    assert got == {i: (sp.encode(text(t)), sp.decode(sp.encode(text(t))) == text(t)) for i, t in enumerate(texts)}
