"""Prefix trie, fill-in-the-middle and multi-index against brute force, with nulls, empty and long values, ties, repeated rows, extra columns and empty tables."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwright.llm import fill_in_middle, multi_index, prefix_trie

TURNS = "conv_id long, turn long, role string, text string, depth int, node string, at long, block int, n string"


def conversations(seed: int) -> list[tuple]:
    rng, rows = np.random.default_rng(seed), []
    for c in [*range(0, 12), *range(100, 112), 205, 206, 320, 10**12, 10**12 + 7]:
        for t in range(int(rng.integers(1, 8))):
            rows.append((c, t, ("user", "assistant")[t % 2], ("ya", "no", "é" * 5, "")[int(rng.integers(0, 4)) if t > 1 else 0]))
    rows += [(7, None, "system", "first of all"), (8, 90, None, None), (8, 91, "user", None), (None, 0, "user", "nobody"), (9, 95, "user", "twice"), (9, 95, "user", "twice")]
    rows += [(300, t, "user", str(t % 3)) for t in range(400)] + [(301, t, "user", str(t % 3)) for t in range(400)]  # two that hold most turns
    return [(*r, 1, "x", 2, 3, "y") for r in rows]


def trie_of(paths: dict[int, list[tuple]]) -> set[tuple]:
    members, ends = defaultdict(set), defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[tuple(p[:d])].add(c)
        ends[tuple(p)].append(c)
    children = defaultdict(set)
    for n in members:
        if n:
            children[n[:-1]].add(n)
    leaves, saved = defaultdict(int), defaultdict(int)
    for n, m in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += not children[n]
            saved[n[:d]] += (len(m) - 1) * (len(n[-1][1]) if n else 0)
    return {
        (min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), leaves[n], saved[n], hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest())
        for n, m in members.items()
    }


def paths_of(rows: list[tuple]) -> dict[int, list[tuple]]:
    paths = defaultdict(list)
    for c, t, role, text, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        paths[c].append((role or "", text or ""))
    return dict(paths)


def again(paths: dict[int, list[tuple]]) -> dict[int, list[tuple]]:
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in paths}
    return {c: paths.get(c - c % 100, [])[: h[c]] + p[h[c] :] for c, p in paths.items()}


def found(df) -> set[tuple]:
    rows = [(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("parts", [1, 7])
def test_prefix_trie(spark, parts):
    rows = conversations(parts)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))  # with seven, the long conversations lie in several blocks
    try:
        df = spark.createDataFrame(rows, TURNS).repartition(3)
        assert found(prefix_trie.shared_trie(df)) == trie_of(again(paths_of(rows)))
        assert found(prefix_trie.prefix_trie(df)) == trie_of(paths_of(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_prefix_trie_of_many_members(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 40)
    rows = [(c, t, "user", "same") for c in range(500) for t in range(2)] + [(1000 + c, 0, "user", "same") for c in range(30)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert found(prefix_trie.prefix_trie(df)) == trie_of(paths_of(rows))


def test_prefix_trie_of_nothing(spark):
    none = spark.createDataFrame([], TURNS)
    assert prefix_trie.shared_trie(none).count() == 0 and prefix_trie.prefix_trie(none).count() == 0


def test_turnless_conversations_are_members_of_the_root(spark):
    rows = [(c, 0, "user", "only") for c in range(501, 540)]  # no conversation 500, and most give their only turn away
    assert found(prefix_trie.shared_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))) == trie_of(again(paths_of(rows)))


TEXTS = ["", None, "one line", "a\nb\nc", "\n\n\n", "x\r\ny\n", "é\nü 😀\n" * 40, "has <S> in it\n", "<P", "line\n" * 3000, "z" * 100_000, "a\nb\nc", "<\nP>\n<"]


def test_fill_in_middle(spark):
    rows = [(i, t, "h", 3, "u") for i, t in enumerate(TEXTS * 8)] + [(None, "no\nid\n", "h", 3, "u"), (3, "a\nb\nc", "h", 3, "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, h string, n int, units string").repartition(3)
    got = sorted(map(repr, (tuple(r) for r in fill_in_middle.report(df).collect())))
    want, texts = [], {}
    for d, t, *_ in rows:
        t = t or ""
        u = re.findall(r"[^\n]*\n|[^\n]+", t)
        k = [int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
        a, b = sorted((k[0] % (len(u) + 1), k[1] % (len(u) + 1)))
        p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
        plain = not t or any(x in t for x in ("<P>", "<S>", "<M>"))
        form = "plain" if plain else "spm" if k[3] % 100 < 50 else "psm"
        out = {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        want.append(repr((d, len(u), form, None if plain else len(p), None if plain else len(m), hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())))
        texts[d, t] = out
    assert got == sorted(want)
    whole = fill_in_middle.restored(fill_in_middle.transformed(df)).select("doc_id", "restored", "output").collect()
    assert {(r.doc_id, r.restored): r.output for r in whole} == texts
    assert fill_in_middle.report(df.where("false")).count() == 0


def test_fill_in_middle_rates_sentinels_and_damage(spark):
    df = spark.createDataFrame([(i, f"first {i}\nsecond (.*)\nthird $1\n") for i in range(300)], "doc_id long, text string")
    marks = fill_in_middle.Sentinels("(pre)", "[suf]", r"\mid")
    rows = fill_in_middle.transformed(df, rate=40, spm=0, marks=marks)
    share = {r.form: r["count"] for r in rows.groupBy("form").count().collect()}
    assert set(share) == {"plain", "psm"} and 80 < share["psm"] < 160
    back = fill_in_middle.restored(rows, marks).join(df, "doc_id")
    assert back.where(F.col("restored") == F.col("text")).count() == 300
    damaged = rows.where("form = 'psm'").withColumn("output", F.regexp_replace("output", r"\[suf\]", ""))
    assert fill_in_middle.restored(damaged, marks).where("restored is not null").count() == 0


def exact(rows: dict[int, np.ndarray], k: int, every: int) -> dict[int, list[tuple]]:
    ids = np.array(sorted(rows))
    x = np.array([rows[i] for i in ids], float)
    out = {}
    for n in [i for i in ids if i % every == 0]:
        s = (x * np.array(rows[n], float)).sum(1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != n][:k]
        out[int(n)] = [(int(ids[j]), s[j]) for j in order]
    return out


def asked(df, **options) -> dict[int, list[tuple]]:
    out = defaultdict(list)
    for r in sorted(multi_index.neighbours(df, **options).collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return dict(out)


def same(got, want, least=1.0):
    hit = n = 0
    for q, w in want.items():
        g = got.get(q, [])
        assert len(g) == len(w) and g == sorted(g, key=lambda x: (-x[1], x[0]))
        hit += len({v for v, _ in g} & {v for v, _ in w})
        n += len(w)
    assert set(got) <= {q for q, w in want.items() if w} and hit >= least * n
    return hit / max(n, 1)


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(5)
    hubs = rng.normal(size=(30, 16))
    rows = {int(i): (hubs[i % 30] + rng.normal(size=16) * 0.3).astype(np.float32) * (1 + i % 3) for i in range(3000)}
    return rows | {i: rows[40] for i in range(5000, 6000)}  # a third of all are copies of one


def test_multi_index_recall_on_clusters_and_copies(spark, clustered):
    df = spark.createDataFrame([(i, v.tolist(), 1, "x", 2.5) for i, v in clustered.items()], "vec_id long, embedding array<float>, cell int, id string, v double").repartition(5)
    got = asked(df, k=10, every=10, rows=300, width=16)
    assert same(got, exact(clustered, 10, 10), 0.9) >= 0.9
    assert [v for v, _ in got[5000]] == [v for v, _ in exact(clustered, 10, 10)[5000]]  # its copies with the smallest ids, itself left out


def test_multi_index_visits_all_when_it_must(spark):
    rng = np.random.default_rng(1)
    rows = {i: rng.normal(size=7) for i in range(400)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows.items()], "vec_id long, embedding array<double>")
    got, want = asked(df, k=20, every=20, recall=1.1), exact(rows, 20, 20)
    assert same(got, want) == 1.0
    assert all(abs(a[1] - b[1]) < 1e-12 for q in want for a, b in zip(got[q], want[q], strict=True))


def test_multi_index_odd_rows(spark):
    rows = {0: [1.0, 0.0], 20: [1.0, 0.0], 3: [0.5, 0.5], 40: [-1.0, 2.0], 5: [1.0, 0.0]}
    odd = [(60, None), (80, []), (100, [0.0, 0.0]), (120, [1.0, None]), (140, [float("nan"), 1.0]), (160, [float("inf"), 1.0]), (None, [1.0, 1.0]), (180, [1.0, 2.0, 3.0]), (3, [0.5, 0.5]), (5, [2.0, 0.0])]
    df = spark.createDataFrame([*rows.items(), *odd], "vec_id long, embedding array<double>")
    assert asked(df, k=20, every=20) == {q: [(v, s) for v, s in w] for q, w in exact({k: np.array(v) for k, v in rows.items()}, 20, 20).items()}
    assert asked(df.where("vec_id = 20")) == {} and asked(df.where("false")) == {}
    one = spark.createDataFrame([(0, [2.0]), (1, [1.0]), (2, [-1.0])], "vec_id long, embedding array<double>")
    assert asked(one) == {0: [(1, 2.0), (2, -2.0)]}


def test_walk_goes_from_the_nearest_pair_on():
    rng = np.random.default_rng(2)
    halves = rng.normal(size=(6, 3)), rng.normal(size=(5, 4))
    counts, q = rng.integers(0, 3, 30).tolist(), rng.normal(size=7)
    d = {i * 5 + j: -(halves[0][i] @ q[:3] + halves[1][j] @ q[3:]) for i in range(6) for j in range(5)}
    every = multi_index.walk(q, halves, counts, sum(counts))
    assert sorted(every) == [c for c in range(30) if counts[c]] and every == sorted(every, key=d.get)
    some = multi_index.walk(q, halves, counts, 7)
    assert some == every[: len(some)] and sum(counts[c] for c in some) >= 7 > sum(counts[c] for c in some[:-1])
