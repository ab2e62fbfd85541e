"""Collocations, the n-gram join and periodic runs against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest

from helixlake.llm import collocations, periods, setjoin
from helixlake.llm.queries import op11_collocations, op12_ngram_join, op13_periodic_runs


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# --- collocations ---


def brute_collocations(rows, longest=3, least=10, covered=50, top=2000):
    counts = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            for m in range(1, longest + 1):
                for i in range(len(ws) - m + 1):
                    counts["und" if lang is None else lang][tuple(ws[i : i + m])] += 1
    out = set()
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        cands = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in cands.items():
            hidden = any(100 * b >= covered * a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cands.items())
            if not hidden:
                score, _, l, r = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(rows)[:top], 1):
            out.add((lang, rank, p.decode(), -a, l, r, n, -score))
    return out


def made_texts(seed, n):
    rng = random.Random(seed)
    words = ["a", "B", "b", "ü", "the", "of", "x\x00y", "it's", "\U0001f600", "né", "end"]
    ends = [" ", "  ", "\t", ".", ", ", "\n", " ! ", "\r\n", "?", ";", "\x0b", " "]
    return [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(words[: rng.choice((3, 11))]) + rng.choice(ends[: rng.choice((3, 12))]) for _ in range(rng.randrange(60)))) for _ in range(n)]


@pytest.mark.parametrize("shard, bucket", [(1 << 21, 1 << 18), (50, 40)])
def test_collocations(spark, monkeypatch, shard, bucket):
    """Also with shards of a few texts and buckets of a few pairs, whose counts reach the least one only together."""
    monkeypatch.setattr(collocations, "BUCKET_WORDS", bucket)
    rows = [*made_texts(1, 150), (None, None), ("en", ""), (None, " \t ")]
    docs = spark.createDataFrame([(lang, text, 1, "x") for lang, text in rows], "lang string, text string, n int, phrase string").repartition(5)
    if shard < 100:
        small = shard
        kept = collocations._shards

        def shards(batches):
            collocations.SHARD_WORDS = small
            yield from kept(batches)

        monkeypatch.setattr(collocations, "_shards", shards)
    want = brute_collocations(rows)
    assert len(want) > 50
    assert {tuple(r) for r in collocations.collocations(docs).collect()} == want


def test_collocations_options(spark):
    rows = made_texts(2, 80)
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = collocations.collocations(docs, longest=4, least=5, covered=70, top=7)
    assert {tuple(r) for r in got.collect()} == brute_collocations(rows, 4, 5, 70, 7)


def test_collocations_of_nothing(spark, empty):
    docs = empty.selectExpr("text", "source AS lang")
    assert collocations.collocations(docs).collect() == []
    assert collocations.collocations(spark.createDataFrame([("en", " . ")], "lang string, text string")).collect() == []


def test_large_counts_are_exact(spark):
    """Products past 64 bits."""
    big = 3_000_000_019
    counts = spark.createDataFrame([("en", "a b", 2, big), ("en", "a", 1, big + 7), ("en", "b", 1, big * 9)], "lang string, phrase string, words int, n long")
    [row] = collocations.scored(counts).collect()
    assert row["score"] == 1_000_000 * big * big // ((big + 7) * big * 9)


def test_suffix_array():
    ids = np.array([1, 2, 1, 2, 3, 0, 1, 2, 0], dtype=np.int32)
    order, shared = collocations.suffix_array(ids, 3)
    padded = [*ids, 0, 0, 0, 0]
    assert [padded[i : i + 3] for i in order] == sorted(padded[i : i + 3] for i in range(len(ids)))
    starts, sizes, inside = collocations.phrases(ids, order, shared, 2)
    assert {tuple(ids[order[s] : order[s] + 2].tolist()): int(c) for s, c, ok in zip(starts, sizes, inside) if ok} == {(1, 2): 3, (2, 1): 1, (2, 3): 1}


# --- n-gram join ---


def brute_join(rows, k=3, percent=90):
    sets = []
    for _, text in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
        sets.append({tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else {tuple(ws)} if ws else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        ids[find(i)].append(doc_id)
    least = {r: min((x for x in xs if x is not None), default=None) for r, xs in ids.items()}
    return Counter((doc_id, len(s), least[find(i)] if s else doc_id) for i, ((doc_id, _), s) in enumerate(zip(rows, sets)))


def edited(ws, rng, times, words):
    ws = list(ws)
    for _ in range(times):
        i = rng.randrange(len(ws))
        kind = rng.randrange(3)
        if kind == 0:
            ws[i] = rng.choice(words)
        elif kind == 1:
            del ws[i]
        else:
            ws.insert(i, rng.choice(words))
    return ws


def families(seed):
    """Families around and without their original, texts of shared passages, short texts, and repeated ones."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passages = [[rng.choice(words) for _ in range(40)] for _ in range(3)]
    rows = []
    for size, length, edits in ((25, 120, 3), (25, 60, 2), (12, 200, 4), (10, 30, 1), (8, 12, 1)):
        base = [rng.choice(words) for _ in range(length)]
        for k in range(size):
            rows.append(" ".join(edited(base, rng, rng.randrange(edits + 1) if size > 12 else edits, words)))
    for _ in range(30):
        ws = [w for p in rng.sample(passages, 2) for w in p] + [rng.choice(words) for _ in range(rng.randrange(12))]
        rows.append(" ".join(ws))
    base = [rng.choice(words) for _ in range(11)]
    rows += [" ".join(base), " ".join([*base, "more"]), " ".join(base).upper(), "\n".join(base), "w1 w2", "W1\tw2", "w1", "", " ", None, None, " ".join(base[:10])]
    rng.shuffle(rows)
    return [(None if rng.random() < 0.03 else k // 2 if k < 20 else k, text) for k, text in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join(spark, seed):
    rows = families(seed)
    docs = spark.createDataFrame([(i, t, 3, "x") for i, t in rows], "doc_id long, text string, n int, root string").repartition(3)
    got = Counter(tuple(r) for r in setjoin.joined(docs).collect())
    want = brute_join(rows)
    assert len({c for _, _, c in want}) < len(rows) - 40
    assert got == want


def test_ngram_join_of_other_similarity(spark):
    rows = families(4)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in setjoin.joined(docs, ngram=2, percent=70).collect()) == brute_join(rows, 2, 70)


def test_ngram_join_at_the_threshold(spark):
    """18 of 20 n-grams are 90 per cent, 9 of 10 too, 17 of 19 aren't."""
    line = lambda name, n: [f"{name}{i}" for i in range(n)]
    rows = [(1, line("a", 20)), (2, line("a", 22)), (3, line("b", 11)), (4, line("b", 12)), (5, line("c", 19)), (6, line("c", 21)), (7, line("d", 10)), (8, line("d", 11))]
    rows = [(i, " ".join(ws)) for i, ws in rows]
    got = {r["doc_id"]: r["component_id"] for r in setjoin.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6, 7: 7, 8: 8}
    assert Counter(tuple(r) for r in setjoin.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == brute_join(rows)


def test_ngram_join_of_edges(spark, edge, empty):
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    assert Counter(tuple(r) for r in setjoin.joined(edge).collect()) == brute_join(rows)
    assert setjoin.joined(empty).collect() == []


def test_derived_answers(spark):
    rng = random.Random(5)
    universe = np.arange(1, 3000, dtype=np.uint64)
    lead = np.array(sorted(rng.sample(range(1, 3000), 200)), dtype=np.uint64)

    def near():
        kept = [x for x in lead.tolist() if rng.random() < 0.95]
        return np.array(sorted({*kept, *rng.sample(universe.tolist(), 12)}), dtype=np.uint64)

    rows, want = [], []
    for _ in range(30):
        a, b = near(), near()
        parts = [lead[~np.isin(lead, a)], a[~np.isin(a, lead)], lead[~np.isin(lead, b)], b[~np.isin(b, lead)]]
        rows.append((len(lead), *[p.tobytes() for p in parts]))
        want.append(len(np.intersect1d(a, b)))
    df = spark.createDataFrame(rows, "n long, ma binary, pa binary, mb binary, pb binary").coalesce(1)
    assert [r[0] for r in df.select(setjoin.derived("n", "ma", "pa", "mb", "pb")).collect()] == want


# --- periodic runs ---


def brute_runs(ws):
    found = {}
    for q in range(len(ws) // 4, 0, -1):
        i = 0
        while i + q < len(ws):
            if ws[i] != ws[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(ws) and ws[i] == ws[i + q]:
                i += 1
            if i + q - start >= max(6, 4 * q):
                found[start, i + q] = q
    return sorted((s, e - s, q) for (s, e), q in found.items()), [w for i, w in enumerate(ws) if not any(s + q <= i < e for (s, e), q in found.items())]


def brute_runs_sorted(ws):
    runs, kept = brute_runs(ws)
    return sorted(runs, key=lambda r: (r[0], r[2])), kept


def periodic_texts(seed, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        words = ["ab", "AB", "c", "dé", " ", "e\x00", "\U0001f600"][: rng.choice((2, 3, 7))]
        ws = []
        for _ in range(rng.randrange(6)):
            unit = [rng.choice(words) for _ in range(rng.randrange(1, 9))]
            ws += unit * rng.randrange(1, 9) + unit[: rng.randrange(len(unit))]
            ws += [rng.choice(words) for _ in range(rng.randrange(5))]
        out.append(" ".join(ws).replace(" ", rng.choice((" ", "\t", "\n ", "\x0b")), 3))
    return out


def test_runs(spark, monkeypatch):
    texts = [*periodic_texts(1, 300), "", None, "a " * 3000, "a b c d e f g h i j " * 100, "a " * 5, "a " * 6, "a b " * 4, "a b " * 3 + "a"]
    docs = spark.createDataFrame([(k, t, 7, "x") for k, t in enumerate(texts)], "doc_id long, text string, runs int, start string")
    got = {r["doc_id"]: r for r in periods.with_runs(docs).collect()}
    assert len(got) == len(texts) and periods.with_runs(docs).columns == ["doc_id", "text", "start", "runs", "collapsed"]
    for k, t in enumerate(texts):
        runs, kept = brute_runs_sorted(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        assert [tuple(r) for r in got[k]["runs"]] == runs, t
        assert got[k]["collapsed"] == " ".join(kept)


def test_runs_in_slices():
    """Texts cut into slices and candidates into parts give the same."""
    texts = [t.encode().split() for t in periodic_texts(3, 60)] + [[b"a", b"b"] * 40]
    whole = list(periods._worked(texts))
    for k, ws in enumerate(texts):
        runs, kept = brute_runs_sorted(ws)
        assert [tuple(r.values()) for r in whole[k][0]] == runs and whole[k][1] == b" ".join(kept).decode()
    kept, periods.CANDIDATES = periods.CANDIDATES, 7
    try:
        assert list(periods._worked(texts)) == whole
    finally:
        periods.CANDIDATES = kept


def test_runs_of_nothing(spark, empty, edge):
    assert periods.with_runs(empty).collect() == []
    assert periods.with_runs(edge).count() == edge.count()


def test_names():
    ids = np.array([1, 2, 1, 2, 1, 2, 3, 1, 2], dtype=np.int64)
    text = np.array([0, 0, 0, 0, 0, 0, 0, 1, 1])
    levels = periods.names(ids, text)
    ahead, before = periods.extents(levels, np.array([0, 0, 2]), np.array([2, 7, 4]))
    assert ahead.tolist() == [4, 0, 2] and before.tolist() == [0, 0, 2]  # never into another text


# --- the registered queries ---


@pytest.fixture
def folder(spark, tmp_path):
    rng = random.Random(9)
    texts = periodic_texts(5, 120) + [t for _, t in made_texts(6, 80)] + [t for _, t in families(7)][:60]
    rows = [(None if k == 3 else k * 37 - 200, t, rng.choice(["en", None])) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path), rows


def test_queries(spark, folder):
    path, rows = folder
    assert {tuple(r) for r in op11_collocations(spark, path).collect()} == brute_collocations([(lang, t) for _, t, lang in rows])
    assert Counter(tuple(r) for r in op12_ngram_join(spark, path).collect()) == brute_join([(i, t) for i, t, _ in rows])
    got = {r["doc_id"]: tuple(r)[1:] for r in op13_periodic_runs(spark, path).collect()}
    changed = 0
    for doc_id, t, _ in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        g, n = h // 10, len(ws)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            ws = [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]
            changed += 1
        runs, kept = brute_runs_sorted(ws)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        digest = lambda s: sha256(s.encode()).hexdigest()
        four = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
        assert got[doc_id] == (len(runs), *four, digest("".join(f"{s},{length},{q}\n" for s, length, q in runs)), digest(" ".join(kept)))
    assert changed > 5
