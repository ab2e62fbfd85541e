"""Operators that compare rows, and the pipeline, against plain Python."""

from __future__ import annotations

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from helixlake.llm import decontam, linedup, omh
from helixlake.llm.components import components
from helixlake.llm.quality import DecisionList, judged

from .conftest import EDGE


def texts_frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def words_of(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        k = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[k] = f"e{rng.randrange(10**6)}"
        elif kind == 1:
            out.insert(k, f"e{rng.randrange(10**6)}")
        else:
            del out[k]
    return out


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
    return row[-1]


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


# --- components


def test_components_against_union_find(spark):
    rng = random.Random(1)
    for n, m in ((60, 40), (40, 100), (30, 29)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] if m != 29 else [(k, k + 1) for k in range(29)]
        parent = list(range(n))
        for a, b in edges:
            a, b = find(parent, a), find(parent, b)
            parent[max(a, b)] = min(a, b)
        found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
        assert {k: found.get(k, k) for k in range(n)} == {k: find(parent, k) for k in range(n)}
    assert components(spark.createDataFrame([], "a int, b int")).collect() == []


# --- Order MinHash


def test_banded_alignment_against_full_tables():
    rng = random.Random(2)
    for _ in range(4000):
        a = [rng.randrange(rng.choice([2, 6, 40])) for _ in range(rng.randrange(25))]
        b = edited(rng, a, rng.randrange(7)) if a and len(a) > 8 else [rng.randrange(4) for _ in range(rng.randrange(10))]
        most, d = rng.randrange(12), levenshtein(a, b)
        assert min(omh.banded(a, b, most), most + 1) == min(d, most + 1)


def test_similarity():
    a = [str(k) for k in range(50)]
    assert omh.similarity(a, a) == 1.0
    assert omh.similarity([], []) == 1.0
    assert omh.similarity(a, a[:40]) == pytest.approx(0.8)
    assert omh.similarity(a, a[:39]) == 0.0
    assert omh.similarity(a, a[25:] + a[:25]) == 0.0


def test_order_decides_sketches():
    """Moving passages changes sketches that a set's minima would keep."""
    import numpy as np

    words = np.random.default_rng(0).integers(0, 2**63, 200, dtype=np.uint64)
    moved = np.concatenate([words[100:], words[:100]])
    same = omh.order_minhash(words)
    assert (same == omh.order_minhash(words.copy())).all()
    assert (same == omh.order_minhash(moved)).mean() < 0.6
    assert len(set(omh.mers(np.array([5, 5, 5, 5], dtype=np.uint64), 2).tolist())) == 3


def test_candidates_at_the_threshold():
    """Of pairs at the similarity itself, isolated ones and of every length, nine in ten share a sketch."""
    import numpy as np

    rng, found, pairs = random.Random(1), 0, 0

    def keys(words):
        hashed = np.array(words, dtype=np.uint64)
        made = [omh.order_minhash(hashed), omh.order_minhash(hashed, omh.FINE, sketches=omh.FINE_SKETCHES)]
        return set(np.concatenate([*made, omh.order_minhash(hashed, 1)] if len(words) < omh.SHORT else made).tolist())

    for n in (10, 20, 39, 41, 49, 50, 60, 100, 200, 400):
        own = 0
        for _ in range(60):
            a = [rng.randrange(2**60) for _ in range(n)]
            b = list(a)
            for k in rng.sample(range(n), n // 5):
                b[k] = rng.randrange(2**60)
            own += bool(keys(a) & keys(b))
        assert own >= 48, n
        found, pairs = found + own, pairs + 60
    assert found >= 0.9 * pairs


def test_candidates_of_a_regular_pitch():
    """Texts in which every fifth word is another keep no 5-mer; nine in ten share a sketch, at every length."""
    import numpy as np

    rng = random.Random(11)

    def keys(words):
        hashed = np.array(words, dtype=np.uint64)
        made = [omh.order_minhash(hashed), omh.order_minhash(hashed, omh.FINE, sketches=omh.FINE_SKETCHES)]
        return set(np.concatenate([*made, omh.order_minhash(hashed, 1)] if len(words) < omh.SHORT else made).tolist())

    found, pairs = 0, 0
    for n in (20, 45, 50, 60, 100, 200, 400, 1000):
        own = 0
        for _ in range(100):
            a = [rng.randrange(2**60) for _ in range(n)]
            b = list(a)
            for k in range(rng.randrange(5), n, 5):
                b[k] = rng.randrange(2**60)
            own += bool(keys(a) & keys(b))
        assert own >= 84, n
        found, pairs = found + own, pairs + 100
    assert found >= 0.9 * pairs


def test_small_maps_keep_every_similar_pair():
    """Whatever the edits, the small maps never tell similar texts apart."""
    import numpy as np

    rng = random.Random(12)
    for _ in range(400):
        n = rng.randrange(5, 700)
        a = [rng.randrange(1, 60 if rng.random() < 0.3 else 2**60) << 20 for _ in range(n)]
        b = list(a)
        for _ in range(n // 5):
            k = rng.randrange(len(b))
            kind = rng.randrange(3)
            if kind == 0:
                b[k] = rng.randrange(2**40) << 20
            elif kind == 1 and len(b) > 1:
                del b[k]
            else:
                b.insert(k, rng.randrange(2**40) << 20)
        if omh.similarity(a, b) < 0.8:
            continue
        one, two = (omh.odd_map(np.array([x % 2**64 for x in w], dtype=np.uint64)) for w in (a, b))
        turned = sum(((int(x) ^ int(y)) & (1 << 64) - 1).bit_count() for x, y in zip(one, two))
        assert 5 * (turned + abs(len(a) - len(b))) <= 2 * max(len(a), len(b))


def families(rng):
    texts = []
    for size, edits in ((1, 0), (2, 2), (5, 5), (12, 5), (3, 1), (2, 60)):
        base = words_of(rng, rng.randrange(60, 160))
        texts += [" ".join(edited(rng, base, rng.randrange(edits + 1))) for _ in range(size)]
    passage = " ".join(words_of(rng, 40))
    texts += [f"{passage} {' '.join(words_of(rng, 50))}" for _ in range(12)]
    texts += [texts[3]] * 5 + ["", "", "one", "one", "two words"]
    short = words_of(rng, 12)
    texts += [" ".join(short), " ".join(short[:5] + ["changed"] + short[6:])]
    rng.shuffle(texts)
    return texts


def test_near_duplicates_against_brute_force(spark):
    texts = families(random.Random(9))
    split = [t.split() for t in texts]
    parent = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if texts[a] == texts[b] or split[a] and split[b] and omh.similarity(split[a], split[b]) >= 0.8:
            x, y = find(parent, a), find(parent, b)
            parent[max(x, y)] = min(x, y)
    found = {r.doc_id: r.class_id for r in omh.near_duplicates(texts_frame(spark, texts)).collect()}
    assert found == {k: find(parent, k) for k in range(len(texts))}
    kept = {r.doc_id for r in omh.deduplicated(texts_frame(spark, texts)).collect()}
    assert kept == {find(parent, k) for k in range(len(texts))}


def test_near_duplicates_by_shuffle(spark, monkeypatch):
    texts = families(random.Random(10))
    expected = {r.doc_id: r.class_id for r in omh.near_duplicates(texts_frame(spark, texts)).collect()}
    monkeypatch.setattr(omh, "BROADCAST_NODES", -1)
    monkeypatch.setattr(omh, "GROWTH", 2)
    assert {r.doc_id: r.class_id for r in omh.near_duplicates(texts_frame(spark, texts)).collect()} == expected


@pytest.mark.parametrize("travels", [True, False])
def test_texts_just_beyond_a_family_make_no_pairs(spark, monkeypatch, travels):
    """Texts that are not quite similar to a family share buckets with all of it; what is stored of them are the links
    (of texts that travel), not the pairs that have met."""
    rng = random.Random(21)
    base = words_of(rng, 120)
    texts = [" ".join(edited(rng, base, 2)) for _ in range(40)]
    beyond = []
    for _ in range(24):
        words = list(base)
        for k in range(rng.randrange(4), len(words), 4):  # every fourth word, so a similarity of 0.75 to the family
            words[k] = f"other{rng.randrange(10**9)}"
        beyond.append(" ".join(words))
    texts += beyond + [" ".join(edited(rng, beyond[0].split(), 3))]
    monkeypatch.setattr(omh, "GROWTH", 3)
    if not travels:
        monkeypatch.setattr(omh, "coded", lambda text: F.from_json(F.lit("{}"), "code string, odd array<smallint>"), raising=False)
    monkeypatch.setattr(omh, "_near", lambda a, b: F.lit(True))
    monkeypatch.setattr(omh, "_possible", lambda a, b: F.lit(True))
    pairs = []

    def stored(df, name, of=omh.stored):
        made = of(df, name)
        if name == "pairs":
            pairs.append(made.count())
        return made

    monkeypatch.setattr(omh, "stored", stored)
    found = {r.doc_id: r.class_id for r in omh.near_duplicates(texts_frame(spark, texts)).collect()}
    parent = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if omh.similarity(texts[a].split(), texts[b].split()) >= 0.8:
            x, y = find(parent, a), find(parent, b)
            parent[max(x, y)] = min(x, y)
    assert found == {k: find(parent, k) for k in range(len(texts))}
    later = sum(pairs[2:])  # the first two are of the leaders
    assert later <= len(texts) if travels else later > len(texts)


def test_codes_keep_every_similar_pair(spark):
    rng = random.Random(22)
    rows = []
    for _ in range(60):
        a = words_of(rng, rng.choice((3, 30, 90, 300, 700)), 3000)
        b = edited(rng, a, rng.randrange(len(a) // 4 + 1)) if rng.random() < 0.8 else words_of(rng, len(a))
        rows.append((" ".join(a), " ".join(b)))
    rows += [("", "a"), (" ".join(words_of(rng, omh.HELD + 1)), "a")]
    both = spark.createDataFrame(rows, "a string, b string").select("a", "b", omh.coded("a").alias("ta"), omh.coded("b").alias("tb"))
    sized = both.withColumns({"ca": F.struct(F.size(F.split("a", " ")).alias("n")), "cb": F.struct(F.size(F.split("b", " ")).alias("n"))})
    told = 0
    for r in sized.withColumn("close", omh._close("ca", "cb", "ta", "tb")).collect():
        n = len(r.a.split())
        assert r.close or omh.similarity(r.a.split(), r.b.split()) == 0.0
        assert (r.ta.code is None) == (n > omh.HELD) and (r.ta.code is None or len(r.ta.code) == n)
        assert (r.ta.odd is None) == (n <= omh.HELD)
        told += not r.close
    assert told >= 10


def test_lists_tell_how_often_a_word_stands(spark):
    """Texts of words that all stand twice are as far apart as others are: lists and maps hold words with their occurrence."""
    rng = random.Random(23)
    rows = []
    for apart in (0, 40, 90, 200, 300):
        words = words_of(rng, 300, 10**6)
        other = [f"x{w}" if k < apart else w for k, w in enumerate(words)]
        rows.append((" ".join(w for w in words for _ in range(2)), " ".join(w for w in other for _ in range(2))))
    both = spark.createDataFrame(rows, "a string, b string").select("a", "b", omh.coded("a").alias("ta"), omh.coded("b").alias("tb"), omh.widened("a").alias("wa"), omh.widened("b").alias("wb"))
    sized = both.withColumns({"ca": F.struct(F.lit(600).alias("n")), "cb": F.struct(F.lit(600).alias("n"))})
    found = sized.select(omh._close("ca", "cb", "ta", "tb"), omh._within("ca", "cb", "wa", "wb"), F.size("wa")).collect()
    assert [tuple(r) for r in found] == [(k < 2, k < 2, omh.WIDE) for k in range(5)]
    assert spark.createDataFrame([("a b",)], "a string").select(omh.widened("a")).first()[0] is None


def test_quick_bounds_keep_the_verdict_of_the_alignment(monkeypatch):
    rng = random.Random(24)
    exact = 0
    for _ in range(1500):
        a = [str(rng.randrange(rng.choice((3, 12, 60)))) for _ in range(rng.randrange(1, 40))]
        b = edited(rng, a, rng.randrange(len(a) // 3 + 1)) if rng.random() < 0.8 else a[len(a) // 2 :] + a[: len(a) // 2]
        distance = omh.banded(a, b, len(a) + len(b)) if b else len(a)
        assert omh.edits(a, b) >= distance
        assert omh.similar(a, b) == (omh.similarity(a, b) >= omh.SIMILAR)
        exact += omh.edits(a, b) == distance
    assert exact >= 900 and omh.edits([], []) == 0 and omh.similar([], []) and not omh.similar(["a"], [])
    monkeypatch.setattr(omh, "banded", None)  # near copies need no alignment
    base = [f"w{k}" for k in range(400)]
    assert omh.similar(base, base[:100] + ["in"] + base[100:300] + base[310:]) and omh.similar(base, [*base[:7], "x", *base[8:]])


@pytest.mark.parametrize("broadcast", [omh.BROADCAST_CODES, -1])
def test_crowded_buckets_are_cut(spark, monkeypatch, broadcast):
    """Long texts that share a passage and are not similar, and a family: the same classes however buckets are dealt."""
    rng = random.Random(25)
    passage, base = words_of(rng, 210), words_of(rng, 300)
    texts = [" ".join(passage + words_of(rng, 90)) for _ in range(14)] + [" ".join(edited(rng, base, 25)) for _ in range(14)]
    texts += [" ".join(edited(rng, texts[k].split(), 20)) for k in (0, 3, 3)]
    rng.shuffle(texts)
    split = [t.split() for t in texts]
    parent = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if omh.similarity(split[a], split[b]) >= 0.8:
            x, y = find(parent, a), find(parent, b)
            parent[max(x, y)] = min(x, y)
    monkeypatch.setattr(omh, "CROWD", 3)
    monkeypatch.setattr(omh, "GROWTH", 3)
    monkeypatch.setattr(omh, "FIRST", 1)
    monkeypatch.setattr(omh, "BROADCAST_CODES", broadcast)
    pairs = []

    def stored(df, name, of=omh.stored):
        made = of(df, name)
        pairs.append((name, made.count()))
        return made

    monkeypatch.setattr(omh, "stored", stored)
    found = {r.doc_id: r.class_id for r in omh.near_duplicates(texts_frame(spark, texts)).collect()}
    assert found == {k: find(parent, k) for k in range(len(texts))}
    assert max(n for name, n in pairs[[name for name, _ in pairs].index("open-members") :] if name == "pairs") <= 30


def test_near_duplicate_edges(spark, edge, empty):
    rows = sorted((r.doc_id or 0, r.class_id) for r in omh.near_duplicates(edge).collect())
    assert rows == [(0, None), (1, 1), (1, 1), (1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 6), (7, 1)]
    kept = omh.deduplicated(edge).collect()
    assert sorted((r.doc_id or 0, (r.text or "")[:3]) for r in kept) == [(0, "a t"), (1, "ano"), (1, "pla"), (2, ""), (3, ""), (4, " \t\n"), (5, "wor"), (6, "ünï")]
    assert omh.near_duplicates(empty).collect() == []
    assert omh.deduplicated(empty).collect() == []


# --- line dedup


def brute_lines(docs):
    lines, gone = [], set()
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is not None, d[0])):
        for k, line in enumerate((text if text is not None else "").split("\n")):
            ws = set(re.findall(r"[^\x20\x09-\x0D]+", line))
            if ws:
                if any(len(ws & other) / len(ws | other) >= 0.8 - 1e-12 for other in lines):
                    gone.add((doc_id, k))
                lines.append(ws)
    return gone


def made_lines(rng, n=40):
    pool = [" ".join(words_of(rng, rng.randrange(1, 14), 40)) for _ in range(60)]
    base = words_of(rng, 30, 5000)
    docs = []
    for k in range(n):
        lines = [rng.choice(pool) for _ in range(rng.randrange(6))] + [" ".join(edited(rng, base, rng.randrange(6)))]
        lines += [rng.choice(["", "  ", "a\tb", "b a", "a b c d", "d c b a e"])]
        rng.shuffle(lines)
        docs.append((k, "\n".join(lines)))
    return docs


@pytest.mark.parametrize(("first", "by_chance"), [(16, 1 / 8), (1, 1e9), (2, 1e-9)])
def test_lines_against_brute_force(spark, monkeypatch, first, by_chance):
    """Also with few first lines, and with all grams of two words or of three."""
    monkeypatch.setattr(linedup, "FIRST", first)
    monkeypatch.setattr(linedup, "BY_CHANCE", by_chance)
    monkeypatch.setattr(linedup, "TABLE", 1 << 10)
    docs = made_lines(random.Random(first))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = {(r.doc_id, r.line_no) for r in linedup.repeated(frame).collect()}
    assert found == brute_lines(docs)
    cut = {r.doc_id: (r.text, r.removed) for r in linedup.deduplicated(frame).collect()}
    for doc_id, text in docs:
        kept = [line for k, line in enumerate(text.split("\n")) if (doc_id, k) not in found]
        assert cut[doc_id] == ("\n".join(kept), sorted(k for d, k in found if d == doc_id))


def test_lines_of_far_ids(spark, monkeypatch):
    """Ids that can't be packed are numbered in order; more lines than may be broadcast are joined."""
    monkeypatch.setattr(linedup, "TABLE", 1 << 10)
    monkeypatch.setattr(linedup, "BROADCAST_LINES", -1)
    far = [-(2**63), -5, 0, 7, 2**62, 2**63 - 1]
    docs = [(i, text) for i, (_, text) in zip([*far, None], made_lines(random.Random(8), 7))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {(r.doc_id, r.line_no) for r in linedup.repeated(frame).collect()} == brute_lines(docs)


def test_texts_of_one_id_are_apart(spark):
    """Texts under a null id or one id lose their own lines only, those under a null id go for their own passages only."""
    words = [f"w{k}" for k in range(200)]
    line = lambda k: " ".join(words[k : k + 20])
    for key in (None, 5):
        rows = [(1, line(0)), (key, f"{line(40)}\n{line(0)}"), (key, f"{line(80)}\n{line(120)}"), (key, f"{line(160)}\n{line(160)}")]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        kept = {r.text for r in linedup.deduplicated(docs).collect()}
        expected = {line(0), line(40), rows[2][1], line(160)} if key else {rows[1][1], "", rows[2][1], line(160)}
        assert kept == expected
        benchmark = spark.createDataFrame([(1, line(160))], "item_id long, text string")
        left = {r.text for r in decontam.without_overlaps(docs, benchmark).collect()}
        assert left == {t for k, t in rows[:3] if k != 5}


def test_line_edges(spark, edge, empty, monkeypatch):
    monkeypatch.setattr(linedup, "TABLE", 1 << 10)
    rows = {(r.doc_id, r.line_no) for r in linedup.repeated(edge).collect()}
    assert rows == {(7, 0)}
    cut = linedup.deduplicated(edge).collect()
    assert len(cut) == len(EDGE)
    assert [r.text for r in cut if r.doc_id == 7] == [""]
    assert [r.text for r in cut if r.doc_id == 2] == [None]
    assert linedup.repeated(empty).collect() == []
    assert linedup.deduplicated(empty).collect() == []


def test_line_grams_are_dealt_in_shares(spark, monkeypatch):
    """No shuffle has all grams of the lines, and the table of frequencies that stands in plans is small."""
    monkeypatch.setattr(linedup, "TABLE", 1 << 10)
    docs = made_lines(random.Random(3))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    tables, buckets = [], []

    def rarity(lines, of=linedup.rarity):
        tables.append(of(lines)[0])
        return of(lines)

    def stored(df, name, of=linedup.stored):
        found = of(df, name)
        if name == "line-buckets":
            buckets.append(found.count())
        return found

    monkeypatch.setattr(linedup, "rarity", rarity)
    monkeypatch.setattr(linedup, "stored", stored)
    assert {(r.doc_id, r.line_no) for r in linedup.repeated(frame).collect()} == brute_lines(docs)
    assert max(map(len, tables)) <= 4 * linedup.TABLE + 1
    *shares, _ = buckets
    assert len(shares) > 1 and max(shares) <= sum(shares) / 2


@pytest.mark.parametrize("held", [0, 12, 1000])
def test_open_lines_of_a_family_make_no_square_of_pairs(spark, monkeypatch, held):
    """Near copies that are hardly similar meet in the join that ends at a match; longer lines are looked up in pairs."""
    monkeypatch.setattr(linedup, "TABLE", 1 << 10)
    monkeypatch.setattr(linedup, "FIRST", 1)
    monkeypatch.setattr(linedup, "HELD", held, raising=False)
    rng = random.Random(5)
    base, pairs = words_of(rng, 40, 5000), []
    docs = [(k, " ".join(edited(rng, base, rng.randrange(3, 7)))) for k in range(80)]
    docs += [(100 + k, text) for k, (_, text) in enumerate(made_lines(rng, 10))]

    def stored(df, name, of=linedup.stored):
        found = of(df, name)
        if name == "line-pairs":
            pairs.append(found.count())
        return found

    monkeypatch.setattr(linedup, "stored", stored)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {(r.doc_id, r.line_no) for r in linedup.repeated(frame).collect()} == brute_lines(docs)
    if held == 1000:
        assert sum(pairs) <= sum(text.count("\n") + 1 for _, text in docs)  # with the earliest line of a bucket, at most


# --- decontamination


def test_masks_lose_nothing():
    """However two of thirteen words are changed, some window under the mask is untouched."""
    for changed in itertools.combinations(range(decontam.WINDOW), decontam.MISMATCHES):
        assert any(
            not {start + k for k in mask} & set(changed)
            for mask in decontam.MASKS
            for start in range(decontam.WINDOW - decontam.span(mask) + 1)
        )


def brute_overlaps(docs, items):
    split = lambda t: [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").lower()) if w]
    first = {}
    for item_id, text in items:
        key = tuple(split(text))
        if key:
            first[key] = min(first.get(key, item_id), item_id)
    out = {}
    for doc_id, text in docs:
        ws = split(text)
        for iw, item_id in first.items():
            for d in range(-len(iw) + 1, len(ws)):
                agree = [ws[q + d] == iw[q] for q in range(max(0, -d), min(len(iw), len(ws) - d))]
                w = decontam.WINDOW
                if len(iw) < w:
                    ok = len(agree) == len(iw) and all(agree)
                else:
                    ok = any(sum(agree[k : k + w]) >= w - decontam.MISMATCHES for k in range(len(agree) - w + 1))
                if ok:
                    old = out.get((doc_id, item_id), (0, 0, 10**9))
                    out[doc_id, item_id] = (len(iw), max(old[1], sum(agree)), min(old[2], max(d, 0)))
    return out


def leaks(rng):
    items = [(k, " ".join(words_of(rng, n, 300))) for k, n in enumerate([1, 3, 7, 8, 11, 12, 13, 14, 30, 50])]
    items += [(20, items[8][1].upper()), (21, None), (22, ""), (23, "?!")]
    docs = []
    for k in range(60):
        words = words_of(rng, rng.randrange(5, 80), 300)
        part = items[rng.randrange(10)][1].split()
        if len(part) > 20 and k % 2:
            part = part[rng.randrange(10) :][: rng.randrange(10, 25)]
        for _ in range(k % 5):
            part[rng.randrange(len(part))] = "changed"
        at = rng.randrange(len(words))
        docs.append((k, " ".join([*words[:at], *part, *words[at:]])))
    return docs, items


def test_overlaps_against_brute_force(spark):
    docs, items = leaks(random.Random(5))
    expected = brute_overlaps(docs, items)
    bench, frame = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    shown = lambda df: {(r.doc_id, r.item_id): (r.n_item_words, r.n_matched, r.first_word) for r in df.collect()}
    assert shown(decontam.overlaps(frame, bench)) == expected
    assert shown(decontam.overlaps(frame, bench, most=0)) == expected  # by shuffle
    kept = {r.doc_id for r in decontam.without_overlaps(frame, bench).collect()}
    assert kept == {k for k, _ in docs} - {k for k, _ in expected}
    assert 20 < len(expected) < 60


def test_overlaps_of_a_long_item(spark):
    """An item of 40,000 words, of which documents hold parts, repeated words included."""
    rng = random.Random(3)
    item = words_of(rng, 40_000, 30_000)
    docs = [(1, " ".join(item[20_000:20_030])), (2, " ".join(words_of(rng, 50, 30_000))), (3, " ".join([*item[100:140], *item[100:140]])), (4, " ".join(item))]
    bench, frame = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    found = {(r.doc_id, r.item_id, r.n_item_words, r.n_matched, r.first_word) for r in decontam.overlaps(frame, bench).collect()}
    assert {(d, i, n, m) for d, i, n, m, _ in found} == {(1, 7, 40_000, 30), (3, 7, 40_000, 40), (4, 7, 40_000, 40_000)}


def test_overlap_edges(spark, edge, empty):
    bench = spark.createDataFrame([(1, "text without an id but with words"), (None, "few words here and there"), (3, None)], "item_id long, text string")
    rows = {(r.doc_id, r.item_id) for r in decontam.overlaps(edge, bench).collect()}
    assert rows == {(None, 1), (1, None), (7, None)}
    assert sorted(r.doc_id for r in decontam.without_overlaps(edge, bench).collect()) == [2, 3, 4, 5, 6]
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.overlaps(edge, none).collect() == []
    assert decontam.without_overlaps(edge, none).count() == len(EDGE)
    assert decontam.overlaps(empty, bench).collect() == []


# --- pipeline


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    folder = tmp_path_factory.mktemp("corpus")
    bench = [(k, " ".join(words_of(rng, 20, 9000))) for k in range(3)]
    docs = []
    for k in range(180):
        lines = [" ".join(words_of(rng, 15, 9000)) for _ in range(6)]
        if k % 10 == 1:
            lines.append(bench[k % 3][1])
        if k % 5 == 0:
            lines.append("a line that very many documents of this corpus share")
        text = "\n".join(lines)
        if k % 6 == 2:
            text = " ".join(w + "###" for w in text.split())
        docs.append((k, text, "en", "s", len(text)))
    docs.append((180, "\n".join(reversed(docs[3][1].split("\n"))), "en", "s", 1))
    docs.append((181, docs[4][1], "en", "s", 1))
    docs += [(182, None, None, None, None), (183, "too short", "en", "s", 9)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = [(k, 0 if k % 6 == 2 else 1, 0) for k in range(180)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), docs, bench


def test_stages_against_brute_force(spark, corpus):
    folder, docs, bench = corpus
    stages = dict(corpus_pipeline.STAGES)
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    columns = frame.columns
    kept = stages["quality rules"](spark, frame, folder)
    assert kept.columns == columns
    expected = {d[0] for d in docs if d[1] and len(d[1].split()) >= 10 and "###" not in d[1]}
    assert {r.doc_id for r in kept.collect()} == expected

    cut = stages["line dedup"](spark, kept, folder)
    assert cut.columns == columns
    before = [(r.doc_id, r.text) for r in kept.collect()]
    gone = brute_lines(before)
    after = {r.doc_id: r for r in cut.collect()}
    assert len(after) == len(expected)
    for doc_id, text in before:
        assert after[doc_id].text == "\n".join(x for k, x in enumerate(text.split("\n")) if (doc_id, k) not in gone)
        assert after[doc_id].n_chars == len(after[doc_id].text) or doc_id >= 180 and not any(d == doc_id for d, _ in gone)
    assert after[180].text == after[181].text == ""

    one = stages["near-dedup"](spark, cut, folder)
    assert one.columns == columns
    assert {r.doc_id for r in one.collect()} == expected - {181}

    clean = stages["decontamination"](spark, one, folder)
    assert clean.columns == columns
    found = brute_overlaps([(r.doc_id, r.text) for r in one.collect()], bench)
    assert {r.doc_id for r in clean.collect()} == expected - {181} - {d for d, _ in found}
    assert found

    last = stages["tokens"](spark, clean, folder).collect()
    assert len(last) == clean.count()
    ran = corpus_pipeline.run(spark, folder).collect()
    assert sorted(ran) == sorted(last)


def test_stages_of_awkward_rows(spark, corpus, edge):
    """Every stage takes nulls, repeated rows and extra columns, and an empty table."""
    folder = corpus[0]
    frame = edge.select("doc_id", "text", F.lit("en").alias("lang"), "source", F.length("text").cast("long").alias("n_chars"), F.lit(1).alias("removed"), F.lit("x").alias("node"), F.lit(-1).alias("n_words"))
    for some in (frame, frame.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            made = stage(spark, some, folder)
            assert made.columns == frame.columns
            rows = made.collect()
            assert len(rows) <= len(EDGE)
            assert all((r.removed, r.node, r.n_words) == (1, "x", -1) for r in rows)
        assert corpus_pipeline.STAGES[-1][1](spark, some, folder).count() == some.count()


def test_rejected_documents_stay_out(spark):
    frame = texts_frame(spark, ["a b c", "one two three four five six seven eight nine ten"])
    assert [r.kept for r in judged(frame, DecisionList()).orderBy("doc_id").collect()] == [False, True]
