"""Main text of awkward pages; columns whose names clash; decision lists of few labels, grown and pruned by brute force."""

from __future__ import annotations

import math
import random
import time
from itertools import product

import corpus_pipeline
from helixlake.llm import html, pii, quality

STORY = " ".join(["words of the story"] * 150)


def test_a_path_that_holds_little_of_a_page():
    """The host's path is taken where it holds a fair share of the article, else the page's own container."""
    usual = f'<body><div class="content"><p>{STORY}</p></div></body>'
    path = html.best(html.parse(usual))[0]
    assert html.extract(usual, path) == STORY
    odd = f'<body><div class="content"><p>short box text</p></div><div class="story"><p>{STORY}</p></div></body>'
    assert html.extract(odd, path) == STORY
    assert html.extract('<body><div class="content"><p>short</p></div><div class="x"><p>less</p></div></body>', path) == "short"


def test_class_words_inside_an_article():
    kept = f'<h1>T</h1><p>{STORY}</p><pre><span class="comment">a note</span> code</pre><p class="notice">n</p><blockquote class="reply">b</blockquote><figure class="banner"><figcaption>f</figcaption></figure>'
    page = f'<body><article>{kept}<label>l</label><div class="comments"><p>a reader</p></div><ul class="share"><li>send</li></ul></article></body>'
    assert html.extract(page, None).split("\n") == ["T", STORY, "a note code", "n", "b", "f", "l"]
    plain = f'<body><div class="story"><p>{STORY}</p><p>see <span class="ad">this</span></p></div><p class="notice">we use</p><label>l</label></body>'
    assert html.extract(plain, None).split("\n") == [STORY, "see this"]


def test_edges_of_a_page():
    page = '<body><div class="header">Brand</div><div id="top">Up</div><div class="site-header">Us</div><main><div class="header"><h1>T</h1></div><p>{}</p></main><div class="copyright">(c)</div></body>'
    assert html.extract(page.format(STORY), None).split("\n") == ["T", STORY]
    around = f'<body><div id="top"><div class="x"><p>{STORY}</p></div></div></body>'
    assert html.extract(around, None) == STORY


def test_marked_elements_around_each_other():
    start = time.time()
    for n in (3, 60_000):
        assert html.extract('<div class="ad">' * n + f"<article><p>{STORY}</p></article>" + "</div>" * n, None) == STORY
        assert html.extract('<div class="ad">' * n + f"<p>{STORY}</p>" + "</div>" * n, None) == STORY
    assert time.time() - start < 60


def test_deep_containers_count():
    deep = "<div>" * 9 + f"<p>{STORY}</p>" + "</div>" * 9
    page = f'<body><div class="a"><p>some other text</p></div><div class="b">{deep}</div></body>'
    assert STORY in html.extract(page, None)


def test_pii_keeps_columns_whose_names_clash(spark):
    rows = spark.createDataFrame([(1, "mail bob@example.org now", "mine", 7), (2, None, None, 8)], "doc_id long, text string, _pii string, found int")
    made = pii.pseudonymised(rows, "key")
    assert made.columns == ["doc_id", "text", "_pii", "found"]
    got = {r["doc_id"]: r for r in made.collect()}
    assert got[1]["_pii"] == "mine" and got[2]["_pii"] is None and got[1]["found"][0]["kind"] == "email"
    back = pii.pseudonymised(made.select("doc_id", "text"), "key", undo=True).where("doc_id = 1").first()
    assert back["text"] == "mail bob@example.org now"


def test_line_dedup_stage_keeps_columns_whose_names_clash(spark):
    text = "a line of some words that is long enough here\nanother line of quite other words than that one"
    rows = spark.createDataFrame([(1, text, "x", 3), (2, text, "y", 4)], "doc_id long, text string, _cut string, _CUT_ int")
    got = corpus_pipeline.line_dedup(spark, rows, "")
    assert got.columns == rows.columns
    assert sorted((r["doc_id"], r["_cut"], r["_CUT_"], r["text"] == text) for r in got.collect()) == [(1, "x", 3, True), (2, "y", 4, False)]


def made_cells(seed, n=60):
    rng = random.Random(seed)
    grid = {"a": (0.0, 1.0, 2.0, 3.0), "b": (0.0, 5.0), "c": (1.0, 2.0, 4.0)}
    out = []
    for values in product(*grid.values()):
        row = dict(zip(grid, values))
        for grow in (True, False):
            bad = row["a"] >= 2 and row["c"] < 4
            for verdict in ("reject", "keep"):
                k = rng.randrange(6) if (verdict == "reject") == bad else rng.randrange(2) * (rng.random() < 0.2)
                if k:
                    out.append(quality.Cell(row, grow, verdict, k))
    return out, grid


def test_growing_and_pruning_against_brute_force():
    for seed in range(8):
        some, grid = made_cells(seed)
        grow = [c for c in some if c.grow]
        rule = quality._grown(grow, grid, "reject")
        left, chosen = grow, ()
        while True:
            count = lambda cs: (sum(c.n for c in cs if c.verdict == "reject"), sum(c.n for c in cs if c.verdict != "reject"))
            p, n = count(left)
            if not p or not n:
                break
            gains = {}
            for name, steps in grid.items():
                for t, above in product(steps, (True, False)):
                    p1, n1 = count([c for c in left if (c.values[name] >= t) == above])
                    gains[name, t, above] = p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p / (p + n))) if p1 else 0.0
            if max(gains.values()) <= 1e-9:
                break
            step = rule[len(chosen)]
            assert gains[step.feature, step.threshold, step.above] >= max(gains.values()) - 1e-8
            chosen = (*chosen, step)
            left = [c for c in left if step.holds(c.values)]
        assert chosen == rule
        prune = [c for c in some if not c.grow]
        cut = quality._pruned(prune, "reject", rule)
        value = lambda k: (lambda p, n: (p - n) / (p + n) if p + n else -1.0)(*quality._counts(prune, "reject", rule[:k]))
        assert cut == rule[: len(cut)] and value(len(cut)) == max(value(k) for k in range(1, len(rule) + 1))


def test_lists_of_few_labels():
    """A few texts are enough where the rule is pure, and not where they contradict each other."""
    grid = {"a": (0.0, 1.0)}
    cell = lambda a, grow, verdict, n: quality.Cell({"a": a}, grow, verdict, n)
    clean = [cell(0.0, True, "keep", 30), cell(0.0, False, "keep", 15)]
    pure = [*clean, cell(1.0, True, "reject", 7), cell(1.0, False, "reject", 3)]
    assert [str(r) for r in quality.learn(pure, grid).rules] == ["reject if a >= 1"]
    two = [*clean, cell(1.0, True, "reject", 7), cell(1.0, False, "reject", 2)]
    mixed = [*pure, cell(1.0, False, "keep", 1)]
    assert quality.learn(two, grid).rules == () == quality.learn(mixed, grid).rules
    many = [*pure, cell(1.0, False, "reject", 30), cell(1.0, False, "keep", 1)]
    assert len(quality.learn(many, grid).rules) == 1
