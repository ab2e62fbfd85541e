"""Operators that judge each row by itself, against plain Python."""

from __future__ import annotations

import base64
import datetime
import hashlib
import json
import random
import re
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from helixlake.llm import bpe, chat, html, licenses, pii, quality, secrets
from helixlake.llm.common import match_spans, running_sums

from .conftest import EDGE

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def texts_frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


# --- helpers


def test_running_sums(spark):
    for n in (0, 1, 2, 9, 10, 11, 37):
        values = list(range(1, n + 1))
        row = spark.createDataFrame([(values,)], "v array<bigint>").select(running_sums(F.col("v"), 5).alias("s")).first()
        assert row.s == [sum(values[: k + 1]) for k in range(n)]


def test_match_spans(spark):
    texts = ["", "ab12cd345", "12", "x12\U0001f60034\n5", "no digits"]
    rows = texts_frame(spark, texts).select("text", match_spans(F.col("text"), r"\d+").alias("s")).collect()
    assert all([(s.start, s.end, s.value) for s in r.s] == [(m.start(), m.end(), m[0]) for m in re.finditer(r"\d+", r.text)] for r in rows)


# --- byte-level BPE


def test_bpe_pieces_encode_as_the_whole():
    enc, rng = bpe.encoding(RANKS, PATTERN), random.Random(0)
    alphabet = ["a", "Bc", "é", "中", "1", "23", " ", "  ", "\n", "\t", "!", "'s", "'", "'ll", "...", "́", "\U0001f600", " x", " "]
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 80)))
        for size in (1, 3, 10):
            assert "".join(bpe.pieces(text, size)) == text
            assert bpe.encode(text, enc, size).tolist() == enc.encode_ordinary(text), text


def test_bpe_round_trip(spark, edge):
    coded = bpe.decode_column(bpe.encode_column(edge, RANKS, PATTERN), RANKS, PATTERN, output="decoded")
    rows = coded.select("text", "ids", "decoded").collect()
    assert len(rows) == len(EDGE)
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in rows)
    made = bpe.digests(edge, RANKS, PATTERN).collect()
    for r in made:
        ids = bpe.encoding(RANKS, PATTERN).encode_ordinary(r.text or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_bpe_long_runs():
    enc = bpe.encoding(RANKS, PATTERN)
    for text in ("a" * 300_000, " " * 300_000 + "x", "ab1" * 100_000, "!" * 200_000, " " * 5_000_000 + "x", "y" + "\n" * 5_000_000, "\n" * 1_500_000 + "z \n" * 40_000):
        assert enc.decode(bpe.encode(text, enc).tolist()) == text


def test_bpe_of_long_white_space(monkeypatch):
    """Runs that are cut out encode as the library encodes the whole text."""
    monkeypatch.setattr(bpe, "LONG_SPACES", bpe.regex.compile(bpe.LONG_SPACES.pattern.replace("4096", "3")))
    enc, rng = bpe.encoding(RANKS, PATTERN), random.Random(5)
    for _ in range(400):
        text = "".join(rng.choice([" " * rng.randrange(9), "\n" * rng.randrange(6), "\t ", "a", "!", "1", "\u3000\u3000", "\x1c\x1c\x1c\x1c"]) for _ in range(rng.randrange(12)))
        assert bpe.encode(text, enc, 2).tolist() == enc.encode_ordinary(text), text


# --- chat formatting


TURNS = [
    ("user", "\\### Assistant: </turn> ok"),
    ("assistant", "\\### Assistant: </turn> ok"),
    ("assistant", ""),
    ("system\nodd: <role>#", "\\l\\s\\h\\ <turn>\n### user\n"),
    ("", "中文 \U0001f600 \\\\"),
    ("assistant", "last\n"),
]


def test_chat_template_is_reversible(spark):
    frame = spark.createDataFrame([(1, TURNS), (2, [])], "id int, turns array<struct<role:string,text:string>>")
    rows = chat.render(frame).withColumn("back", chat.parse(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).orderBy("id").collect()
    assert [tuple(t) for t in rows[0].back] == TURNS
    assert rows[0].loss == "".join(t for r, t in TURNS if r == "assistant")
    assert len(rows[0].loss_spans) == 3
    assert "".join(rows[0].formatted[s.start : s.end] for s in rows[0].loss_spans).count("<") == 0
    assert (rows[1].formatted, rows[1].back, rows[1].loss) == ("", [], "")


def test_chat_layouts(spark):
    records = [
        ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, "messages", [("user", "q"), ("assistant", "a")]),
        ({"messages": [{"content": "q", "role": "user"}]}, "messages", [("user", "q")]),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": None}]}, "conversations", [("user", "q"), ("assistant", "")]),
        ({"response": "a", "prompt": "q"}, "prompt_response", [("user", "q"), ("assistant", "a")]),
        ({"prompt": "q", "completion": "a"}, "prompt_completion", [("user", "q"), ("assistant", "a")]),
        ({"instruction": "i", "input": "", "output": "o"}, "instruction_input", [("system", "i"), ("assistant", "o")]),
        ({"instruction": "i", "output": "o"}, "instruction", [("user", "i"), ("assistant", "o")]),
        ({"question": "q", "answer": "a"}, "question_answer", [("user", "q"), ("assistant", "a")]),
        ({"id": "x7", "conversations": [{"from": "human", "value": "q", "weight": 1}, {"from": "gpt", "value": "a"}]}, "conversations", [("user", "q"), ("assistant", "a")]),
        ({"instruction": "i", "input": "in", "output": "o", "text": "all of it"}, "instruction_input", [("system", "i"), ("user", "in"), ("assistant", "o")]),
        ({"messages": ["odd", {"name": "n"}, {"role": "user", "content": "q", "name": "n"}], "meta": {"a": 1}}, "messages", [("", ""), ("user", "q")]),
        ({"messages": ["odd"]}, None, []),
        ({"something": "else"}, None, []),
    ]
    rows = [(k, json.dumps(r)) for k, (r, _, _) in enumerate(records)] + [(97, "not json"), (98, None), (99, "{}")]
    found = chat.canonical_json(spark.createDataFrame(rows, "id int, record string"), "record").orderBy("id").collect()
    for r, (_, layout, turns) in zip(found, records):
        assert (r.layout, [tuple(t) for t in r.turns]) == (layout, turns)
    assert [(r.layout, r.turns) for r in found[-3:]] == [(None, [])] * 3


def test_chat_fingerprints(spark):
    """The hash that the plan knows is the one that rows get."""
    for m in (*chat.MAPPINGS, *chat.TURN_TABLES):
        row = spark.range(1).select(chat.fingerprint(F.array(*[F.lit(p) for p in m.paths])).alias("h")).first()
        assert row.h & (1 << 64) - 1 == chat.fingerprint_of(reversed(m.paths))
    assert len({chat.fingerprint_of(m.paths) for m in (*chat.MAPPINGS, *chat.TURN_TABLES)}) == len(chat.MAPPINGS) + len(chat.TURN_TABLES)


def test_chat_of_many_turns(spark):
    turns = [("user" if k % 2 else "assistant", f"said {k}") for k in range(20_000)]
    frame = spark.createDataFrame([(1, turns, "mine")], "id int, turns array<struct<role:string,text:string>>, made string")
    row = chat.render(frame).withColumn("back", chat.parse(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).first()
    assert [tuple(t) for t in row.back] == turns
    assert row.loss == "".join(t for r, t in turns if r == "assistant")
    assert row.made == "mine"


def test_chat_turn_tables(spark):
    rows = [(1, 1, "assistant", "b", 0), (1, 0, "user", "a", 0), (None, 0, None, None, 0), (2, 0, "user", "x", 0), (2, 0, "user", "x", 0), (2, None, "system", "first", 0)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int")
    found = {r.conv_id: [tuple(t) for t in r.turns] for r in chat.canonical_rows(frame).collect()}
    assert found == {1: [("user", "a"), ("assistant", "b")], None: [("", "")], 2: [("system", "first"), ("user", "x"), ("user", "x")]}
    assert chat.canonical_rows(frame.limit(0)).collect() == []
    other = spark.createDataFrame([(1, 0, "user", "a")], "conversation_id long, turn_id long, role string, content string")
    assert chat.canonical_rows(other).first().turns[0].text == "a"
    with pytest.raises(ValueError, match="no mapping"):
        chat.canonical_rows(spark.createDataFrame([(1,)], "x int"))


# --- HTML


PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><header>Site</header>'
    '<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy</div><div class="cookie-notice">Cookies</div>'
    "<article><h1>Head &amp; tail&nbsp;x</h1><p><b>One<br>two \n three<p>Four &lt;five&gt; &#233;&copy</p><ul><li>i<li>ii</ul>"
    '<form><p>Mail me</p></form><aside>Side</aside><div class="comments"><p>A comment</p></div><table><tr><td>c1<td>c2</table></article>'
    '<div id="sidebar">More</div><footer>&copy; me</footer></body></html>'
)


def test_html_extraction(spark):
    expected = "Head & tail x\nOne two three\nFour <five> é©\ni\nii\nc1\nc2"
    assert html.extract(PAGE, None) == expected
    divs = '<body><div class="menu">m</div><div class="post-12"><p>A long paragraph of the text.</p><p>Another one of it.</p></div><div class="x">tiny</div>'
    assert html.extract(divs, None) == "A long paragraph of the text.\nAnother one of it."
    for source in ("", "<", "plain", "<p", "<article><p>cut of", "<!-- never closed <p>x</p>", "</div></p>", "<div><nav>n"):
        html.extract(source, None)
    assert html.extract("<article><p>cut of", None) == "cut of"
    assert html.extract("<p>only a block", None) == "only a block"


def test_html_keeps_all_parts():
    one, two = "first part " * 200, "second part " * 130
    parts = f"<body><div class=content><h1>Head</h1><section>{one}</section><section class=b>{two}</section></div></body>"
    assert html.extract(parts, None) == f"Head\n{one.strip()}\n{two.strip()}"
    assert "long article" in html.extract("<h1>T</h1><p>a long article</p><div>x</div>", None)
    for inner in (f"<article><p>{one}</p></article>", f"<p>{one}</p>"):
        page = f'<body><div class="layout sidebar">{inner}<div class="sidebar">side</div></div><div class="footer">f</div></body>'
        assert html.extract(page, None) == one.strip()
    replies = f'<body><article>The text</article><div class="comments"><article>{one}</article></div></body>'
    assert html.extract(replies, None) == "The text"


def test_html_classes_about_others():
    """Words of a class that name other parts, or the article's own subject, drop nothing."""
    text, more = "A paragraph of the article. " * 20, "What others have done before. " * 10
    for open_, close in (('<main class="content no-sidebar">', "</main>"), ('<article class="post has-comments">', "</article>"), ('<div class="login-page post">', "</div>")):
        page = f'<body>{open_}<p>{text}</p><div class="related-work"><p>{more}</p></div><div class="related-posts">more posts</div>{close}<div class="footer">the footer</div></body>'
        assert html.extract(page, None) == f"{text.strip()}\n{more.strip()}"


def test_html_of_great_depth():
    for tag in ("div", "span", "b", "p", "li"):
        deep = f"<{tag}>" * 100_000
        assert html.extract(f"<article>{deep}the text", None) == "the text"
        assert html.extract(f"<body>{deep}the text" + f"</{tag}></i>" * 100_000, None) == "the text"


def made_page(rng):
    """A page and its article: brute force writes down what the article says as it makes the markup."""
    said = []

    def prose(n):
        return " ".join(rng.choice(["text", "of", "an", "article", "x", "&amp;", "&#233;", "long-word"]) for _ in range(n))

    def block(tag, n):
        text = prose(n)
        said.append(text.replace("&amp;", "&").replace("&#233;", "é"))
        return f"<{tag}>{text}</{tag}>"

    body = block("h1", 5) + "".join(block(rng.choice(["p", "p", "blockquote", "h2", "pre"]), rng.randrange(20, 60)) + rng.choice(["", "<script>var x = 1;</script>", "<!-- no -->", f'<div class="ad-box">{prose(4)}</div>', f"<aside>{prose(9)}</aside>"]) for _ in range(rng.randrange(3, 9)))
    around = rng.choice([("<article>", "</article>"), ('<div class="post-body">', "</div>"), ('<main><section class="s1">', "</section></main>")])
    before = rng.choice(["", f"<header>{prose(5)}</header>", f'<nav><a href="/">{prose(3)}</a></nav>', f'<div class="cookie-notice">{prose(20)}</div>'])
    after = rng.choice(["", f"<footer>{prose(8)}</footer>", f'<div id="sidebar"><ul><li><a>{prose(4)}</a></ul></div>', f'<div class="comments"><p>{prose(30)}</p></div>'])
    return f"<html><head><title>{prose(3)}</title></head><body>{before}{around[0]}{body}{around[1]}{after}</body></html>", "\n".join(said)


def test_html_against_made_pages(spark):
    rng = random.Random(11)
    pages = [(k, f"http://h{k % 3}.example/{k}", *made_page(rng)) for k in range(200)]
    frame = spark.createDataFrame([(k, url, source, "x", "y", "z") for k, url, source, _ in pages], "page_id long, url string, html string, path string, host string, row string")
    rows = html.main_text(frame).collect()
    assert {r.page_id: r.text for r in rows} == {k: text for k, _, _, text in pages}
    assert {(r.path, r.host, r.row) for r in rows} == {("x", "y", "z")}


def test_html_hosts_vote(spark):
    usual = '<body><div class="main-12"><p>The text of the page is this, a whole line of it.</p></div><div class="extra"><p>{}</p></div></body>'
    rows = [(k, "http://H.example/a?b", usual.format("x")) for k in range(5)]
    rows += [(9, "http://h.example/c", usual.format("an extra part that is far longer than the text of this page, so that it wins by itself " * 3))]
    rows += [(10, None, None), (11, "http://h.example/", ""), (12, "ftp//bad", "<article>a</article>")]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, path string")
    found = {r.page_id: r.text for r in html.main_text(frame).collect()}
    assert len(found) == len(rows)
    assert found[9] == "The text of the page is this, a whole line of it."
    assert (found[10], found[11], found[12]) == ("", "", "a")
    shuffled, html.BROADCAST_HOSTS = html.BROADCAST_HOSTS, -1
    try:
        assert {r.page_id: r.text for r in html.main_text(frame).collect()} == found
    finally:
        html.BROADCAST_HOSTS = shuffled
    assert html.main_text(frame.limit(0)).collect() == []


# --- secrets


def brute_secrets(text):
    out = []
    for no, rule in enumerate(secrets.RULES):
        for m in re.finditer(rule.pattern, text or ""):
            if len(m[rule.group]) >= rule.least:
                out.append((m.start(), no, m.end(), rule.kind))
    return sorted(out)


def made_secrets(rng):
    parts = ["token", "Secret", "apikey", "API_KEY", "pass", "passwd", "=", ":", " = ", '"', "'", "abcdef0123456789", "AKIA", "ABCDEFGH12345678", "ghp_" + "a1B2" * 9, "eyJhbGciOiJ", "eyJhbGciOiJIUzI1.eyJzdWIiOiIx.abcdefghijk", " ", "\n", "é", "\U0001f600", "deadbeefdeadbeef",
             "-----BEGIN RSA PRIVATE KEY-----", "xoxb-1234567890-abc", "sk_live_" + "x" * 20, "AIza" + "b" * 35, "KEY", "x"]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))


def test_secrets_against_brute_force(spark):
    rng = random.Random(7)
    texts = [made_secrets(rng) for _ in range(400)] + ["secret=token:abcdefghijklmnop", "token=short token=abcdefghijkl"]
    rows = secrets.scan(texts_frame(spark, texts)).collect()
    assert len(rows) == len(texts)
    assert all([tuple(s) for s in r.spans] == brute_secrets(texts[r.doc_id]) for r in rows)
    assert sum(len(r.spans) for r in rows) > 300


def test_trigram_queries_are_sound():
    rng = random.Random(3)
    queries = {r.kind: secrets.trigram_query(r.pattern) for r in secrets.RULES}
    assert queries["hex"] == secrets.ALWAYS
    assert all(q != secrets.ALWAYS for k, q in queries.items() if k != "hex")
    for _ in range(3000):
        text = made_secrets(rng)
        for rule in secrets.RULES:
            if re.search(rule.pattern, text):
                assert any(all(t in text.lower() for t in clause) for clause in queries[rule.kind])
    assert secrets.trigram_query("ab?cde") == frozenset({frozenset({"abc", "bcd", "cde"}), frozenset({"acd", "cde"})})
    assert secrets.trigram_query("(foo|x)bar+") == frozenset({frozenset({"foo", "oob", "oba"}), frozenset({"xba"})})
    assert secrets.trigram_query("a.c") == secrets.ALWAYS


def test_secrets_edges(spark, edge, empty):
    assert secrets.scan(edge).count() == len(EDGE)
    assert secrets.scan(empty).collect() == []
    assert secrets.scan(texts_frame(spark, ["deadbeefdeadbeef"]), (secrets.BASE_RULES[2],)).first().spans[0].kind == "hex"


# --- licences


def brute_licences(text):
    ws = [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").lower()) if w]
    out = []
    for no, t in enumerate(licenses.TEMPLATES):
        for p in range(len(ws) - len(t.key_words) + 1):
            if ws[p : p + len(t.key_words)] == t.key_words:
                agree = sum(0 <= p - t.start + i < len(ws) and ws[p - t.start + i] == w for i, w in enumerate(t.words))
                if agree / len(t.words) >= licenses.AGREES:
                    out.append((p, no, agree / len(t.words)))
    return len(ws), sorted(out)


def test_licences_against_brute_force(spark):
    rng = random.Random(2)
    texts = ["CC BY-NC 4.0", "mit", "Under the MIT License, under THE mit-license", "apache license, version 2", "cc by by nc cc by nc"]
    for t in licenses.NOTICES:
        texts.append(f"Before it. {t.text.upper()} after it")
        ws = t.words
        for _ in range(6):
            texts.append(" ".join(w if rng.random() < 0.85 else rng.choice(["the", "license", "zzz", ""]) for w in ws[rng.randrange(3) :]))
    rows = licenses.scan(texts_frame(spark, texts)).collect()
    for r in rows:
        n, hits = brute_licences(texts[r.doc_id])
        assert r.n_words == n
        assert sorted((h.start, h.no, round(h.score, 9)) for h in r.hits) == [(p, no, round(s, 9)) for p, no, s in hits], texts[r.doc_id]
    assert sum(len(r.hits) > 0 for r in rows) > 20


def test_licences_edges(spark, edge, empty):
    assert licenses.scan(edge).count() == len(EDGE)
    assert licenses.scan(empty).collect() == []


# --- quality


def brute_statistics(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    count, covered, seen, dup = Counter(grams), set(), set(), 0
    for k, g in enumerate(grams):
        if count[g] > 1:
            covered |= set(range(k, k + 5))
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_statistics_against_brute_force(spark, edge, empty):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a ", "b ", "c\n", "a b a b a ", "x#| ", "\t", "\n", "a b "]) for _ in range(rng.randrange(60))) for _ in range(150)]
    for r in quality.statistics(texts_frame(spark, texts)).collect() + quality.statistics(edge.where("doc_id <> 5 OR doc_id IS NULL")).collect():
        assert tuple(r[n] for n in NAMES) == brute_statistics(r.text)
    long_row = quality.statistics(edge.where("doc_id = 5")).first()
    assert tuple(long_row[n] for n in NAMES) == brute_statistics(long_row.text)
    assert quality.statistics(empty).collect() == []


def test_decision_list_holds_out(spark):
    """Learned on half of the labels, the rules judge the other half."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    docs, labels = [], []
    for k in range(400):
        bad = k % 4 == 0
        text = " ".join(rng.choice(words) + ("###" if bad and rng.random() < 0.7 else "") for _ in range(60))
        if k % 8 == 0:
            text = " ".join(rng.choice(words) + "!!" for _ in range(60)).upper()
        docs.append((k, text))
        if k % 2 or k % 16 < 8:
            labels.append((k, int(not bad)))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (3, None), (1, 1)], "doc_id long, quality int")
    rules = quality.fit(docs, labels)
    assert rules.rules
    kept = {r.doc_id: r.kept for r in quality.judged(docs, rules).collect()}
    held = [k for k in range(400) if not (k % 2 or k % 16 < 8)]
    assert sum(kept[k] == bool(k % 4) for k in held) / len(held) > 0.95
    assert all(kept[k] for k in range(400) if k % 4)
    assert "reject if" in str(rules)
    none = quality.fit(docs, labels.limit(0))
    assert none.rules == ()
    assert quality.judged(docs, none).where("kept").count() == 400


def test_base_rules(spark, edge):
    kept = {(r.doc_id, r.text and r.text[:5]): (r.base_failed, r.kept) for r in quality.judged(edge, quality.DecisionList()).collect()}
    assert kept[2, None] == (True, False)
    assert kept[5, "word "] == (True, False)


# --- personal data


def luhn(digits):
    total = 0
    for k, ch in enumerate(reversed(digits)):
        d = int(ch) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


VALUES = {
    "card": ["4041894974608795", "4041-8949-7460-8795", "4041 8949 7460 8795", "378282246310005"],
    "phone": ["+1 (988) 555-2485", "+1-988-555-2485", "+49 30 901820", "+44 20 7946 0958"],
    "ip": ["70.123.182.155", "8.8.8.8", "255.255.255.255", "0.0.0.0"],
    "date": ["1985-02-28", "28.02.1985", "02/28/1985", "31/12/1999", "29/02/2000", "2000-02-29"],
    "ssn": ["123-45-6789", "899-99-9999", "665-01-0001", "667-01-0001"],
    "iban": ["DE89370400440532013000", "GB82WEST12345698765432"],
    "email": ["Bosbt.42@mail8.example.com", "a@b.co", "x_y+z@example.org"],
}
INVALID = ["4041894974608796", "999.1.1.1", "1.2.3.4.5", "2023-02-30", "000-12-3456", "666-12-3456", "123-00-4567", "XX00ABCDEFGHIJKLM", "1699-12-31", "+12", "plain 12345"]


def test_pseudonyms(spark):
    texts = [f"say {v}. Then" for vs in VALUES.values() for v in vs] + [f"say {v} then" for v in INVALID] + [None, ""]
    frame = texts_frame(spark, texts)
    rows = pii.pseudonymised(frame, "key").orderBy("doc_id").collect()
    at = 0
    for kind, values in VALUES.items():
        for v in values:
            r = rows[at]
            at += 1
            assert [f.kind for f in r.found] == [kind], v
            new = r.found[0].new
            assert r.text == f"say {new}. Then"
            assert re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "9", new))) == re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "9", v))) or kind == "ip"
            if kind == "card":
                assert luhn(re.sub(r"\D", "", new))
            if kind == "ip":
                assert all(0 <= int(o) <= 255 for o in new.split("."))
            if kind == "date" and new[4] == "-":
                datetime.date.fromisoformat(new)
            if kind == "iban":
                moved = "".join(str(int(ch, 36)) for ch in new[4:] + new[:4])
                assert int(moved) % 97 == 1
            if kind == "ssn":
                assert new[:3] not in ("000", "666")
                assert new[0] != "9"
    assert all(r.text == texts[r.doc_id] and not r.found for r in rows[at:])
    back = pii.pseudonymised(spark.createDataFrame([(r.doc_id, r.text) for r in rows], "doc_id long, text string"), "key", undo=True)
    assert {r.doc_id: r.text for r in back.collect()} == dict(enumerate(texts))
    digits = {re.sub(r"\D", "", rows[k].found[0].new) for k in range(3)}
    assert len(digits) == 1  # one card, three spellings
    other = pii.pseudonymised(frame, "another key").orderBy("doc_id").collect()
    assert sum(a.text != b.text for a, b in zip(rows, other)) > 20


def test_pseudonyms_of_adjacent_values(spark):
    """No value hides the one beside it, and the way back finds the same ones."""
    values = {k: vs if k in ("card", "phone") else vs[:1] for k, vs in VALUES.items()}
    values["phone"] = [*values["phone"], "+1 (826) 555-4081", "+49 (0)30-1234 567"]
    values["card"] = [*values["card"], "3782 822463 10005", "41111111 11111111"]
    one = [(k, v) for k, vs in values.items() for v in vs]
    cases = [(f"{a}{sep}{b}", [(ka, a), (kb, b)]) for ka, a in one for kb, b in one for sep in (" ", ", ", "\n")]
    shorts = ["card 4111111111111111 12/27", "4111 1111 1111 1111 1", "4111 1111 1111 1111 123", "12 4111111111111111", "1234 4111 1111 1111 1111", "7 3782 822463 10005 9", "4111-1111 1111-1111 12/27"]
    cards = ["4111111111111111", "4111 1111 1111 1111", "4111 1111 1111 1111", "4111111111111111", "4111 1111 1111 1111", "3782 822463 10005", "4111-1111 1111-1111"]
    cases += [(t, [("card", v)]) for t, v in zip(shorts, cards, strict=True)]
    cases.append(("x 6011 0000 0000 0000 02 y", None))
    cases += [(f"{'1234 ' * n}4111 1111 1111 1111 5555 5555 5555 4444{' 1234' * n}", None) for n in range(9)]
    cases.append(("+1 (826) 555-4081 190.137.223.204", [("phone", "+1 (826) 555-4081"), ("ip", "190.137.223.204")]))
    rows = pii.pseudonymised(texts_frame(spark, [t for t, _ in cases]), "key").orderBy("doc_id").collect()
    for (text, expected), r in zip(cases, rows, strict=True):
        assert expected is None or [(f.kind, f.old) for f in r.found] == expected, (text, r.found)
    back = pii.pseudonymised(spark.createDataFrame([(r.doc_id, r.text) for r in rows], "doc_id long, text string"), "key", undo=True)
    assert {r.doc_id: r.text for r in back.collect()} == {k: t for k, (t, _) in enumerate(cases)}


def test_pseudonyms_of_number_tables_come_back(spark):
    """Many groups by chance: what is taken for a card must be the same on the way back."""
    rng = random.Random(8)
    made = ["".join(str(rng.randrange(10)) if ch == "9" else ch for ch in rng.choice(["9999 ", "99 ", "9999-", "999 "]) * rng.randrange(4, 40)) for _ in range(300)]
    rows = pii.pseudonymised(texts_frame(spark, made), "key").collect()
    assert sum(len(r.found) for r in rows) > 100
    back = pii.pseudonymised(spark.createDataFrame([(r.doc_id, r.text) for r in rows], "doc_id long, text string"), "key", undo=True)
    assert {r.doc_id: r.text for r in back.collect()} == dict(enumerate(made))


def test_pseudonyms_are_permutations(spark):
    """Small domains are covered once."""
    pairs = spark.range(7 * 11).select((F.col("id") % 7).alias("x"), F.floor(F.col("id") / 7).alias("y"))
    seen = pairs.select(pii.permuted(F.col("x"), F.col("y"), 7, 11, "k", "t").alias("p")).select("p.*").collect()
    assert {(r.x, r.y) for r in seen} == {(x, y) for x in range(7) for y in range(11)}
    names = spark.range(26 * 10).select(F.concat(F.char(F.col("id").cast("int") % 26 + 97), F.floor(F.col("id") / 26).cast("string")).alias("v"))
    assert names.select(pii._letters(F.col("v"), "k", "t", False).alias("w")).distinct().count() == 260


def test_pseudonyms_edges(edge, empty):
    rows = pii.pseudonymised(edge, "k").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in rows) == sorted((d or 0, t or "") for d, t, _ in EDGE)
    assert pii.pseudonymised(empty, "k").collect() == []


def test_rank_file_is_read_as_given():
    with open(RANKS, "rb") as lines:
        token, rank = next(lines).split()
    assert bpe.encoding(RANKS, PATTERN).decode_bytes([int(rank)]) == base64.b64decode(token)
