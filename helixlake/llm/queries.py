"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.llm import bpe, chat, collocations, decontam, html, licenses, linedup, omh, periods, pii, quality, secrets, setjoin
from helixlake.llm.common import let, positions, table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return omh.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    gone = linedup.removed_lines(docs).groupBy("doc_id", "copy").agg(F.sort_array(F.collect_list("line_no")).alias("removed"))
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("copy").alias("_copy"), "removed")
    lines = docs.select("doc_id", linedup.copy_of(docs).alias("copy"), F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"))
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return lines.join(gone, lines["doc_id"].eqNullSafe(gone["_id"]) & (lines["copy"] == gone["_copy"]), "left").select(
        "doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), F.array_join(removed.cast("array<string>"), ",").alias("removed_lines")
    )


OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, p - 1 AS line_no, list_distinct(list_filter(string_split_regex(l, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS ws
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS p FROM documents)),
numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id, line_no) AS r, len(ws) AS n FROM lines WHERE len(ws) > 0),
tokens AS (SELECT r, n, unnest(ws) AS w FROM numbered),
freq AS (SELECT w, count(*) AS f FROM tokens GROUP BY w),
ranked AS (SELECT r, n, w, row_number() OVER (PARTITION BY r ORDER BY f, w) AS i FROM tokens JOIN freq USING (w)),
prefix AS (SELECT * FROM ranked WHERE i <= n - ceil(4 * n / 5.0) + 1),
pairs AS (SELECT DISTINCT x.r AS x, y.r AS y FROM prefix x JOIN prefix y ON x.w = y.w AND y.r < x.r AND 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n)),
gone AS (SELECT DISTINCT x FROM pairs JOIN numbered a ON a.r = x JOIN numbered b ON b.r = y
  WHERE 9 * len(list_intersect(a.ws, b.ws)) >= 4 * (a.n + b.n)),
per AS (SELECT doc_id, count(*) AS n_removed, string_agg(line_no, ',' ORDER BY line_no) AS removed_lines FROM gone JOIN numbered ON r = x GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(removed_lines, '') AS removed_lines
FROM documents d LEFT JOIN per USING (doc_id)
"""


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = len(licenses.BASE)
    split = found.select("doc_id", "n_words", "hits", F.filter("hits", lambda h: h["no"] < n).alias("base"))
    starts = F.transform("base", lambda h: h["start"])
    return split.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        licenses.labels(F.col("base"), licenses.TEMPLATES).alias("base_labels"),
        licenses.labels(F.col("hits"), licenses.TEMPLATES).alias("labels"),
        F.coalesce(F.array_max(F.transform("hits", lambda h: h["score"])), F.lit(0.0)).alias("score"),
    )


def _template_sql() -> str:
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    return ", ".join(
        f"({no}, '{t.label}', {str(t.base).lower()}, {quoted(t.words)}, {quoted(t.key_words)}, {t.start})" for no, t in enumerate(licenses.TEMPLATES)
    )


OP3_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS copy, doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS ws FROM documents),
templates(no, label, base, words, key, before) AS (VALUES {_template_sql()}),
places AS (SELECT copy, unnest(ws) AS w, unnest(range(0, len(ws))) AS p FROM docs),
starts AS (SELECT DISTINCT d.copy, d.ws, t.no, t.label, t.base, t.words, t.before, places.p
  FROM places JOIN templates t ON places.w = t.key[1] JOIN docs d USING (copy) WHERE d.ws[p + 1 : p + len(t.key)] = t.key),
scored AS (SELECT *, len(list_filter(range(1, len(words) + 1), lambda i: p - before + i >= 1 AND ws[p - before + i] = words[i])) / len(words)::DOUBLE AS score
  FROM starts),
hits AS (SELECT * FROM scored WHERE score >= {licenses.AGREES}),
per AS (SELECT copy, count(*) FILTER (base) AS n_base, min(p) FILTER (base) AS first_word, max(p) FILTER (base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
  max(score) AS score FROM hits GROUP BY copy)
SELECT d.doc_id, len(d.ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score FROM docs d LEFT JOIN per USING (copy)
"""


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = [secrets.n_spans(F.col("spans"), r.kind).alias(f"n_{r.kind}") for r in secrets.BASE_RULES]
    base = F.filter("spans", lambda s: s["no"] < len(secrets.BASE_RULES))
    return found.select(
        "doc_id", *count, F.sha2(secrets.joined(base).cast("binary"), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans")
    )


def _kind_sql(no: int, r: secrets.Rule) -> str:
    pattern = r.pattern.replace("'", "''")
    return f"""
  SELECT doc_id, copy, {no} AS no, '{r.kind}' AS kind, CAST(starts[i] AS BIGINT) AS s, CAST(starts[i] + length(m[i]) AS BIGINT) AS e
  FROM (SELECT *, list_transform(range(1, len(m) + 1), lambda i: coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0)
          + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0)) AS starts, unnest(range(1, len(m) + 1)) AS i
    FROM (SELECT doc_id, copy, regexp_extract_all(text, '{pattern}') AS m, regexp_extract_all(text, '{pattern}', {r.group}) AS v,
            string_split_regex(text, '{pattern}') AS g FROM docs))
  WHERE length(v[i]) >= {r.least}"""


OP4_SQL = f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS copy, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(_kind_sql(no, r) for no, r in enumerate(secrets.RULES))}),
tagged AS (SELECT *, kind || ':' || s || ':' || e AS span FROM found),
per AS (SELECT copy, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
  count(*) FILTER (kind = 'hex') AS n_hex, string_agg(span, ',' ORDER BY s, no) FILTER (no < 3) AS base,
  string_agg(span, ',' ORDER BY s, no) AS spans FROM tagged GROUP BY copy)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs d LEFT JOIN per USING (copy)
"""


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judged(docs, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


#: A deployment passes its own; the registered query needs a fixed one to give the same rows each time.
PII_KEY = "registered-query"


def op6_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pii.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    counts = [pii.n_found(F.col("found"), kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return made.select("doc_id", "text", *counts)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    made = chat.render(chat.canonical_rows(rows.select("conv_id", "turn", "role", "text").unionByName(more)))
    turns = chat.parse(F.col("formatted"))
    loss = chat.loss_text(F.col("formatted"), F.col("loss_spans"))
    digest = made.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss"))
    said_all = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return digest.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said_all.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP7_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
escaped AS (
  SELECT *, length(text) + length(regexp_replace(text, '[^\\<#]', '', 'g')) AS n,
         length(role) + length(regexp_replace(role, '[^\\<#\n]', '', 'g')) AS r FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n + r + 4 + 1 + 8) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(docs, RANKS, public_tokenizers.PATTERN).drop("text")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


OP9_SQL = f"""
WITH docs AS (
  SELECT DISTINCT doc_id, list_filter(string_split_regex(lower(text), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS ws
  FROM documents WHERE text IS NOT NULL),
items AS (SELECT min(item_id) AS item_id, iw, len(iw) AS n FROM (
  SELECT item_id, list_filter(string_split_regex(lower(text), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS iw
  FROM benchmark WHERE text IS NOT NULL) GROUP BY iw HAVING len(iw) > 0),
numbered AS (SELECT row_number() OVER () AS copy, doc_id, ws FROM docs),
dw AS (SELECT copy, len(ws) AS m, unnest(ws) AS w, unnest(range(0, len(ws))) AS p FROM numbered),
it AS (SELECT item_id, unnest(iw) AS w, unnest(range(0, len(iw))) AS q, n FROM items),
diagonals AS (SELECT copy, item_id, p - q AS d, any_value(n) AS n, any_value(m) AS m, count(*) AS matched, list(q ORDER BY q) AS qs
  FROM dw JOIN it USING (w) GROUP BY copy, item_id, d HAVING count(*) >= least(any_value(n), {decontam.WINDOW - decontam.MISMATCHES})),
found AS (SELECT * FROM diagonals WHERE CASE WHEN n < {decontam.WINDOW} THEN matched = n
  ELSE least(n, m - d) - greatest(0, -d) >= {decontam.WINDOW}
    AND len(list_filter(range(1, len(qs) - {decontam.WINDOW - decontam.MISMATCHES - 2}), lambda i: qs[i + {decontam.WINDOW - decontam.MISMATCHES - 1}] - qs[i] < {decontam.WINDOW})) > 0 END)
SELECT doc_id, item_id, CAST(max(n) AS BIGINT) AS n_item_words, max(matched) AS n_matched, CAST(min(greatest(d, 0)) AS BIGINT) AS first_word
FROM found JOIN numbered USING (copy) GROUP BY doc_id, item_id
"""


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html.main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


OP11_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
ws AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
grams AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i : i + m - 1], ' '))) AS phrase
  FROM ws, range(1, 4) r(m) WHERE len(w) >= m),
f AS (SELECT lang, m, phrase, count(*) AS n FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(n) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND n >= 10),
cuts AS (SELECT c.*, k, array_to_string(w[1 : k], ' ') AS head, array_to_string(w[k + 1 : m], ' ') AS tail FROM c, range(1, 3) r(k) WHERE k < m),
s AS (SELECT cuts.lang, cuts.m, cuts.phrase, a, k, x.n AS l, y.n AS r, a::HUGEINT * a * 1000000 // (x.n::HUGEINT * y.n) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = head JOIN f y ON y.lang = cuts.lang AND y.phrase = tail),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, phrase, max(a) AS a FROM (SELECT lang, a, unnest([array_to_string(w[1 : 2], ' '), array_to_string(w[2 : 3], ' ')]) AS phrase FROM c WHERE m = 3) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN longer ON longer.lang = best.lang AND longer.phrase = best.phrase WHERE longer.a IS NULL OR 100 * longer.a < 50 * best.a),
ranks AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, CAST(t.n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranks JOIN totals t USING (lang) WHERE rank <= 2000
"""


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.joined(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP12_SQL = r"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS copy, doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (SELECT copy, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))) END AS s FROM docs),
sized AS (SELECT copy, doc_id, len(s) AS n, s FROM sets),
grams AS (SELECT copy, n, unnest(s) AS g FROM sized),
pairs AS (SELECT x.copy AS a, y.copy AS b, any_value(x.n) AS n, any_value(y.n) AS m, count(*) AS o FROM grams x JOIN grams y
    ON x.g = y.g AND x.copy <> y.copy AND 100 * least(x.n, y.n) >= 90 * greatest(x.n, y.n) GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * o >= 90 * (n + m - o)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(doc_id) AS m FROM reach JOIN docs ON docs.copy = b GROUP BY a)
SELECT doc_id, n AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id FROM sized LEFT JOIN least ON a = copy
"""


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the texts, by the checksum of their id, repeat a part of themselves to their end."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    g = F.floor(F.col("h") / 10)

    def repeated(ws):
        n = F.size(ws)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        return let(a, lambda a: let(p, lambda p: F.array_join(F.transform(positions(F.lit(0), n - 1), lambda i: F.get(ws, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")))

    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    made = docs.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.length("text") > 0), let(words, repeated)).otherwise(F.col("text")).alias("text"))
    found = periods.with_runs(made)
    # Spark evaluates an array_max of structs by their fields in turn: longest, then first, then of the smallest period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    digests = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    start, period, length = -F.col("best.start"), -F.col("best.period"), F.col("best.length")
    return digests.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


#: The checksum is worked out bit by bit, with the polynomial of CRC-32.
OP13_SQL = r"""
WITH ids AS (SELECT row_number() OVER () AS copy, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
  xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)))) AS h FROM documents),
cut AS (SELECT copy, doc_id, w, len(w) AS n, h, (h // 10) % greatest(len(w), 1) AS a, 3 + (h // 10) % 8 AS d FROM ids),
docs AS (SELECT copy, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // d) END]) ELSE w END AS w FROM cut),
places AS (SELECT copy, n, unnest(w) AS w, unnest(range(0, n)) AS i FROM docs),
pairs AS (SELECT x.copy, x.i, y.i - x.i AS q FROM places x JOIN places y ON x.copy = y.copy AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT copy, q, min(i) AS s, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY copy, q ORDER BY i) AS island FROM pairs)
  GROUP BY copy, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT copy, s, length, min(q) AS q FROM islands GROUP BY ALL),
gone AS (SELECT DISTINCT copy, unnest(range(s + q, s + length)) AS i FROM runs),
kept AS (SELECT copy, string_agg(w, ' ' ORDER BY i) AS t FROM places ANTI JOIN gone USING (copy, i) GROUP BY copy),
per AS (SELECT copy, count(*) AS n_runs, string_agg(s || ',' || length || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY copy),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY copy ORDER BY length DESC, s, q) = 1)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(s AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(q AS BIGINT) AS period,
  CAST(1000 * length // q AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM docs LEFT JOIN per USING (copy) LEFT JOIN best USING (copy) LEFT JOIN kept USING (copy)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_order_minhash": op1_order_minhash,
    "op2_line_dedup": op2_line_dedup,
    "op3_license_scan": op3_license_scan,
    "op4_secret_scan": op4_secret_scan,
    "op5_quality_rules": op5_quality_rules,
    "op6_pii_pseudonyms": op6_pii_pseudonyms,
    "op7_chat_format": op7_chat_format,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_decontaminate": op9_decontaminate,
    "op10_html_text": op10_html_text,
    "op11_collocations": op11_collocations,
    "op12_ngram_join": op12_ngram_join,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES: dict[str, str] = {
    "op2_line_dedup": OP2_SQL,
    "op3_license_scan": OP3_SQL,
    "op4_secret_scan": OP4_SQL,
    "op7_chat_format": OP7_SQL,
    "op9_decontaminate": OP9_SQL,
    "op11_collocations": OP11_SQL,
    "op12_ngram_join": OP12_SQL,
    "op13_periodic_runs": OP13_SQL,
}
