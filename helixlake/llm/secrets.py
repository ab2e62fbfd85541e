"""Secret scans with a trigram inverted index.

Every rule's regex gives a Boolean query over lower-case trigrams that each of its matches must hold
(an OR of ANDs). Postings of the trigrams that some query names are intersected and united per text;
only the texts that satisfy a rule's query are verified with its regex. A rule whose regex has no
mandatory trigram is run over every text. Built-in functions only.

Defined results: a null text is an empty one; rows with equal id and text each keep their result;
a null id is kept; spans are whole matches in code points, end exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as c
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixlake.llm.common import match_spans, stored, texts


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``least`` is the least length of ``group`` (0: the whole match)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),  # maximal runs, as short runs hold no long ones
)
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES

#: Strings followed at once while a regex is read; beyond, what came before is turned into trigrams.
MOST_STRINGS = 64
#: Up to so many candidate texts (under 100 bytes each: two hashes and names of rules) are named to the scan by broadcast;
#: more are joined by shuffle.
BROADCAST_TEXTS = 500_000

Query = frozenset  # of frozensets of trigrams: an OR of ANDs; frozenset({frozenset()}) holds always
ALWAYS: Query = frozenset({frozenset()})


def _both(a: Query, b: Query) -> Query:
    return _least(frozenset(x | y for x in a for y in b))


def _least(q: Query) -> Query:
    return frozenset(x for x in q if not any(y < x for y in q))


def _of_strings(strings: set[str]) -> Query:
    return _least(frozenset(frozenset(s[k : k + 3] for k in range(len(s) - 2)) for s in strings))


def _read(nodes) -> tuple[Query, set[str] | None]:
    """A regex's query and, if it matches only few strings, these (in lower case)."""
    query, run, exact = ALWAYS, {""}, True

    def cut() -> None:
        nonlocal query, run, exact
        query, run, exact = _both(query, _of_strings(run)), {""}, False

    for op, arg in nodes:
        inner, strings = ALWAYS, None
        if op is c.LITERAL:
            strings = {chr(arg).lower()}
        elif op is c.IN and all(o is c.LITERAL for o, _ in arg):
            strings = {chr(a).lower() for _, a in arg}
        elif op is c.SUBPATTERN:
            inner, strings = _read(arg[3])
        elif op is c.BRANCH:
            parts = [_read(x) for x in arg[1]]
            inner = _least(frozenset().union(*[q for q, _ in parts]))
            strings = set().union(*[s for _, s in parts]) if all(s is not None for _, s in parts) else None
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT):
            least, most, body = arg
            q, s = _read(body)
            if s is not None and (least, most) == (0, 1):
                strings = s | {""}
            elif least and s is not None and len(s) ** least <= MOST_STRINGS:
                made = {""}
                for _ in range(least):
                    made = {a + b for a in made for b in s}
                if least == most:
                    strings = made
                else:
                    inner = _of_strings(made)
            elif least:
                inner = q
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = {a + b for a in run for b in strings}
        elif strings is not None:
            cut()
            run = set(strings)
            if len(run) > MOST_STRINGS:
                cut()
        else:
            cut()
            query = _both(query, inner)
    return _both(query, _of_strings(run)), run if exact else None


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query of a regex; ALWAYS if it has no mandatory trigram."""
    return _read(parser.parse(pattern))[0]


def _key(df: DataFrame, doc_id: str, text: str) -> Column:
    return F.struct(F.xxhash64(df[doc_id], df[text]).alias("a"), F.xxhash64(F.lit(1), df[text], df[doc_id]).alias("b"))


def postings(docs: DataFrame, trigrams: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(trigram, key) for each text that holds the trigram in its lower-case form."""
    low = docs.select(_key(docs, doc_id, text).alias("key"), F.lower(texts(docs, text)).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.select("key", F.explode(held).alias("trigram"))


def candidates(posted: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """key and the rules whose query its trigrams satisfy: intersections of postings, then unions."""
    spark = posted.sparkSession
    clauses = [(rule, n, len(clause), t) for rule, q in queries.items() for n, clause in enumerate(sorted(map(sorted, q))) for t in clause]
    wanted = spark.createDataFrame(clauses, "rule string, clause int, need int, trigram string")
    met = posted.join(F.broadcast(wanted), "trigram").groupBy("key", "rule", "clause", "need").agg(F.count_distinct("trigram").alias("n"))
    return met.where("n = need").groupBy("key").agg(F.collect_set("rule").alias("rules"))


def _found(no: int, rule: Rule, ready: Column | None) -> Column:
    """A rule's spans, where it has to be run; a rule without a query first looks for any match."""
    kind = "array<struct<start:bigint,no:int,end:bigint,kind:string>>"
    spans = match_spans(F.col("text"), rule.pattern, rule.group, lambda length, value: F.length(value) >= rule.least)
    tagged = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(no).alias("no"), s["end"].alias("end"), F.lit(rule.kind).alias("kind")))
    runs = ready if ready is not None else F.rlike("text", F.lit(rule.pattern))
    return F.when(runs, tagged.cast(kind)).otherwise(F.array().cast(kind))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ``spans array<struct<start,no,end,kind>>`` of each row, in order of start, then rule."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    queries = {kind: q for kind, q in queries.items() if q != ALWAYS}
    rows = docs.select(F.col(doc_id).alias("doc_id"), texts(docs, text).alias("text"), _key(docs, doc_id, text).alias("key"))
    if queries:
        grams = sorted({t for q in queries.values() for clause in q for t in clause})
        found = stored(candidates(postings(docs, grams, doc_id, text), queries), "secret-candidates")
        rows = rows.join(F.broadcast(found) if found.count() <= BROADCAST_TEXTS else found, "key", "left")
    else:
        rows = rows.withColumn("rules", F.lit(None).cast("array<string>"))
    each = [_found(no, rule, F.array_contains("rules", rule.kind) if rule.kind in queries else None) for no, rule in enumerate(rules)]
    return rows.select("doc_id", F.sort_array(F.concat(*each)).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def n_spans(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
