"""Chat formatting: layouts are recognised by a fingerprint of their nested field paths.

A layout (JSON records, or the columns of a table) is reduced to its nested field paths, all elements of
lists seen. The hash of those that a declarative mapping knows, against the hash of all that it needs, selects
the mapping, which says where the turns are; of several the one of most paths, then the first. Paths that no
mapping knows don't count. All layouts end as one canonical column ``turns array<struct<role string, text
string>>``, which a template renders to one string with a loss mask over the assistant's texts. Built-in functions
only.

Defined results: a null text or role is empty; a record of unknown layout, or with no turn, keeps
its row with ``layout`` null and no turns; elements of a list of turns that are no objects are no turns;
turns with equal numbers are ordered by role, then text. A conversation is one row, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixlake.llm.common import let, running_sums

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """Where a layout has its turns.

    ``paths``: its nested field paths, ``[]`` for list elements. ``turns``: (JSON path of the list,
    role key, text key), or None. ``fields``: (role, JSON path) in turn order, for flat layouts;
    an optional field that is missing or empty gives no turn. ``roles`` renames roles.
    """

    name: str
    paths: tuple[str, ...]
    turns: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, str], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()


SHAREGPT_ROLES = (("human", "user"), ("gpt", "assistant"))

MAPPINGS = (
    Mapping("messages", ("messages", "messages[].role", "messages[].content"), turns=("messages", "role", "content")),
    Mapping("conversations", ("conversations", "conversations[].from", "conversations[].value"), turns=("conversations", "from", "value"), roles=SHAREGPT_ROLES),
    Mapping("prompt_response", ("prompt", "response"), fields=(("user", "prompt"), ("assistant", "response"))),
    Mapping("prompt_completion", ("prompt", "completion"), fields=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("question_answer", ("question", "answer"), fields=(("user", "question"), ("assistant", "answer"))),
    Mapping("instruction", ("instruction", "output"), fields=(("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction_input", ("instruction", "input", "output"), fields=(("system", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("system_prompt_response", ("system", "prompt", "response"), fields=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
)

#: Layouts of tables with a row per turn; paths: conversation, order, role, text.
TURN_TABLES = (
    Mapping("turns", ("conv_id", "turn", "role", "text")),
    Mapping("turns_content", ("conversation_id", "turn_id", "role", "content")),
)


def fingerprint(paths: Column) -> Column:
    """Hash of a set of nested field paths."""
    return F.xxhash64(F.array_join(F.array_sort(F.array_distinct(paths)), "\n"))


def fingerprint_of(paths: Iterable[str]) -> int:
    """The same hash, of paths that are known where the plan is made."""
    return xxhash.xxh64_intdigest("\n".join(sorted(set(paths))), seed=42) 


def selected(paths: Iterable[str], mappings: tuple[Mapping, ...]) -> Mapping | None:
    """The mapping that the fingerprints of a schema's paths select."""
    have = set(paths)
    fit = [m for m in mappings if fingerprint_of(have & set(m.paths)) == fingerprint_of(m.paths)]
    return max(fit, key=lambda m: len(m.paths), default=None)


def _elements(record: Column, name: str) -> Column:
    """The JSON texts of a list's elements that are objects."""
    made = F.from_json(F.get_json_object(record, f"$.{name}"), "array<string>")
    return F.filter(F.coalesce(made, F.array().cast("array<string>")), lambda e: F.json_object_keys(e).isNotNull())


def json_paths(record: Column, lists: tuple[str, ...]) -> Column:
    """Nested field paths of a JSON object, into all elements of its lists of objects."""
    top = F.coalesce(F.json_object_keys(record), F.array().cast("array<string>"))

    def nested(name: str) -> Column:
        keys = F.array_distinct(F.flatten(F.transform(_elements(record, name), F.json_object_keys)))
        return F.transform(keys, lambda k: F.concat(F.lit(f"{name}[]."), k))

    return F.concat(top, *map(nested, lists))


def schema_paths(schema: T.StructType, prefix: str = "") -> list[str]:
    """Nested field paths of a table's schema."""
    found = []
    for field in schema.fields:
        kind, path = field.dataType, prefix + field.name
        found.append(path)
        if isinstance(kind, T.ArrayType):
            kind, path = kind.elementType, path + "[]"
        if isinstance(kind, T.StructType):
            found += schema_paths(kind, path + ".")
    return found


def _renamed(role: Column, roles: tuple[tuple[str, str], ...]) -> Column:
    out = role
    for old, new in roles:
        out = F.when(role == old, F.lit(new)).otherwise(out)
    return out


def _mapped(record: Column, m: Mapping) -> Column:
    if m.turns:
        name, role, text = m.turns
        return F.transform(
            _elements(record, name),
            lambda e: F.struct(
                _renamed(F.coalesce(F.get_json_object(e, f"$.{role}"), F.lit("")), m.roles).alias("role"),
                F.coalesce(F.get_json_object(e, f"$.{text}"), F.lit("")).alias("text"),
            ),
        )
    made = [F.struct(F.lit(role).alias("role"), F.coalesce(F.get_json_object(record, f"$.{path}"), F.lit("")).alias("text")) for role, path in m.fields]
    last = len(m.fields) - 1
    optional = [F.when((t["text"] != "") | F.lit(k == last), t) for k, t in enumerate(made)]
    return F.filter(F.array(*optional), lambda t: t.isNotNull())


def canonical_json(df: DataFrame, record: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Adds ``layout`` (the mapping's name) and ``turns`` to rows that hold one JSON record each, replacing
    columns of these names."""
    lists = tuple(dict.fromkeys(m.turns[0] for m in mappings if m.turns))
    value = df[record].cast("string")

    def mapped(paths: Column) -> Column:
        out = F.struct(F.lit(None).cast("string").alias("layout"), F.array().cast(TURNS).alias("turns"))
        for m in sorted(reversed(mappings), key=lambda m: len(m.paths)):  # the last of these is asked first
            known = F.filter(paths, lambda p: p.isin(*m.paths))  # noqa: B023
            made = F.struct(F.lit(m.name).alias("layout"), F.coalesce(_mapped(value, m).cast(TURNS), F.array().cast(TURNS)).alias("turns"))
            out = F.when(fingerprint(known) == fingerprint(F.array(*[F.lit(p) for p in m.paths])), made).otherwise(out)
        return out

    marked = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), let(json_paths(value, lists), mapped).alias("found"))
    kept = [F.col("row")[c].alias(c) for c in df.columns if c not in ("layout", "turns")]
    return marked.select(*kept, "found.layout", "found.turns")


def canonical_rows(df: DataFrame) -> DataFrame:
    """conv_id and ``turns`` from a table with a row per turn; the fingerprint of its schema selects the mapping.

    One row per conversation (null ids together): its turns are what one template call has to hold anyway.
    """
    have = schema_paths(df.schema)
    mapping = selected(have, TURN_TABLES)
    if mapping is None:
        raise ValueError(f"no mapping for a table of turns with the fields {sorted(have)}")
    columns = mapping.paths
    conv, turn, role, text = columns
    rows = df.select(
        F.col(conv).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    made = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return made.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


# The template. A turn is "### <role>\n<text></turn>\n". Escaped texts have neither # nor <, so a
# control string in a text can't be taken for one of the template's.
HEAD, TAIL = "### ", "</turn>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l")), F.lit("#"), F.lit("\\h"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\h"), F.lit("#")), F.lit("\\s"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def render(df: DataFrame, turns: str = "turns") -> DataFrame:
    """Adds ``formatted`` and ``loss_spans``: start and end (code points, end exclusive) of every
    assistant text in ``formatted``, its escapes included."""
    parts = F.transform(
        df[turns],
        lambda t: F.struct(
            F.concat(F.lit(HEAD), escape_role(t["role"]), F.lit("\n")).alias("head"),
            escape(t["text"]).alias("body"),
            (t["role"] == "assistant").alias("loss"),
        ),
    )

    def laid(ps: Column) -> Column:
        ends = running_sums(F.transform(ps, lambda p: (F.length(p["head"]) + F.length(p["body"]) + len(TAIL)).cast("bigint")))
        placed = F.zip_with(ps, ends, lambda p, e: F.struct(p["loss"].alias("loss"), (e - len(TAIL) - F.length(p["body"])).alias("start"), (e - len(TAIL)).alias("end")))
        return F.struct(
            F.array_join(F.transform(ps, lambda p: F.concat(p["head"], p["body"], F.lit(TAIL))), "").alias("formatted"),
            F.transform(F.filter(placed, lambda s: s["loss"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("loss_spans"),
        )

    made = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), let(parts, laid).alias("made"))
    kept = [F.col("row")[c].alias(c) for c in df.columns if c not in ("formatted", "loss_spans")]
    return made.select(*kept, "made.formatted", "made.loss_spans")


def parse(formatted: Column) -> Column:
    """The turns of a formatted string: what ``render`` was given."""
    raw = F.split(formatted, TAIL)
    return F.transform(
        F.filter(raw, lambda r: r != ""),
        lambda r: F.struct(
            unescape_role(F.substring_index(F.substr(r, F.lit(len(HEAD) + 1)), "\n", 1)).alias("role"),
            unescape(F.substr(r, F.instr(r, F.lit("\n")) + 1)).alias("text"),
        ),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(
        F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), ""
    )
