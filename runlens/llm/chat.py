"""Chat formatting: a fingerprint of the nested field paths picks the mapping that turns a record into canonical turns.

All of it is DataFrame expressions. A record is a struct (or a JSON text read with ``LAYOUTS``); the paths that hold
something are sorted, joined and hashed, and the hash selects one declarative ``Mapping``. Records of an unknown
fingerprint keep their row, with null turns and a null layout.

Template: ``<turn ROLE>\\n`` TEXT ``</turn>\\n`` for each turn. Inside texts a backslash becomes ``\\b`` and the ``<`` of
``<turn`` and ``</turn`` becomes ``\\l``, so control strings never occur in a text and unescaping gives it back exactly.

Edge cases: null and empty texts and roles read as empty; turns tied in order are taken by role, then text; repeated
rows are repeated turns; an empty table gives an empty result; other columns of the input are kept out of the way
(only the named columns are read). A conversation is one output row, so it must fit in a task; its rows are not skewed
further by this operator.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MESSAGE = {"messages": ("role", "content"), "conversations": ("from", "value"), "turns": ("role", "text"), "dialog": ("speaker", "utterance")}
_FLAT = ("system", "instruction", "input", "output", "context", "response", "prompt", "completion", "question", "answer")

#: Superset of the layouts below; JSON records are read with it and fields that a record lacks are null.
LAYOUTS = T.StructType(
    [T.StructField(n, T.ArrayType(T.StructType([T.StructField(a, T.StringType()), T.StructField(b, T.StringType())]))) for n, (a, b) in _MESSAGE.items()]
    + [T.StructField(n, T.StringType()) for n in _FLAT]
)


@dataclass(frozen=True)
class Turns:
    """Every element of an array field is a turn."""

    field: str
    roles: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Turn:
    """Fields joined by a blank line are one turn; no turn where all are absent."""

    role: str
    fields: tuple[str, ...]


@dataclass(frozen=True)
class Mapping:
    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...]
    steps: tuple[Turns | Turn, ...]


def _list(name: str, field: str, roles: tuple[tuple[str, str], ...] = (), optional: tuple[str, ...] = ()) -> Mapping:
    a, b = _MESSAGE[field]
    first = (Turn("system", ("system",)),) if "system" in optional else ()
    return Mapping(name, (f"{field}[]",), (f"{field}[].{a}", f"{field}[].{b}", *optional), (*first, Turns(field, roles)))


MAPPINGS = (
    _list("messages", "messages", optional=("system",)),
    _list("turn rows", "turns", optional=("system",)),
    _list("from/value", "conversations", (("human", "user"), ("gpt", "assistant"), ("bot", "assistant")), ("system",)),
    _list("dialog", "dialog", (("human", "user"), ("bot", "assistant"), ("agent", "assistant")), ("system",)),
    Mapping("instruction/output", ("instruction", "output"), ("input", "system"), (Turn("system", ("system",)), Turn("user", ("instruction", "input")), Turn("assistant", ("output",)))),
    Mapping("instruction/response", ("instruction", "response"), ("context", "system"), (Turn("system", ("system",)), Turn("user", ("context", "instruction")), Turn("assistant", ("response",)))),
    Mapping("prompt/completion", ("prompt", "completion"), ("system",), (Turn("system", ("system",)), Turn("user", ("prompt",)), Turn("assistant", ("completion",)))),
    Mapping("prompt/response", ("prompt", "response"), ("system",), (Turn("system", ("system",)), Turn("user", ("prompt",)), Turn("assistant", ("response",)))),
    Mapping("question/answer", ("question", "answer"), ("context", "system"), (Turn("system", ("system",)), Turn("user", ("context", "question")), Turn("assistant", ("answer",)))),
)


def fingerprints(mappings: tuple[Mapping, ...] = MAPPINGS) -> dict[str, str]:
    """Fingerprint -> mapping name, for every set of optional paths a mapping allows."""
    found: dict[str, str] = {}
    for m in mappings:
        for n in range(len(m.optional) + 1):
            for some in combinations(m.optional, n):
                key = hashlib.sha256("\n".join(sorted((*m.required, *some))).encode()).hexdigest()
                if found.setdefault(key, m.name) != m.name:
                    raise ValueError(f"{m.name} and {found[key]} share the paths {(*m.required, *some)}")
    return found


def _has(name: str):
    return lambda x: x[name].isNotNull()


def _paths(record: Column, schema: T.StructType) -> list[tuple[str, Column]]:
    """Each nested path of the layouts and whether the record holds something there."""
    out = []
    for f in LAYOUTS.fields:
        if f.name not in schema.fieldNames():
            continue
        col = record[f.name]
        if isinstance(f.dataType, T.ArrayType):
            out.append((f"{f.name}[]", F.coalesce(F.size(col), F.lit(0)) > 0))
            for g in f.dataType.elementType.fields:
                out.append((f"{f.name}[].{g.name}", F.coalesce(F.exists(col, _has(g.name)), F.lit(False))))
        else:
            out.append((f.name, col.isNotNull()))
    return sorted(out, key=lambda x: x[0])


def fingerprint(record: Column, schema: T.StructType = LAYOUTS) -> Column:
    held = F.array_compact(F.array(*[F.when(there, F.lit(path)) for path, there in _paths(record, schema)]))
    return F.sha2(F.array_join(held, "\n"), 256)


def _turns(step: Turns | Turn, record: Column) -> Column:
    none = F.array().cast("array<struct<role:string,text:string>>")
    if isinstance(step, Turn):
        text = F.concat_ws("\n\n", *[record[f] for f in step.fields])
        there = F.coalesce(*[record[f] for f in step.fields]).isNotNull()
        return F.when(there, F.array(F.struct(F.lit(step.role).alias("role"), text.alias("text")))).otherwise(none)
    a, b = _MESSAGE[step.field]

    def role(x: Column) -> Column:
        r = F.coalesce(x[a], F.lit(""))
        out = r
        for old, new in step.roles:
            out = F.when(F.lower(r) == old, F.lit(new)).otherwise(out)
        return out

    return F.coalesce(F.transform(record[step.field], lambda x: F.struct(role(x).alias("role"), F.coalesce(x[b], F.lit("")).alias("text"))), none)


def canonical(df: DataFrame, record: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Adds ``fingerprint``, ``layout`` and ``turns`` (array of role, text) for the struct column ``record`` (of ``LAYOUTS``)."""
    keys = fingerprints(mappings)
    names = F.create_map(*[F.lit(x) for pair in keys.items() for x in pair])
    out = df.withColumn("fingerprint", fingerprint(F.col(record))).withColumn("layout", names[F.col("fingerprint")])
    turns = F.lit(None).cast("array<struct<role:string,text:string>>")
    for m in mappings:
        steps = [_turns(s, F.col(record)) for s in m.steps]
        turns = F.when(F.col("layout") == m.name, F.concat(*steps) if len(steps) > 1 else steps[0]).otherwise(turns)
    return out.withColumn("turns", turns)


def from_json_records(df: DataFrame, column: str, record: str = "record") -> DataFrame:
    """Reads JSON texts of any layout; a text that is no JSON object has no paths, so no layout."""
    return df.withColumn(record, F.from_json(F.col(column), LAYOUTS))


def record_of(**fields: Column) -> Column:
    """A record struct with these fields, the rest null."""
    return F.struct(*[fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in LAYOUTS.fields])


def turn_rows(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows by turn -> one record for each conversation (one shuffle, on the conversation)."""
    rows = df.select(F.col(conv).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")).alias("t"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return grouped.select("conv_id", record_of(turns=F.transform("t", lambda x: F.struct(x.role.alias("role"), x.text.alias("text")))).alias("record"))


def _replace(col: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        col = F.replace(col, F.lit(old), F.lit(new))
    return col


def escape(text: Column) -> Column:
    return _replace(text, ("\\", "\\b"), ("<turn", "\\lturn"), ("</turn", "\\l/turn"))


def unescape(text: Column) -> Column:
    return _replace(text, ("\\l", "<"), ("\\b", "\\"))


def _escape_role(role: Column) -> Column:
    return _replace(role, ("\\", "\\b"), ("<", "\\l"), (">", "\\g"), ("\n", "\\n"))


def _unescape_role(role: Column) -> Column:
    return _replace(role, ("\\n", "\n"), ("\\g", ">"), ("\\l", "<"), ("\\b", "\\"))


def format_turns(df: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Adds ``formatted`` and ``loss_runs``: for each turn the code points before, under and after the loss mask."""
    head = lambda t: F.concat(F.lit("<turn "), _escape_role(t.role), F.lit(">\n"))
    parts = F.transform("turns", lambda t: F.struct(t.role.isin(*loss_roles).alias("loss"), head(t).alias("head"), escape(t.text).alias("body")))
    tail = "</turn>\n"
    body = lambda p: F.length(p.body).cast("long")
    runs = F.transform(
        "_parts",
        lambda p: F.struct(
            F.length(p.head).cast("long").alias("before"),
            F.when(p.loss, body(p)).otherwise(F.lit(0)).alias("take"),
            (F.when(p.loss, F.lit(0)).otherwise(body(p)) + len(tail)).alias("after"),
        ),
    )
    text = F.array_join(F.transform("_parts", lambda p: F.concat(p.head, p.body, F.lit(tail))), "")
    return df.withColumn("_parts", parts).withColumn("formatted", text).withColumn("loss_runs", runs).drop("_parts")


def read_back(df: DataFrame) -> DataFrame:
    """Adds ``turns_back`` (from ``formatted`` alone) and ``loss_texts`` (from ``formatted`` and ``loss_runs``)."""
    pieces = F.split("formatted", "</turn>\n", -1)
    df = df.withColumn("_pieces", F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0))))

    def turn(p: Column) -> Column:
        at = F.locate(">\n", p, 1)
        return F.struct(_unescape_role(p.substr(F.lit(7), at - 7)).alias("role"), unescape(p.substr(at + 2, F.length(p))).alias("text"))

    under = F.zip_with("_pieces", "loss_runs", lambda p, r: unescape(p.substr((r.before + 1).cast("int"), r["take"].cast("int"))))
    return df.withColumn("turns_back", F.transform("_pieces", turn)).withColumn("loss_texts", under).drop("_pieces")
