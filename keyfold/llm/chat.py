"""Chat formatting with schema fingerprints.

The nested field paths of a table or of a record are hashed; the hash selects a
declarative mapping, which turns that layout (prompt and response, instruction,
message lists, rows by turn) into canonical turns. A template then marks turns;
control strings inside texts are escaped, and reading back restores every text.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyfold.session import ship

from .common import batches

# ---- schema fingerprints ----


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns.

    ``turns``: (role, path) pairs in order, for flat layouts; a path of several
    fields joins those that are not empty by a blank line. ``each``: (list path,
    role field, text field) for message lists. ``rows``: (order field, role
    field, text field) for tables with a row for each turn.
    """

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    each: tuple[str, str, str] | None = None
    rows: tuple[str, str, str] | None = None
    lead: tuple[tuple[str, tuple[str, ...]], ...] = ()

    @property
    def fingerprint(self) -> str:
        return hash_paths(self.paths)


def hash_paths(paths: Iterable[str]) -> str:
    """The fingerprint of a set of field paths; their order does not matter."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


#: Layouts known; more are added by passing other mappings.
MAPPINGS = (
    Mapping("prompt_response", ("prompt", "response"), turns=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("prompt_completion", ("prompt", "completion"), turns=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("question_answer", ("question", "answer"), turns=(("user", ("question",)), ("assistant", ("answer",)))),
    Mapping("instruction", ("instruction", "output"), turns=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("instruction_input", ("instruction", "input", "output"), turns=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("system_instruction", ("system", "instruction", "input", "output"), turns=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("messages", ("messages[].role", "messages[].content"), each=("messages", "role", "content")),
    Mapping("system_messages", ("system", "messages[].role", "messages[].content"), each=("messages", "role", "content"), lead=(("system", ("system",)),)),
    Mapping("from_value", ("conversations[].from", "conversations[].value"), each=("conversations", "from", "value")),
    Mapping("rows", ("turn", "role", "text"), rows=("turn", "role", "text")),
)
#: Role names of other layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def schema_paths(schema: T.DataType, at: str = "") -> list[str]:
    """Paths of all leaves: ``a.b`` for fields, ``a[]`` for array elements."""
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(schema, T.ArrayType):
        return schema_paths(schema.elementType, f"{at}[]")
    return [at]


def record_paths(value, at: str = "") -> set[str]:
    """Paths of all leaves of a parsed JSON record."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in record_paths(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list):
        return {p for v in value for p in record_paths(v, f"{at}[]")}
    return {at}


def select_mapping(paths: Iterable[str], mappings: tuple[Mapping, ...] = MAPPINGS) -> Mapping | None:
    """The mapping whose fingerprint the paths have.

    Fields that no mapping names are left out before hashing, so extra columns
    do not hide a layout; if several mappings' fields are there, the paths are
    hashed for each mapping's own fields. A table by turn is taken before all
    others: its rows are turns, whatever columns stand beside them. Else the one
    with most fields is taken.
    """
    there, by_hash = set(paths), {m.fingerprint: m for m in mappings}
    known = there & {p for m in mappings for p in m.paths}
    if found := by_hash.get(hash_paths(known)):
        return found
    fits = [m for m in mappings if hash_paths(known & set(m.paths)) == m.fingerprint]
    return max(fits, key=lambda m: (m.rows is not None, len(m.paths), m.name), default=None)


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True)


def record_turns(record: dict, mapping: Mapping) -> list[tuple[str, str]]:
    """Canonical turns of one record."""

    def flat(pairs):
        for role, fields in pairs:
            text = "\n\n".join(t for t in (_text(record.get(f)) for f in fields) if t)
            if text or role != "system":
                yield role, text

    out = list(flat(mapping.lead)) + list(flat(mapping.turns))
    if mapping.each:
        at, role, text = mapping.each
        out += [(ROLES.get(_text(m.get(role)), _text(m.get(role))), _text(m.get(text))) for m in record.get(at) or [] if m is not None]
    return out


_TURNS = "array<struct<role: string, text: string>>"


def turns_of_table(df: DataFrame, id_col: str = "conv_id", mappings: tuple[Mapping, ...] = MAPPINGS, layout: str | None = None) -> DataFrame:
    """``conv_id, turns`` of a table of any known layout, chosen by its schema's fingerprint or by a mapping's name.

    Null texts and roles count as empty. In tables by turn, turns are ordered by
    the turn number, then role and text; repeated rows are turns of their own,
    and rows with a null id are one conversation, whose id is null. Extra
    columns are ignored. An unknown layout is an error, raised at plan time.
    """
    named = tuple(m for m in mappings if layout in (None, m.name))
    mapping = select_mapping([p for p in schema_paths(df.schema) if p != id_col], named)
    if mapping is None:
        raise ValueError(f"no mapping has the fingerprint of {schema_paths(df.schema)}")
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    common = lambda c: F.coalesce(*[F.when(c == k, v) for k, v in ROLES.items()], text(c))
    if mapping.rows:
        order, role, body = mapping.rows
        rows = df.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), text(F.col(role)).alias("role"), text(F.col(body)).alias("text")))).alias("t"))
        return rows.select(F.col(id_col).alias("conv_id"), F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))

    def flat(pairs):
        parts = [F.struct(F.lit(role).alias("role"), F.array_join(F.filter(F.array(*[text(F.col(f)) for f in fields]), lambda x: x != ""), "\n\n").alias("text")) for role, fields in pairs]
        return F.filter(F.array(*parts), lambda t: (t["text"] != "") | (t["role"] != "system")) if parts else F.array().cast(_TURNS)

    turns = F.concat(flat(mapping.lead), flat(mapping.turns))
    if mapping.each:
        at, role, body = mapping.each
        turns = F.concat(turns, F.transform(F.filter(F.coalesce(F.col(at), F.array().cast(df.schema[at].dataType)), lambda m: m.isNotNull()), lambda m: F.struct(common(m[role]).alias("role"), text(m[body]).alias("text"))))
    return df.select(F.col(id_col).alias("conv_id"), turns.cast(_TURNS).alias("turns"))


def turns_of_records(df: DataFrame, id_col: str = "conv_id", record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``conv_id, fingerprint, layout, turns`` of JSON records, each with a layout of its own.

    Records that are null, broken or of an unknown layout keep a row with null turns.
    """

    ship(df.sparkSession)

    def one(conv_id, value):
        try:
            parsed = json.loads(value)
        except (TypeError, ValueError):
            parsed = None
        if not isinstance(parsed, dict):
            return conv_id, None, None, None
        mapping = select_mapping(record_paths(parsed), mappings)
        print_ = hash_paths(record_paths(parsed))
        return (conv_id, print_, mapping.name, [{"role": r, "text": t} for r, t in record_turns(parsed, mapping)]) if mapping and not mapping.rows else (conv_id, print_, None, None)

    def run(source):
        for b in source:
            yield from batches((one(i, v) for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())), _RECORDS)

    return df.select(F.col(id_col).cast("long").alias("conv_id"), F.col(record).cast("string")).mapInArrow(run, f"conv_id long, fingerprint string, layout string, turns {_TURNS}")


_TURN = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_RECORDS = pa.schema([("conv_id", pa.int64()), ("fingerprint", pa.string()), ("layout", pa.string()), ("turns", _TURN)])

# ---- template ----

#: Control strings of the template; a backslash escapes them and itself.
OPEN, CLOSE = "###", "</turn>"
_ESCAPED = re.compile(r"\\(\\|:|###|</turn>)")
_END = re.compile(r"(?<!\\)(?:\\\\)*</turn>\n")
_HEAD = re.compile(r"### ((?:[^\\:]|\\(?:\\|:|###|</turn>))*): ")


def escape(text: str, role: bool = False) -> str:
    """Control strings get a backslash; in roles the colon is one, too."""
    text = text.replace("\\", "\\\\").replace(OPEN, "\\" + OPEN).replace(CLOSE, "\\" + CLOSE)
    return text.replace(":", "\\:") if role else text


def unescape(text: str) -> str:
    """What ``escape`` was given."""
    return _ESCAPED.sub(r"\1", text)


def render(turns: Iterable[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the loss mask: spans of the assistant's texts in code points."""
    parts, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN} {escape(role, True)}: ", escape(text)
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE, "\n"]
        at += len(head) + len(body) + len(CLOSE) + 1
    return "".join(parts), mask


def read_back(formatted: str) -> Iterator[tuple[str, str]]:
    """The turns of a formatted conversation."""
    at = 0
    while at < len(formatted):
        head = _HEAD.match(formatted, at)
        end = _END.search(formatted, head.end()) if head else None
        if not end:
            raise ValueError(f"not a turn at {at}")
        yield unescape(head[1]), unescape(formatted[head.end() : end.end() - len(CLOSE) - 1])
        at = end.end()


_FORMATTED = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def format_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss`` (array of start and end) from ``conv_id, turns``.

    A conversation without turns, or with null turns, is the empty string with
    an empty mask. One row in, one row out.
    """

    ship(turns.sparkSession)

    def one(conv_id, t):
        text, mask = render((x["role"] or "", x["text"] or "") for x in t or [] if x)
        return conv_id, text, [{"start": a, "end": b} for a, b in mask]

    def run(source):
        for b in source:
            yield from batches((one(i, t) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())), _FORMATTED)

    return turns.select(F.col("conv_id").cast("long"), F.col("turns")).mapInArrow(run, "conv_id long, formatted string, loss array<struct<start: long, end: long>>")


_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def digests(formatted: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``, read back from the output."""

    ship(formatted.sparkSession)

    def one(conv_id, text, loss):
        n, turns = 0, hashlib.sha256()
        for role, body in read_back(text):
            n += 1
            turns.update(f"{role}\n{body}\n".encode())
        masked = "".join(unescape(text[s["start"] : s["end"]]) for s in loss)
        return conv_id, n, turns.hexdigest(), len(masked), hashlib.sha256(masked.encode()).hexdigest(), len(text)

    def run(source):
        for b in source:
            yield from batches((one(*row) for row in zip(*(c.to_pylist() for c in b.columns))), _DIGESTS)

    return formatted.select("conv_id", "formatted", "loss").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
