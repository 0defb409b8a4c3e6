"""Chat formatting: schema fingerprints select declarative mappings to canonical turns.

A record arrives as JSON in any of several layouts (prompt and completion,
instruction with input, message lists, one row a turn ...).  Its schema
fingerprint is a hash of the nested field paths it has.  A registry maps
fingerprints to declarative mappings; a mapping says by paths where roles and
texts are, so no layout needs code of its own.  Paths that no mapping mentions
do not count, so extra fields never change a fingerprint.  A fingerprint that is not
declared, as fields of other layouts are there too, selects the mapping
with the most required paths among those that have all of theirs (of equals the
first in the registry), and keeps it.  Texts may be strings, lists of content parts
(their texts follow each other) or other JSON (written out).  Whatever a mapping
does not read is named in ``unused``.

Canonical turns are then rendered, a row for each turn, with the markers
``<|im_start|>role\\n`` and ``<|im_end|>\\n``.  Inside texts and roles any ``<|``
gets a backslash (``<\\|``; ``<\\|`` becomes ``<\\\\|`` and so on), so that no text
can produce a marker and the escape is undone exactly; inside roles line breaks
and backslashes are escaped as well.  A loss mask gives, for each turn, the span
of code points of the formatted turn that counts for the loss: the text of
assistant turns, without markers.

Turns of a conversation stay separate rows throughout; a conversation is put
together only by :func:`conversation_digest`, which streams its turns in order
with constant memory, so neither long conversations nor a hot one need to fit
into a task.

Defined cases: null text or role is empty; null conversation ids form one
conversation; repeated (conversation, turn) rows are kept and ordered by role and
text; records without all required paths of any mapping come back with mapping null
and no turns, all their paths in unused (they are never guessed at); an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns.

    turns: (role, path) pairs in order; a role that starts with ``$`` is itself a
    path.  items: path of a list whose elements are the turns; role and text paths
    are then relative to the element.  lead: turns before those of the list.
    optional: paths that may be missing.  index: a path that numbers the record's first turn.
    """

    name: str
    turns: tuple[tuple[str, str], ...]
    items: str = ""
    lead: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()
    index: str = ""
    roles: tuple[tuple[str, str], ...] = ()

    def paths(self) -> set[str]:
        prefix = f"{self.items}[]." if self.items else ""
        own = {prefix + p for role, path in self.turns for p in ([role[1:], path] if role.startswith("$") else [path])}
        return own | {path for _, path in self.lead} | ({self.index} if self.index else set())

    def required(self) -> set[str]:
        return self.paths() - set(self.optional)

    def fingerprints(self) -> Iterator[str]:
        for n in range(len(self.optional) + 1):
            for some in itertools.combinations(self.optional, n):
                yield fingerprint(self.required() | set(some))


REGISTRY = (
    Mapping("turn_row", (("$role", "text"),), index="turn"),
    Mapping("messages", (("$role", "content"),), items="messages", lead=(("system", "system"),), optional=("system",)),
    Mapping("from_value", (("$from", "value"),), items="conversations", lead=(("system", "system"),), optional=("system",), roles=(("human", "user"), ("gpt", "assistant"))),
    Mapping("prompt_completion", (("system", "system"), ("user", "prompt"), ("assistant", "completion")), optional=("system",)),
    Mapping("prompt_response", (("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system",)),
    Mapping("instruction", (("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=("system", "input")),
    Mapping("question_answer", (("system", "context"), ("user", "question"), ("assistant", "answer")), optional=("context",)),
)


def field_paths(value: object, prefix: str = "") -> Iterator[str]:
    """Paths of the leaves; list elements are written ``[]``."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from field_paths(v, f"{prefix}.{k}" if prefix else str(k))
    elif isinstance(value, list):
        for v in value:
            yield from field_paths(v, f"{prefix}[]")
        if not value:
            yield f"{prefix}[]"
    else:
        yield prefix


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


class Canonicaliser:
    """Turns JSON records into (fingerprint, mapping name, first turn, turns, unused paths)."""

    #: Layouts, as sets of paths, whose mapping is remembered.
    REMEMBERED = 10_000

    def __init__(self, registry: Sequence[Mapping]):
        self.registry = registry
        self.by_print: dict[str, Mapping | None] = {f: m for m in reversed(registry) for f in m.fingerprints()}
        self.known = set().union(*(m.paths() for m in registry))
        self.lists = {f"{m.items}[]": m for m in registry if m.items}
        self.layouts: dict[frozenset[str], tuple[str, Mapping | None, tuple[str, ...]]] = {}

    def _known_part(self, path: str) -> str | None:
        """The known path that leads to a path: itself or one above it."""
        while path not in self.known:
            cut = max(path.rfind("."), path.rfind("["))
            if cut <= 0:
                return None
            path = path[:cut]
        return path

    def select(self, leaves: frozenset[str]) -> tuple[str, Mapping | None, tuple[str, ...]]:
        if leaves not in self.layouts:
            above = {x: self._known_part(x) for x in leaves}
            found = set(above.values()) - {None}
            for path, m in self.lists.items():  # an empty list of messages is a conversation without turns
                if path in leaves:
                    found |= m.required()
            mark = fingerprint(found)
            if mark not in self.by_print:
                fit = [m for m in self.registry if m.required() <= found]
                self.by_print[mark] = max(fit, key=lambda m: len(m.required()), default=None)
            m = self.by_print[mark]
            own = m.paths() | {f"{m.items}[]"} if m else set()
            if len(self.layouts) >= self.REMEMBERED:
                self.layouts.clear()
            self.layouts[leaves] = mark, m, tuple(sorted(x for x in leaves if above[x] not in own and x not in own))
        return self.layouts[leaves]

    @staticmethod
    def _at(value: object, path: str) -> object:
        for part in path.split("."):
            value = value.get(part) if isinstance(value, dict) else None
        return value

    @classmethod
    def _text(cls, value: object) -> str:
        if value is None or isinstance(value, str):
            return value or ""
        if isinstance(value, list) and value and all(isinstance(x, str) or isinstance(x, dict) and isinstance(x.get("text"), str) for x in value):
            return "".join(x if isinstance(x, str) else x["text"] for x in value)
        return json.dumps(value, ensure_ascii=False, sort_keys=True)

    def __call__(self, record: str | None) -> tuple[str, str | None, int, list[tuple[str, str]], tuple[str, ...]]:
        try:
            value = json.loads(record) if record is not None else None
        except ValueError:
            value = None
        mark, m, unused = self.select(frozenset(field_paths(value)))
        if m is None:
            return mark, None, 0, [], unused
        first = self._at(value, m.index) if m.index else 0
        turns, roles = [], dict(m.roles)
        items = self._at(value, m.items) if m.items else None
        parts = [(m.lead, value), *((m.turns, x) for x in items or [])] if m.items else [(m.turns, value)]
        for layout, item in parts:
            for role, path in layout:
                named = role.startswith("$")
                text = self._at(item, path)
                if not named and path in m.optional and text in (None, ""):
                    continue
                label = self._text(self._at(item, role[1:])) if named else role
                turns.append((roles.get(label, label), self._text(text)))
        return mark, m.name, first if isinstance(first, int) else 0, turns, unused


def canonical_turns(records: DataFrame, id_col: str, record_col: str, registry: Sequence[Mapping] = REGISTRY) -> DataFrame:
    """records' JSON as rows (id_col, fingerprint, mapping, turn, part, role, text, unused).

    turn is the number the record gives (0 where it gives none), part the place
    inside the record, unused its paths that the mapping does not read.  A record
    without turns, or without a mapping, gives one row with part, role and text null.
    """
    id_type = records.schema[id_col].dataType
    schema = f"`{id_col}` {id_type.simpleString()}, fingerprint string, mapping string, turn long, part int, role string, text string, unused array<string>"

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canonical = Canonicaliser(registry)
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            size = 0
            for key, record in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                mark, name, first, turns, unused = canonical(record)
                for part, (role, text) in enumerate(turns) if turns else [(None, (None, None))]:
                    for c, v in zip(cols, (key, mark, name, first, part, role, text, unused)):
                        c.append(v)
                    size += len(text or "")
                if size > 4_000_000:
                    yield _batch(batch, cols)
                    cols, size = [[] for _ in range(8)], 0
            yield _batch(batch, cols)

    def _batch(batch: pa.RecordBatch, cols: list[list]) -> pa.RecordBatch:
        kinds = [batch.schema.field(0).type, pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [id_col, "fingerprint", "mapping", "turn", "part", "role", "text", "unused"])

    return records.select(id_col, record_col).mapInArrow(convert, schema)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def format_turns(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Adds formatted, loss_start and loss_end (code points inside formatted; equal: no loss)."""
    role, text = F.coalesce("role", F.lit("")), escape(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(START), _escape_role(role), F.lit("\n"))
    start = F.length(head)
    return turns.withColumns({
        "formatted": F.when(F.col("part").isNull(), F.lit("")).otherwise(F.concat(head, text, F.lit(f"{END}\n"))),
        "loss_start": F.when(role == loss_role, start).otherwise(F.lit(0)).cast("int"),
        "loss_end": F.when(role == loss_role, start + F.length(text)).otherwise(F.lit(0)).cast("int"),
    })


_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)
_ROLE = re.compile(r"\\(n|\\)")


def _plain(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts read back from formatted text."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"no turn at {at}")
        role = _ROLE.sub(lambda x: "\n" if x[1] == "n" else "\\", _plain(m[1]))
        out.append((role, _plain(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no turn at {at}")
    return out


def conversation_digest(formatted: DataFrame, id_col: str) -> DataFrame:
    """Reads whole conversations back from formatted turns.

    Rows of a conversation meet in one task sorted by turn and are hashed as a
    stream: a task keeps one digest state, whatever the length of a conversation.
    """
    id_type = formatted.schema[id_col].dataType
    schema = f"`{id_col}` {id_type.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    ordered = (
        formatted.select(id_col, "turn", "part", "role", "text", "formatted", "loss_start", "loss_end")
        .repartition(id_col)
        .sortWithinPartitions(id_col, "turn", "part", "role", "text")
        .select(id_col, "formatted", "loss_start", "loss_end")
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        open_key: object = digest  # no key equals it
        turns = loss = None
        n = loss_chars = chars = 0
        done: list[tuple] = []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*done)) if done else [[]] * 6
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(cols, [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()])],
                [id_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

        for batch in batches:
            kind = batch.schema.field(0).type
            for key, text, start, end in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if key != open_key:
                    if turns is not None:
                        done.append((open_key, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                    open_key, turns, loss, n, loss_chars, chars = key, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                for role, plain in parse(text):
                    turns.update(f"{role}\n{plain}\n".encode())
                    n += 1
                masked = _plain(text[start:end])
                loss.update(masked.encode())
                loss_chars += len(masked)
                chars += len(text)
            if done:
                yield flush()
                done = []
        if turns is not None:
            done.append((open_key, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
            yield flush()

    return ordered.mapInArrow(digest, schema)


def turn_records(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, record): a table of turns as JSON records of the one-row-a-turn layout."""
    fields = F.struct(F.col("turn"), F.col("role"), F.col("text"))
    return conversations.select(id_col, F.to_json(fields, {"ignoreNullFields": "false"}).alias("record"))


def message_records(spark: SparkSession, conversations: Sequence[tuple[int, Sequence[tuple[str, str]]]], id_col: str = "conv_id") -> DataFrame:
    """(id, record): given conversations as JSON records of the message-list layout."""
    rows = [(k, json.dumps({"messages": [{"role": r, "content": t} for r, t in turns]})) for k, turns in conversations]
    return spark.createDataFrame(rows, f"`{id_col}` long, record string")
