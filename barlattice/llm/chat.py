"""Chat formatting: records of any known layout become canonical turns, and turns one formatted text.

Layouts: the nested field paths of a record (lists as [], sorted) are hashed to a schema fingerprint; the
fingerprint selects a declarative mapping (`LAYOUTS`) from the record's fields to turns (`Registry.turns`).
Optional fields are part of a layout: each combination has its own fingerprint. Other fields are metadata: where the
whole record's fingerprint has no mapping, the mapping with the most of its fields there is taken, the
earlier one of two with as many. Fields missing in single elements of a
list, and elements that are no objects, count as empty. A record that no mapping fits gets no turns; it keeps its fingerprint, so that a mapping can be added.

Template: a turn is <|role|> newline text <|end|> newline. Inside roles and texts a backslash becomes two and a
bar becomes backslash and slash, so no bar is left there and no text can open or close a turn; reading back undoes
it (`escape`, `unescape`). The loss mask is the list of (start, end) offsets, in the formatted text, of
the assistant's texts.

Defined results: null role or text counts as empty; turns of a conversation are ordered by turn (null first), then
role, then text; rows that repeat are turns that repeat; rows without conv_id form one conversation. An empty table
gives an empty result. Long conversations are streamed turn by turn; nothing but the state of two hashes is kept.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlattice.llm.common import by_value

by_value(__name__)

#: The fields of known layouts, and how each becomes turns. A mapping is a list of steps: ("each", list
#: field, role field, text field) takes every element; ("turn", role, text fields) joins the fields that are there.
LAYOUTS = (
    {"fields": ["role", "text"], "steps": [("self", "role", "text")]},
    {"fields": ["role", "content"], "steps": [("self", "role", "content")]},
    {"fields": ["messages[].content", "messages[].role"], "steps": [("each", "messages", "role", "content")]},
    {"fields": ["conversations[].from", "conversations[].value"], "optional": ["system"], "steps": [("turn", "system", ["system"]), ("each", "conversations", "from", "value")]},
    {"fields": ["instruction", "output"], "optional": ["input", "system"], "steps": [("turn", "system", ["system"]), ("turn", "user", ["instruction", "input"]), ("turn", "assistant", ["output"])]},
    {"fields": ["prompt", "completion"], "optional": ["system"], "steps": [("turn", "system", ["system"]), ("turn", "user", ["prompt"]), ("turn", "assistant", ["completion"])]},
    {"fields": ["prompt", "response"], "optional": ["system"], "steps": [("turn", "system", ["system"]), ("turn", "user", ["prompt"]), ("turn", "assistant", ["response"])]},
    {"fields": ["question", "answer"], "optional": ["context"], "steps": [("turn", "user", ["context", "question"]), ("turn", "assistant", ["answer"])]},
)
#: Other names of the three roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
ASSISTANT = "assistant"
#: Fingerprints whose mapping is remembered at once.
KNOWN = 4096
HEAD, TAIL, END = "<|", "|>\n", "<|end|>\n"


def paths(value: object, at: str = "") -> set[str]:
    """The paths of a record's fields: names joined by dots, lists as []."""
    if isinstance(value, dict):
        return set().union(*(paths(v, f"{at}.{k}" if at else str(k)) for k, v in value.items())) if value else {at}
    if isinstance(value, list):
        return set().union(*(paths(v, f"{at}[]") for v in value)) if value else {f"{at}[]"}
    return {at}


def fingerprint(of: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(of)).encode()).hexdigest()[:16]


class Registry:
    """Mappings by fingerprint."""

    def __init__(self, layouts: Iterable[dict] = LAYOUTS) -> None:
        self.by_print: dict[str, dict] = {}
        #: The fields of each variant and its fingerprint, most fields first, for records with metadata.
        self.variants: list[tuple[set[str], str]] = []
        for layout in layouts:
            options = [[]]
            for name in layout.get("optional", []):
                options += [[*o, name] for o in options]
            for o in options:
                self.put([*layout["fields"], *o], layout)
            for step in layout["steps"]:
                if step[0] == "each":
                    self.put([f"{step[1]}[]", *[f for f in layout["fields"] if not f.startswith(f"{step[1]}[]")]], layout)
        self.variants.sort(key=lambda v: -len(v[0]))
        #: Of sets of paths: the fingerprint, and that of the mapping which fits.
        self.known: dict[frozenset[str], tuple[str, str | None]] = {}

    def put(self, fields: list[str], layout: dict) -> None:
        self.by_print[fingerprint(fields)] = layout
        self.variants.append((set(fields), fingerprint(fields)))

    def fitting(self, of: frozenset[str]) -> tuple[str, str | None]:
        """The fingerprint of a record with these paths, and that of the mapping for it, undeclared paths ignored; both are found once for each set of paths."""
        if of not in self.known:
            if len(self.known) >= KNOWN:
                self.known.clear()
            mark = fingerprint(of)
            self.known[of] = mark, mark if mark in self.by_print else next((m for fields, m in self.variants if fields <= of), None)
        return self.known[of]

    def turns(self, record: dict) -> tuple[str, list[tuple[str, str]] | None]:
        """The record's fingerprint, and its turns; None if no mapping has the fingerprint."""
        mark, fit = self.fitting(frozenset(paths(record)))
        return mark, None if fit is None else self.mapped(fit, record)

    def mapped(self, mark: str, record: dict) -> list[tuple[str, str]] | None:
        layout = self.by_print.get(mark)
        if layout is None:
            return None
        out: list[tuple[str, str]] = []
        word = lambda x: "" if x is None else str(x)
        for step in layout["steps"]:
            if step[0] == "self":
                out.append((word(record.get(step[1])), word(record.get(step[2]))))
            elif step[0] == "each":
                items = record.get(step[1])
                for x in items if isinstance(items, list) else []:
                    role, text = (word(x.get(f)) if isinstance(x, dict) else "" for f in step[2:4])
                    out.append((ROLES.get(role, role), text))
            else:
                there = [word(record[f]) for f in step[2] if word(record.get(f))]
                if there or step[1] != "system":
                    out.append((step[1], "\n".join(there)))
        return out


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("|", "\\/")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "|" if m[1] == "/" else m[1], text, flags=re.DOTALL) if "\\" in text else text


def format_turn(role: str, text: str) -> str:
    return f"{HEAD}{escape(role)}{TAIL}{escape(text)}{END}"


def format_turns(turns: Iterable[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and its loss mask."""
    parts, mask, at = [], [], 0
    for role, text in turns:
        piece = format_turn(role, text)
        if role == ASSISTANT:
            mask.append((at + len(HEAD) + len(escape(role)) + len(TAIL), at + len(piece) - len(END)))
        parts.append(piece)
        at += len(piece)
    return "".join(parts), mask


def read_turns(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """Role, text, and where the (escaped) text stands, of every turn of a formatted text."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(HEAD, at):
            raise ValueError(f"no turn starts at {at}")
        mid = formatted.index(TAIL, at)
        end = formatted.index(END, mid)
        yield unescape(formatted[at + len(HEAD) : mid]), unescape(formatted[mid + len(TAIL) : end]), mid + len(TAIL), end
        at = end + len(END)


def parsed(raw: str | None) -> dict:
    """A record; broken JSON, and JSON that is no object, count as an empty one."""
    try:
        value = json.loads(raw) if raw else {}
    except (ValueError, RecursionError):
        value = {}
    return value if isinstance(value, dict) else {}


RECORDS = pa.schema([("record_id", pa.int64()), ("fingerprint", pa.string()), ("formatted", pa.string()), ("loss_start", pa.list_(pa.int64())), ("loss_end", pa.list_(pa.int64())), ("n_turns", pa.int64())])


def format_json(layouts: Iterable[dict]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        registry = Registry(layouts)
        for batch in batches:
            rows = []
            for key, raw in zip(batch.column("record_id").to_pylist(), batch.column("record").to_pylist(), strict=True):
                mark, turns = registry.turns(parsed(raw))
                text, mask = format_turns(turns or [])
                rows.append({"record_id": key, "fingerprint": mark, "formatted": text if turns is not None else None, "loss_start": [a for a, _ in mask], "loss_end": [b for _, b in mask], "n_turns": len(turns or [])})
            yield pa.RecordBatch.from_pylist(rows, schema=RECORDS)

    return run


def format_records(records: DataFrame, id_col: str = "record_id", json_col: str = "record", layouts: Iterable[dict] = LAYOUTS) -> DataFrame:
    """Heterogeneous JSON records to record_id, fingerprint, formatted, loss_start, loss_end, n_turns. Broken JSON counts as an empty record; a record without a mapping has a null formatted text."""
    rows = records.select(F.col(id_col).cast("long").alias("record_id"), F.col(json_col).alias("record"))
    return rows.mapInArrow(format_json(layouts), "record_id long, fingerprint string, formatted string, loss_start array<long>, loss_end array<long>, n_turns long")


TURNS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("piece", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("fingerprint", pa.string())])


def turn_rows(layouts: Iterable[dict]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        registry = Registry(layouts)
        for batch in batches:
            rows: list[tuple] = []
            for conv, turn, raw in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "record")), strict=True):
                mark, turns = registry.turns(parsed(raw))
                rows += [(conv, turn, k, role, text, mark) for k, (role, text) in enumerate(turns)] if turns is not None else [(conv, turn, None, None, None, mark)]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(TURNS), TURNS, strict=True)], schema=TURNS)

    return run


def canonical_turns(records: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", json_col: str = "record", layouts: Iterable[dict] = LAYOUTS) -> DataFrame:
    """Heterogeneous JSON records, each part of a conversation, to conv_id, turn, piece (from 0 in each record), role, text, fingerprint. A record without a mapping is one row with a null piece."""
    rows = records.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(json_col).alias("record"))
    return rows.mapInArrow(turn_rows(list(layouts)), "conv_id long, turn long, piece long, role string, text string, fingerprint string")


FORMATTED = pa.schema([("conv_id", pa.int64()), ("turn_no", pa.int64()), ("formatted", pa.string())])


def format_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of turns to formatted pieces in order."""
    open_conv, number = object(), 0
    for batch in batches:
        numbers, pieces = [], []
        for conv, role, text in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
            number = number + 1 if conv == open_conv else 0
            open_conv = conv
            pieces.append(format_turn(role or "", text or ""))
            numbers.append(number)
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(numbers, type=pa.int64()), pa.array(pieces, type=pa.string())], schema=FORMATTED)


READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def read_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the formatted pieces of each conversation, in order, say when they are read back."""
    open_conv: object = None
    state: list | None = None
    done: list[dict] = []

    def close() -> None:
        if state is not None:
            done.append({"conv_id": open_conv, "n_turns": state[0], "turns_sha256": state[1].hexdigest(), "loss_chars": state[2], "loss_sha256": state[3].hexdigest(), "formatted_chars": state[4]})

    for batch in batches:
        for conv, piece in zip(batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist(), strict=True):
            if state is None or conv != open_conv:
                close()
                open_conv, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text, a, b in read_turns(piece):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if role == ASSISTANT:
                    masked = unescape(piece[a:b])
                    state[2] += len(masked)
                    state[3].update(masked.encode())
            state[4] += len(piece)
        if len(done) >= 4096:
            yield pa.RecordBatch.from_pylist(done, schema=READ)
            done = []
    close()
    if done:
        yield pa.RecordBatch.from_pylist(done, schema=READ)


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text rows (and piece, if a record gave several turns) to conv_id, turn_no, formatted, in order; a conversation's pieces joined are its formatted text. Rows of canonical_turns without a mapping say nothing."""
    piece = F.col("piece") if "piece" in rows.columns else F.lit(0)
    own = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), piece.alias("piece"), "role", "text").where("piece IS NOT NULL")
    # a conversation is read in order by one task, as its digests are; it is streamed, and nothing of it is kept
    placed = own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "piece", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    return placed.select("conv_id", "role", "text").mapInArrow(format_rows, "conv_id long, turn_no long, formatted string")


def read_conversations(formatted: DataFrame, in_order: bool = False) -> DataFrame:
    """A row per conversation of format_conversations' result: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. in_order: the rows come straight from format_conversations, which has dealt and sorted them; a stored table is dealt and sorted anew."""
    rows = formatted.select("conv_id", "turn_no", "formatted")
    if not in_order:
        rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn_no")
    return rows.mapInArrow(read_rows, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
