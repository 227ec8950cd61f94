"""JSON objects in free text, read as far as they can be: fenced, single-quoted, unquoted, cut off, with commas too many.

`Reader` walks the text once from an opening brace, keeping the open brackets on the call stack; whatever is still open
when the text ends is closed there. A member whose value never came is left out.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlattice.scratch import by_value

by_value(__name__)

QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’"}
COLONS, COMMAS = ":：=", ",，;；"
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
#: Brackets inside brackets beyond this depth are text.
DEEP = 64
MISSING = object()


class Reader:
    """One tolerant pass over a text."""

    def __init__(self, text: str, at: int = 0) -> None:
        self.text, self.at = text, at

    def skip(self, more: str = "") -> str:
        """The next character that is neither white space nor one of more; empty at the end."""
        while self.at < len(self.text) and (self.text[self.at].isspace() or self.text[self.at] in more):
            self.at += 1
        return self.text[self.at : self.at + 1]

    def quoted(self) -> str:
        end = QUOTES[self.text[self.at]]
        self.at += 1
        out = []
        while self.at < len(self.text) and self.text[self.at] != end:
            c = self.text[self.at]
            if c == "\\":
                code = re.compile(r"\\u([0-9a-fA-F]{4})").match(self.text, self.at)
                if code:
                    out.append(chr(int(code[1], 16)))
                    self.at += 6
                    continue
                self.at += 1
                c = self.text[self.at : self.at + 1]
                c = ESCAPES.get(c, c)
            out.append(c)
            self.at += 1
        self.at += 1
        # pairs of surrogates are one character, single ones none
        return "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")

    def bare(self, ends: str) -> object:
        """A number, true, false, null, or a word as it stands."""
        stop = self.at
        while stop < len(self.text) and self.text[stop] not in ends:
            stop += 1
        word, self.at = self.text[self.at : stop].strip(), stop
        if word.lower() in ("true", "false", "null", "none"):
            return {"true": True, "false": False}.get(word.lower())
        if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", word):
            return int(word) if re.fullmatch(r"[+-]?\d+", word) else float(word)
        return word if word else MISSING

    def value(self, depth: int) -> object:
        c = self.skip()
        if c == "{" and depth < DEEP:
            return self.members(depth + 1)
        if c == "[" and depth < DEEP:
            return self.items(depth + 1)
        if c in QUOTES and c:
            return self.quoted()
        return self.bare(COMMAS + "}]\n") if c and c not in "}]" else MISSING

    def items(self, depth: int) -> list:
        self.at += 1
        out = []
        while (c := self.skip(COMMAS)) and c != "]":
            if c == "}":  # the bracket was never closed
                return out
            before = self.at
            if (x := self.value(depth)) is not MISSING:
                out.append(x)
            self.at += self.at == before
        self.at += 1
        return out

    def members(self, depth: int) -> dict:
        self.at += 1
        out: dict = {}
        while (c := self.skip(COMMAS)) and c != "}":
            if c == "]":
                return out
            before = self.at
            key = self.quoted() if c in QUOTES else self.bare(COLONS + COMMAS + "}]\n")
            if self.skip() in COLONS and self.at < len(self.text):
                self.at += 1
                if (x := self.value(depth)) is not MISSING and key is not MISSING:
                    out[str(key)] = x
            self.at += self.at == before
        self.at += 1
        return out


def first_object(text: str | None) -> dict | None:
    """The first object of a text that has any member; None if there is none."""
    at = (text or "").find("{")
    while at >= 0:
        reader = Reader(text, at)
        if found := reader.members(0):
            return found
        # what was read holds nothing, so the next one is looked for behind it
        at = text.find("{", max(reader.at, at + 1))
    return None


def repaired(texts: Column) -> Column:
    """The first object of each text as plain JSON; null if there is none."""

    @F.pandas_udf("string")
    def run(series: pd.Series) -> pd.Series:
        return series.map(lambda t: None if (x := first_object(t)) is None else json.dumps(x, ensure_ascii=False))

    return run(texts)


#: The members of a verdict, their names in replies, and whether they are whole numbers.
MEMBERS = {
    "verdict": (("verdict", "裁决"), False), "confidence": (("confidence", "信心", "置信度"), True), "reason": (("reason", "理由", "原因"), False),
    "risk_level": (("risk_level", "风险等级"), False), "position_advice": (("position_advice", "仓位建议"), False), "stop_loss_advice": (("stop_loss_advice", "止损建议"), False),
    "key_concern": (("key_concern", "核心关切"), False), "max_position_pct": (("max_position_pct", "最大仓位"), True), "risk_confidence": (("risk_confidence", "风险信心"), True),
}
NO_VERDICT, NO_CONFIDENCE = "观望", 50
REPLY = ", ".join(f"{k} {'long' if whole else 'string'}" for k, (_, whole) in MEMBERS.items()) + ", found boolean"


def verdict_of(text: str | None) -> dict:
    """The members of a reply under their usual names; without a verdict or risk level to wait is the verdict, and the text's beginning the reason."""
    names = {n: k for k, (all_names, _) in MEMBERS.items() for n in all_names}
    out: dict = {}
    for key, value in (first_object(text) or {}).items():
        member = names.get(key.strip().lower())
        if member is None or value is None:
            continue
        if MEMBERS[member][1]:
            number = re.match(r"\s*[+-]?\d+(\.\d+)?", str(value))
            if number:
                out[member] = int(float(number[0]))
        else:
            out[member] = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    if "verdict" in out or "risk_level" in out:
        return out | {"found": True}
    return {"verdict": NO_VERDICT, "confidence": NO_CONFIDENCE, "reason": (text or "").strip()[:100], "found": False}


def verdicts(replies: DataFrame, key: str, text: str) -> DataFrame:
    """key and the members of each reply. replies: key (long), text."""
    kinds = [(key, pa.int64()), *((k, pa.int64() if whole else pa.string()) for k, (_, whole) in MEMBERS.items()), ("found", pa.bool_())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pylist([{key: k} | verdict_of(t) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], schema=pa.schema(kinds))

    return replies.select(F.col(key).cast("long").alias(key), F.col(text).cast("string")).mapInArrow(run, f"{key} long, {REPLY}")
