"""Classes of values that rules ask for. Each judges a text by itself: YES, NO, or OPEN if only data can tell.

``value_class`` reads what a rule writes by a table of patterns, the first that fits; a class is made once
for each rule and judges any number of texts.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

YES, OPEN, NO = 1, 0, -1
#: Words for values that only data or the running program can tell.
TOLD_LATER = (
    "localisation", "synced_localisation", "inline_localisation", "scope_field", "percentage_field", "variable_field", "int_variable_field", "date_field", "color_field", "country_tag",
)
#: A text that can be the name of an object, and what begins like one but is bound at run time.
_NAME, _BOUND_LATER = re.compile(r"[A-Za-z_][\w.:-]*"), ("event_target:", "parameter:")


@dataclass(frozen=True)
class Value:
    """``why``: what a refusal says. ``asks``: the question to data where the class is open."""

    why: str = ""
    asks: tuple[str, str] | None = None

    def judge(self, text: str) -> int:
        return OPEN

    def question(self, text: str) -> tuple[str, str] | None:
        return self.asks


@dataclass(frozen=True)
class Anything(Value):
    def judge(self, text: str) -> int:
        return YES


@dataclass(frozen=True)
class NoText(Value):
    why: str = "a block is asked for"

    def judge(self, text: str) -> int:
        return NO


@dataclass(frozen=True)
class OneOf(Value):
    """Listed texts; a list that is not ``closed`` leaves others open."""

    texts: frozenset[str] = frozenset()
    closed: bool = True

    def judge(self, text: str) -> int:
        return YES if text in self.texts else NO if self.closed else OPEN


@dataclass(frozen=True)
class Number(Value):
    low: float = -math.inf
    high: float = math.inf
    holds_low: bool = True
    holds_high: bool = True
    whole: bool = False
    computed: bool = False  # an expression may stand for the number

    def judge(self, text: str) -> int:
        if not re.fullmatch(r"\s*[+-]?(\d[\d_]*\.?[\d_]*|\.\d[\d_]*)([eE][+-]?\d+)?\s*", text):
            readable = re.fullmatch(r"\s*[+-]?(inf|infinity|nan)\s*", text, re.I)
            return NO if readable or not (self.computed or text.startswith("@")) else OPEN
        number = float(text)
        inside = self.low <= number <= self.high and (self.holds_low or number > self.low) and (self.holds_high or number < self.high)
        return YES if inside and math.isfinite(number) and not (self.whole and not re.fullmatch(r"[+-]?\d+", text)) else NO


@dataclass(frozen=True)
class Reference(Value):
    """The name of an object of a type."""

    def question(self, text: str) -> tuple[str, str] | None:
        return self.asks if _NAME.fullmatch(text) and not text.startswith(_BOUND_LATER) else None


def _number(book, m) -> Value:
    try:
        low, high = float(m["low"] or "-inf"), float(m["high"] or "inf")
    except ValueError:
        return Value()
    return Number("no number that fits", low=low, high=high, holds_low=m["from"] != "(", holds_high=m["to"] != ")", whole=m["sort"] == "int")


def _enum(book, m) -> Value:
    names, closed = book.members(m["name"])
    return OneOf(f"no member of enum[{m['name']}]", ("enum", m["name"]) if m["name"] in book.complex_enums else None, frozenset(names), closed)


#: How a rule writes a value, and the class; the first that fits counts.
_WRITTEN = [
    (r"bool", lambda book, m: OneOf("neither yes nor no", texts=frozenset(("yes", "no")))),
    (r"scalar|string", lambda book, m: Anything()),
    (r"(?P<sort>int|float)((?P<from>[\[(])(?P<low>\S+)\.\.(?P<high>\S+)(?P<to>[\])]))?", _number),
    (r"(?P<sort>int_)?value_field", lambda book, m: Number("no number", whole=bool(m["sort"]), computed=True)),
    (r"enum\[(?P<name>.*)\]", _enum),
    (r"complex_enum\[(?P<name>.*)\]", lambda book, m: Value(asks=("enum", m["name"]))),
    (r"<(?P<name>[A-Za-z_][A-Za-z0-9_]*)(\.[A-Za-z0-9_.]*)?>", lambda book, m: Reference(asks=("object", m["name"]))),
    (r"[a-zA-Z_]+\[.*\]|\$.*|.*<.*|" + "|".join(TOLD_LATER), lambda book, m: Value()),
]
_WRITTEN = [(re.compile(p, re.S), make) for p, make in _WRITTEN]


def value_class(book, written: str | None, literal: bool = False) -> Value:
    """The class that a rule's value names; ``literal``: it stands in quotes and is only itself."""
    if written is None or (not literal and written in book.schemas and not any(p.fullmatch(written) for p, _ in _WRITTEN)):
        return NoText()
    if not literal:
        for pattern, make in _WRITTEN:
            if found := pattern.fullmatch(written):
                return make(book, found)
        if not re.fullmatch(r"[\w.:-]+", written):
            return Value()
    return OneOf("another word is asked for", texts=frozenset((written,)))
