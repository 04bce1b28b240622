"""Splitting text for byte-level vocabularies at C speed.

The pattern of byte-level vocabularies refines a coarser cut: a run of non-space characters with at
most one space in front.  Where every gap is a single space or line break (at most two breaks
in a row), that cut is ``text.replace("\\n", " \\n").split(" ")``, each part is a dictionary key, and
only parts not seen before go to the tokenizer.  Any other text goes to the tokenizer whole.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Generic, TypeVar

V = TypeVar("V")


class Generations(Generic[V]):
    """A dictionary of bounded size: when the young half is full, the old half is forgotten."""

    def __init__(self, limit: int) -> None:
        self.limit, self.young, self.old = max(1, limit // 2), {}, {}

    def find(self, key: str) -> V | None:
        value = self.old.get(key)
        if value is not None:
            self.put(key, value)
        return value

    def put(self, key: str, value: V) -> None:
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        self.young[key] = value


def simple(text: str) -> bool:
    """Whether each line break of the text is a token of its own, as far as runs of breaks go."""
    return "\n\n" not in text or not ("\n\n\n" in text or "\n\n " in text or text.endswith("\n\n"))


def clean(part: str) -> bool:
    """Whether the part, but for a line break in front, is free of white space and not empty."""
    rest = part[1:] if part[:1] == "\n" else part
    return part == "\n" or (rest != "" and rest.split() == [rest])


class PartEncoder(Generic[V]):
    """Values of the parts of a text, in order; None for a text whose gaps need the whole pattern."""

    def __init__(self, encode: Callable[[str], V], limit: int = 600_000, marker: str | None = None) -> None:
        self.encode, self.marker = encode, marker
        self.inner: Generations[V] = Generations(limit)

    def __call__(self, text: str) -> list[V] | None:
        if not simple(text) or (self.marker and self.marker in text):
            return None
        parts = text.replace("\n", " \n").split(" ")
        first = parts.pop(0)
        if first and first.split() != [first]:
            return None
        values = list(map(self.inner.young.get, parts))
        if None in values:
            for at, value in enumerate(values):
                if value is None:
                    part = parts[at]
                    value = self.inner.young.get(part)
                    if value is None:
                        value = self.inner.find(part)
                    if value is None:
                        if not clean(part):
                            return None
                        value = self.encode(part if part[0] == "\n" else " " + part)
                        self.inner.put(part, value)
                    values[at] = value
        if first:
            values.insert(0, self.encode(first))
        return values
