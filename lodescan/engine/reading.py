"""One value as the detectors see it, and what they find in it."""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field
from functools import cached_property

from lodescan.engine.fields import Field, field_named

# How many words and characters around a value a recogniser looks at.
WORDS_BEFORE, WORDS_AFTER, WINDOW = 5, 3, 120

_PLAIN = re.compile(r"[^\W_]+|#")
_SPOKEN = re.compile(r"[\w']+")
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


@dataclass(slots=True)
class Hit:
    """A finding in one value: its place, how sure it is, and what speaks for and against it."""

    detector: str
    category: str
    severity: str
    value: str
    start: int
    end: int
    score: float
    word: str | None = None
    hint: bool = False
    validated: bool = False
    #: further evidence, in the order it is reported
    marks: tuple[str, ...] = ()
    #: found by a recogniser of the catalogue
    ruled: bool = False
    #: stands whatever the field's name is
    exempt: bool = False
    needs_context: bool = False
    encoded: str | None = None

    @property
    def span(self) -> tuple[int, int]:
        return self.start, self.end


class Vocabulary:
    """Words of a detector in order of preference: single ones count as whole words or, from four letters on, as beginnings."""

    def __init__(self, words: str, prefixes: bool = True):
        self.order = [w.strip() for w in words.split(",")]
        self.single = [w for w in self.order if " " not in w]
        self.beginnings = tuple(w for w in self.single if prefixes and len(w) >= 4)

    def first_in(self, tokens: list[str]) -> str | None:
        have, line = set(tokens), f" {' '.join(tokens)} "
        begun = [t for t in have if t.startswith(self.beginnings)] if self.beginnings else []
        for w in self.order:
            if w in have or (w in self.beginnings and any(t.startswith(w) for t in begun)) or (" " in w and f" {w} " in line):
                return w
        return None


@dataclass
class Reading:
    """A text with its field; word positions are found once and looked up by place."""

    text: str
    name: str | None = None
    field: Field = field(init=False)

    def __post_init__(self) -> None:
        self.field = field_named(self.name)

    @cached_property
    def has_digit(self) -> bool:
        return any(c.isdigit() for c in self.text)

    @cached_property
    def n_digits(self) -> int:
        return sum(c.isdigit() for c in self.text)

    @cached_property
    def lowered(self) -> str:
        return self.text.lower()

    @cached_property
    def _spoken(self) -> tuple[list[int], list[list[str]]]:
        starts, words = [], []
        for m in _SPOKEN.finditer(self.text):
            starts.append(m.start())
            words.append([p.lower() for p in _HUMP.split(m.group()) if p])
        return starts, words

    @cached_property
    def _plain(self) -> tuple[list[int], list[str]]:
        found = list(_PLAIN.finditer(self.text))
        return [m.start() for m in found], [m.group().lower() for m in found]

    @property
    def plain_words(self) -> list[str]:
        return self._plain[1]

    def around(self, start: int, end: int, before: int = 120, after: int = 60) -> list[str]:
        """Words that begin at most so many characters before a span or after it."""
        starts, words = self._spoken
        left = words[bisect_left(starts, start - before):bisect_left(starts, start)]
        right = words[bisect_left(starts, end):bisect_left(starts, end + after)]
        return [w for part in left + right for w in part]

    def near(self, words: Vocabulary, start: int, end: int, before: int = 120, after: int = 60) -> str | None:
        return words.first_in(self.around(start, end, before, after))

    def neighbours(self, start: int, end: int) -> str:
        """The recognisers' window: five words before and three after, within reach."""
        starts, words = self._plain
        a, b, c = bisect_left(starts, start - WINDOW), bisect_left(starts, start), bisect_left(starts, end)
        d = bisect_left(starts, end + WINDOW)
        return " ".join(words[max(a, b - WORDS_BEFORE):b] + words[c:min(d, c + WORDS_AFTER)])
