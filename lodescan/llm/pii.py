"""Personal data in free text by a skip-chain conditional random field.

Every token carries one of eleven labels: none, or the first or a further token of a mail address, phone number, identity
number, postal address or name. Neighbours share transition potentials. Each occurrence of a capitalised word of four
letters or more, and of a number of four digits or more, is also tied to its next occurrence in the text, however far
away; the two ends of a tie share a potential, so that what is clear in one place counts in the other. Marginals are found
by loopy message passing: forward and backward passes over the chains alternate with messages over the ties.

Potentials of single tokens weigh the word, its neighbours, its shape and what lists say of it, forms of numbers, mail
and postal addresses it lies in, and the words before such a form. The labels alone decide what an entity is and where it
begins and ends; exact conditions (digits, word ends) follow. The weights are fitted on texts whose personal data is known
because the texts were made of labelled columns and templates (``pii_synthetic``).

The texts of a batch are handled as one: forms are searched in the joined texts, words are weighed once each, and all chains
are passed at the same time. A text of any length is handled; it is cut into chains, and ties run across them.
"""

from __future__ import annotations

import io
import json
import pkgutil
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodescan.engine.checks import VALIDATORS
from lodescan.llm.pii_patterns import (
    BREAK, CLASSES, GROUPS, JOINED, NUMBERS, PIECE, TITLES, TYPES, beginnings, flattened, form, matches, name_key, shape, word_class,
)

LABELS = ["O", *[f"{p}-{t}" for t in TYPES for p in "BI"]]
K = len(LABELS)
TYPE_OF = np.asarray([-1, *[i for i in range(len(TYPES)) for _ in "BI"]])
MODEL = "models/pii_crf.npz"
CHAIN_TOKENS, LEAST_CHAIN, TIE_LETTERS, ROUNDS = 128, 32, 4, 3
#: neighbours whose words are weighed, and the two words before the form a token lies in
PLACES = (0, -1, 1, -2, 2)
LEADS = 2
_SLOTS = len(PLACES) + LEADS
_N = len(CLASSES)
#: checks of identity numbers by the number of their digits
CHECKS = {8: ("ES_NIF",), 7: ("ES_NIE",), 10: ("UK_NHS",), 11: ("PL_PESEL", "DE_TAX_ID"), 12: ("IN Aadhaar",)}


def checked(value: str) -> bool:
    """Whether a check digit or letter of some kind of identity number is right."""
    bare = re.sub(r"[ .-]", "", value)
    for name in CHECKS.get(sum(c.isdigit() for c in bare), ()):
        try:
            if VALIDATORS[name](bare):
                return True
        except (ValueError, IndexError):
            continue
    return False


def word_features(token: str) -> list[str]:
    low = token.lower()
    out = [f"s={shape(token)}", f"w={low}"]
    if len(token) > 3 and token[:1].isalpha():
        out += [f"p={name_key(token)[:3]}", f"e={name_key(token)[-3:]}"]
    return out


class _Numbers(dict):
    """Numbers of the words met so far; a new one is weighed when it is first asked for."""

    def __init__(self, model: Model):
        super().__init__({BREAK: 0})
        self.model = model

    def __missing__(self, token: str) -> int:
        i = self[token] = len(self)
        self.model._fill(i, token)
        return i


class Model:
    """Weights by feature and label.

    ``names``: features of words, each weighed once for every place it can stand in relative to a token; ``tables``: weights of
    codes (forms, gaps, classes of neighbouring words); ``transition``, ``tie``: potentials of two labels.
    """

    def __init__(self, names: list[str], words: np.ndarray, tables: dict[str, np.ndarray], transition: np.ndarray, tie: np.ndarray, given: list[str], forms: list[str]):
        self.row = {n: i for i, n in enumerate(names)}
        self.words, self.tables, self.transition, self.tie = words, tables, transition, tie
        self.given, self.forms = frozenset(given), {f: i + 1 for i, f in enumerate(forms)}
        self.passed_over: frozenset[int] = frozenset()
        self.forget()

    def forget(self) -> None:
        """The words met so far; the first stands for what lies outside of a text."""
        self.ids = _Numbers(self)
        self.scores = np.zeros((1024, _SLOTS, K), dtype=np.float32)
        self.classes = np.zeros(1024, dtype=np.int64)
        self.begins = np.zeros(1024, dtype=np.int64)
        self.between = np.zeros(1024, dtype=np.int64)
        self._fill(0, BREAK)

    def _fill(self, i: int, token: str) -> None:
        if i >= len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.classes = np.concatenate([self.classes, np.zeros_like(self.classes)])
            self.begins = np.concatenate([self.begins, np.zeros_like(self.begins)])
            self.between = np.concatenate([self.between, np.zeros_like(self.between)])
        self.between[i] = _between(token)
        if self.between[i] and i:
            return
        rows = self.rows(i, token)
        self.scores[i] = self.words[rows].sum(axis=0) if rows else 0
        self.classes[i] = CLASSES.index(word_class(token, self.given)) if i else 0
        self.begins[i] = beginnings(token) if i else 0

    def rows(self, i: int, token: str) -> list[int]:
        """Rows of a word's features that are weighed; ``passed_over`` ones are not (while fitting)."""
        return [r for r in map(self.row.get, word_features(token) if i else ["w=^"]) if r is not None and r not in self.passed_over]

    def numbered(self, pieces: list[str]) -> np.ndarray:
        if len(self.ids) > 150_000:
            self.forget()
        return np.fromiter(map(self.ids.__getitem__, pieces), dtype=np.int64, count=len(pieces))

    def save(self, path: str) -> None:
        meta = json.dumps({"names": list(self.row), "given": sorted(self.given), "forms": list(self.forms)}, ensure_ascii=False)
        np.savez_compressed(
            path, words=self.words.astype(np.float16), transition=self.transition, tie=self.tie, meta=np.frombuffer(meta.encode(), dtype=np.uint8),
            **{f"table_{k}": v.astype(np.float16) for k, v in self.tables.items()},
        )

    @staticmethod
    def load(data: bytes) -> Model:
        f = np.load(io.BytesIO(data))
        meta = json.loads(f["meta"].tobytes().decode())
        tables = {k.removeprefix("table_"): f[k].astype(np.float32) for k in f.files if k.startswith("table_")}
        return Model(meta["names"], f["words"].astype(np.float32), tables, f["transition"].astype(np.float32), f["tie"].astype(np.float32), meta["given"], meta["forms"])


def table_sizes(n_forms: int) -> dict[str, int]:
    return {
        **{f"in_{g}": 5 for g in GROUPS}, "gap": 4, "form": n_forms + 1, "checked": 2, "joined": len(GROUPS) + 1,
        "before": _N**2, "after": _N**2, "around": _N**3, "ahead": _N**3, "behind": _N**3,
    }


@lru_cache(1)
def trained() -> Model:
    return Model.load(pkgutil.get_data("lodescan.llm", MODEL))


def _between(piece: str) -> int:
    """0 of a token, 1 of blanks, 2 of what holds a line end, 3 of the break between texts."""
    if not piece.isspace():
        return 3 if piece == BREAK else 0
    return 2 if "\n" in piece else 1


class Batch:
    """Tokens, forms, codes, chains and ties of several texts."""

    def __init__(self, texts: list[str], model: Model):
        self.model = model
        flats = [flattened(t or "") for t in texts]
        self.at = [a for _, a in flats]
        self.joined = BREAK.join(f for f, _ in flats)
        self.offsets = np.concatenate([[0], np.cumsum([len(f) + 1 for f, _ in flats])]).astype(np.int64)
        pieces = PIECE.findall(self.joined)
        ends = np.cumsum(np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)))
        # what stands before each token: nothing, a blank, a line end, the break between texts
        numbers = model.numbered(pieces)
        kind = model.between[numbers]
        tokens = np.flatnonzero(kind == 0)
        self.tokens = [pieces[i] for i in tokens.tolist()]
        self.n = len(tokens)
        self.end = ends[tokens]
        self.start = self.end - np.fromiter(map(len, self.tokens), dtype=np.int64, count=self.n)
        self.gap = np.where(tokens > 0, kind[np.maximum(tokens - 1, 0)], 3)
        self.text = np.searchsorted(self.offsets, self.start, side="right") - 1
        if self.n:
            self.gap[1:][self.text[1:] != self.text[:-1]] = 3
        self.ids = numbers[tokens]
        self._codes()
        self._chains()
        self._ties()

    def shifted(self, values: np.ndarray, by: int, fill: int = 0) -> np.ndarray:
        """Values of the tokens ``by`` places on, ``fill`` where those belong to another text."""
        out = np.full(self.n, fill, dtype=values.dtype)
        if abs(by) < self.n:
            a, b = (slice(None, -by), slice(by, None)) if by > 0 else (slice(-by, None), slice(None, by)) if by else (slice(None), slice(None))
            same = self.text[a] == self.text[b]
            out[a] = np.where(same, values[b], fill)
        return out

    def _codes(self) -> None:
        n, model = self.n, self.model
        self.codes: dict[str, np.ndarray] = {}
        self.covered = np.zeros(n, dtype=bool)
        spans = matches(self.joined, self.start, model.begins[self.ids])
        numbers = []
        for g, group in enumerate(GROUPS):
            code = np.zeros(n, dtype=np.int64)
            if spans[group]:
                where = np.asarray(spans[group], dtype=np.int64)
                first, last = np.searchsorted(self.start, where[:, 0]), np.searchsorted(self.start, where[:, 1]) - 1
                if group in NUMBERS:
                    numbers += [(i, j, g) for i, j in zip(first.tolist(), last.tolist())]
                for i, j in zip(first.tolist(), last.tolist()):
                    code[i:j + 1] = 2
                    code[i], code[j] = (4, 4) if i == j else (1, 3)
                    self.covered[i:j] = True
            self.codes[f"in_{group}"] = code
        self.lead = np.zeros((LEADS, n), dtype=np.int64)
        self.led = np.zeros(n, dtype=bool)
        forms, checks, joins = (np.zeros(n, dtype=np.int64) for _ in range(3))
        numbers.sort(key=lambda x: (x[0], -x[1]))
        before: tuple[int, tuple[int, int], int] | None = None
        done = -1
        for i, j, g in numbers:
            if i <= done:
                continue
            done = j
            value = self.joined[self.start[i]:self.end[j]]
            joined, here = 0, self.text[i]
            leads = tuple(self.ids[i - k] if i - k >= 0 and self.text[i - k] == here else 0 for k in (1, 2))
            if before and self.text[before[0]] == here and JOINED.fullmatch(self.joined, self.end[before[0]], self.start[i]):
                leads, joined = before[1], before[2] + 1
            before = (j, leads, g)
            self.lead[:, i:j + 1] = np.asarray(leads)[:, None]
            self.led[i:j + 1] = True
            forms[i:j + 1] = model.forms.get(form(value), 0)
            checks[i:j + 1] = checked(value)
            joins[i:j + 1] = joined
        self.codes |= {"form": forms, "checked": checks, "joined": joins}
        self.codes["gap"] = self.gap
        c = model.classes[self.ids]
        one, two, back, back2 = (self.shifted(c, k) for k in (1, 2, -1, -2))
        self.codes |= {
            "before": back * _N + c, "after": c * _N + one, "around": (back * _N + c) * _N + one, "ahead": (c * _N + one) * _N + two,
            "behind": (back2 * _N + back) * _N + c,
        }

    def _chains(self) -> None:
        """Token ranges that end at the end of a text, or, once long enough, of a line or sentence outside of all forms."""
        stop, chains, first = {".", "!", "?", ";", "。"}, [], 0
        gap, covered, text = self.gap.tolist(), self.covered.tolist(), self.text.tolist()
        for i in range(self.n):
            size = i + 1 - first
            last = i + 1 == self.n
            ends = last or text[i + 1] != text[i]
            if not ends and size >= LEAST_CHAIN and not covered[i] and gap[i + 1] > 0:
                ends = gap[i + 1] == 2 or self.tokens[i] in stop and i > first and len(self.tokens[i - 1]) > 2
            if ends or size >= CHAIN_TOKENS:
                chains.append((first, size))
                first = i + 1
        chains.sort(key=lambda x: -x[1])
        self.chain_start = np.asarray([c[0] for c in chains], dtype=np.int64)
        self.chain_length = np.asarray([c[1] for c in chains], dtype=np.int64)

    def _ties(self) -> None:
        last: dict[tuple[int, str], int] = {}
        pairs = []
        text = self.text.tolist()
        for i in np.flatnonzero(self.end - self.start >= TIE_LETTERS).tolist():
            word = self.tokens[i]
            if not (word[0].isupper() or word[0].isdigit()):
                continue
            key = (text[i], name_key(word))
            if key in last:
                pairs.append((last[key], i))
            last[key] = i
        self.ties = np.asarray(pairs, dtype=np.int64).reshape(-1, 2)

    def unary(self) -> np.ndarray:
        m = self.model
        out = m.scores[self.ids, 0].copy()
        for slot, place in enumerate(PLACES[1:], 1):
            out += m.scores[self.shifted(self.ids, place), slot]
        for k in range(LEADS):
            out[self.led] += m.scores[self.lead[k][self.led], len(PLACES) + k]
        for name, code in self.codes.items():
            out += m.tables[name][code]
        return out


def _normal(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(x.sum(axis=1, keepdims=True), 1e-30)


def beliefs(b: Batch, rounds: int = ROUNDS, ties: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of every token; forward messages, node potentials with backward messages, and messages over ties (for fitting)."""
    u = b.unary()
    phi = np.exp(u - u.max(axis=1, keepdims=True)) if b.n else u
    E, S = np.exp(b.model.transition), np.exp(b.model.tie)
    steps = [int((b.chain_length > t).sum()) for t in range(int(b.chain_length.max(initial=0)))]
    left, right = (b.ties[:, 0], b.ties[:, 1]) if ties else (np.empty(0, np.int64),) * 2
    to_right, to_left = np.ones((len(left), K), np.float32), np.ones((len(left), K), np.float32)
    forward, backward = np.ones_like(phi), np.ones_like(phi)
    node = phi

    def step_(t: int, x: np.ndarray) -> np.ndarray:
        # every fourth step is enough to stay within range
        return x if t & 3 else _normal(x)

    for n in range(rounds if len(left) else 1):
        if n:
            node = phi.copy()
            np.multiply.at(node, right, to_right)
            np.multiply.at(node, left, to_left)
        for t in range(1, len(steps)):
            here = b.chain_start[:steps[t]] + t
            forward[here] = step_(t, (forward[here - 1] * node[here - 1]) @ E)
        for t in range(len(steps) - 1, 0, -1):
            here = b.chain_start[:steps[t]] + t
            backward[here - 1] = step_(t, (backward[here] * node[here]) @ E.T)
        belief = _normal(forward * node * backward)
        if len(left):
            out_left, out_right = _normal(belief[left] / np.maximum(to_left, 1e-6)), _normal(belief[right] / np.maximum(to_right, 1e-6))
            to_right, to_left = _normal(out_left @ S) * K, _normal(out_right @ S.T) * K
    return _normal(forward * node * backward), forward, node * backward, node


def _trim(flat: str, s: int, e: int, kind: str) -> tuple[int, int]:
    """Labels' ends that belong to no entity: punctuation, blanks and possessive endings."""
    ends = {"PHONE": (lambda c: c in "+(" or c.isdigit(), str.isdigit)}.get(kind)
    first, last = ends or (lambda c: c.isalnum() or c == "#" and kind == "ADDRESS", str.isalnum)
    while s < e and not first(flat[s]):
        s += 1
    while e > s and not last(flat[e - 1]) and not (kind == "NAME" and flat[e - 1] == "." and flat[e - 2:e - 1].isalpha() and (e - 2 == s or not flat[e - 3].isalnum())):
        if unicodedata.combining(flat[e - 1]):
            break
        e -= 1
    if kind == "NAME" and flat[e - 2:e] in ("'s", "’s"):
        e -= 2
    while kind == "NAME" and (m := _TITLED.match(flat, s, e)):
        s = m.end()
    return s, e


_TITLED = re.compile(rf"(?i)(?:{'|'.join(t for t in TITLES if len(t) > 1)})(?:\.\s*|\s+)")
_QUAD = re.compile(r"\d{1,3}(?:\.\d{1,3}){3}")


def plausible(flat: str, s: int, e: int, kind: str) -> bool:
    """Exact conditions every entity of a type meets; it ends at no place within a word or number."""
    span = flat[s:e]
    digits = sum(c.isdigit() for c in span)
    if (s and flat[s - 1].isalnum() and flat[s].isalnum()) or (e < len(flat) and flat[e].isalnum() and flat[e - 1].isalnum()):
        return False
    if kind in ("PHONE", "ID_NUMBER"):
        # no part of a longer number, address or path
        whole = flat[s - 1:s] not in ("#", "/", ".", "@", "-") and not (flat[e:e + 1] in ("-", "/", ".") and flat[e + 1:e + 2].isdigit())
        return whole and not _QUAD.fullmatch(span) and (9 <= digits <= 15 if kind == "PHONE" else digits >= 6)
    if kind == "EMAIL":
        return "@" in span or re.search(r"\bat\b", span.lower()) is not None
    if kind == "ADDRESS":
        return digits >= 1 and any(c.isalpha() for c in span)
    return digits == 0 and len(re.split(r"[\s.]+", span.strip(". "))) >= 2


def entities(texts: list[str], model: Model, ties: bool = True) -> list[list[tuple[int, int, str, float]]]:
    """(start, end, type, confidence) of each text, in places of the text as written.

    An entity begins at a first-token label or where the type changes, and goes on over further-token labels of its type.
    """
    b = Batch(texts, model)
    out: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
    if not b.n:
        return out
    belief = beliefs(b, ties=ties)[0]
    best = belief.argmax(axis=1)
    kinds = TYPE_OF[best]
    inside = (kinds >= 0) & (best % 2 == 0) & (b.shifted(kinds, -1, -1) == kinds)
    begins = np.flatnonzero((kinds >= 0) & ~inside)
    for i in begins.tolist():
        j = i + 1
        while j < b.n and inside[j]:
            j += 1
        which, kind = int(b.text[i]), TYPES[kinds[i]]
        base = int(b.offsets[which])
        flat = b.joined[base:int(b.offsets[which + 1]) - 1]
        s, e = _trim(flat, int(b.start[i]) - base, int(b.end[j - 1]) - base, kind)
        if s < e and plausible(flat, s, e, kind):
            at = b.at[which]
            a, z = (s, e) if at is None else (at[s], at[e - 1] + 1)
            out[which].append((a, z, kind, float(belief[i:j, best[i]].mean())))
    return out


_SPAN = "array<struct<start_ix:int,end_ix:int,pii_type:string,confidence:double>>"
BATCH_CHARS = 400_000


def _finder():
    @F.pandas_udf(_SPAN)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = trained()
        names = ("start_ix", "end_ix", "pii_type", "confidence")

        def run(texts: list[str]) -> list[list[dict]]:
            return [[dict(zip(names, x)) for x in spans] for spans in entities(texts, model)]

        for texts in batches:
            out, some, size = [], [], 0
            for t in texts:
                some.append(t)
                size += len(t or "")
                if size > BATCH_CHARS:
                    out += run(some)
                    some, size = [], 0
            yield pd.Series(out + run(some), dtype="object")

    # else the optimizer would compute it once for each place it is used in
    return find.asNondeterministic()


def find_personal_data(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Every entity once: keys, pii_type, start_ix, end_ix (code points, end exclusive), confidence, value.

    Null and empty texts give no row; repeated rows give their entities once. Extra columns are ignored.
    """
    found = df.where(F.col(f"`{text}`").isNotNull()).select(
        *keys, F.col(f"`{text}`").alias("_text"), _finder()(F.col(f"`{text}`")).alias("_spans")
    )
    rows = found.select(*keys, "_text", F.explode("_spans").alias("_s"))
    return rows.select(
        *keys, "_s.pii_type", "_s.start_ix", "_s.end_ix", "_s.confidence",
        F.expr("substring(_text, _s.start_ix + 1, _s.end_ix - _s.start_ix)").alias("value"),
    ).dropDuplicates([*keys, "pii_type", "start_ix", "end_ix"])


def redact(df: DataFrame, text: str, out: str = "redacted") -> DataFrame:
    """``df`` with a copy of the text in which each entity is replaced by its type in square brackets."""
    spans = df.withColumn("_spans", _finder()(F.col(f"`{text}`")))
    pieces = F.aggregate(
        F.col("_spans"),
        F.struct(F.lit("").alias("done"), F.lit(0).alias("at")),
        lambda a, s: F.struct(
            F.concat(
                a["done"], F.substring(F.col(f"`{text}`"), a["at"] + 1, s["start_ix"] - a["at"]), F.lit("["), s["pii_type"], F.lit("]")
            ).alias("done"),
            s["end_ix"].alias("at"),
        ),
    )
    done = F.concat(pieces["done"], F.substring(F.col(f"`{text}`"), pieces["at"] + 1, F.length(F.col(f"`{text}`"))))
    return spans.withColumn(out, F.when(F.col(f"`{text}`").isNotNull(), done)).drop("_spans")


# --- fitting ----------------------------------------------------------------------------------------------


def learn_given(names: pd.Series, least: int = 5) -> list[str]:
    """Given names: first words of two-word values of columns of full names."""
    counts = Counter(name_key(flattened(v)[0].split()[0]) for v in names.dropna() if len(v.split()) == 2)
    return [g for g, n in counts.items() if n >= least and g.isalpha()]


def _targets(b: Batch, spans: list[list[tuple[int, int, str]]]) -> np.ndarray:
    """Labels of tokens, of spans in the texts as mapped (made texts are of ordinary characters, so that places agree)."""
    y = np.zeros(b.n, dtype=np.int64)
    for which, some in enumerate(spans):
        base = int(b.offsets[which])
        back = b.at[which]
        for s, e, kind in some:
            if back is not None:
                s, e = int(np.searchsorted(back, s)), int(np.searchsorted(back, e))
            i, j = np.searchsorted(b.start, [base + s, base + e])
            label = LABELS.index(f"B-{kind}")
            y[i:j] = label + 1
            y[i] = label
    return y


def agreement(made: list[tuple[str, list[tuple[int, int, str]]]], found: list[list[tuple[int, int, str, float]]]) -> tuple[float, float]:
    """Recall and precision of found spans with their types, against known ones."""
    want = {(i, *s) for i, (_, spans) in enumerate(made) for s in spans}
    got = {(i, a, z, kind) for i, spans in enumerate(found) for a, z, kind, _ in spans}
    return len(want & got) / max(1, len(want)), len(want & got) / max(1, len(got))


def fit(
    made: list[tuple[str, list[tuple[int, int, str]]]], given: list[str], *, least: int = 4, epochs: int = 6, rate: float = 0.15, seed: int = 5,
    hidden: float = 0.4, unseen: float = 0.15, per_step: int = 64,
) -> Model:
    """Weights of greatest likelihood on texts with known spans, by adaptive gradient steps; loopy beliefs stand for the marginals.

    In each step a share of the given names (``hidden``) is taken from the list, so that names are found by what stands around them as well, and a
    share of the words (``unseen``) is passed over, so that forms and shapes carry weight where words are unknown.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    counts, forms = Counter(), Counter()
    for text, spans in made:
        flat = flattened(text)[0]
        counts.update(f for t in {p for p in PIECE.findall(flat) if not p.isspace()} for f in word_features(t))
        forms.update(form(flat[a:z]) for a, z, kind in spans if kind in ("PHONE", "ID_NUMBER"))
    names = ["w=^", *sorted(f for f, n in counts.items() if n >= least)]
    kinds = sorted(f for f, n in forms.items() if n >= least)
    tables = {k: np.zeros((n, K), np.float32) for k, n in table_sizes(len(kinds)).items()}
    model = Model(names, np.zeros((len(names), _SLOTS, K), np.float32), tables, np.zeros((K, K), np.float32), np.zeros((K, K), np.float32), given, kinds)
    seen = {"words": np.full_like(model.words, 1e-4), "transition": np.full((K, K), 1e-4, np.float32), "tie": np.full((K, K), 1e-4, np.float32)}
    seen |= {k: np.full_like(t, 1e-4) for k, t in tables.items()}

    def step(target: np.ndarray, past: np.ndarray, grad: np.ndarray, decay: float) -> None:
        grad = grad - decay * target
        past += grad * grad
        target += rate * grad / np.sqrt(past)

    whole = frozenset(given)
    from lodescan.llm import pii_patterns

    wordy = np.asarray([not n.startswith("s=") for n in names])
    listed = {w for w, c in pii_patterns._KIND.items() if c == "given"}
    for _ in range(epochs):
        order = rng.permutation(len(made))
        for at in range(0, len(order), per_step):
            some = [made[i] for i in order[at:at + per_step]]
            # hide some names from the lists for this step only
            gone = {g for g in (*whole, *listed) if rng.random() < hidden}
            model.given = whole - gone
            taken = {g: pii_patterns._KIND.pop(g) for g in gone & listed}
            model.passed_over = frozenset(np.flatnonzero(wordy & (rng.random(len(names)) < unseen)).tolist())
            model.forget()
            b = Batch([t for t, _ in some], model)
            pii_patterns._KIND.update(taken)
            y = _targets(b, [s for _, s in some])
            belief, forward, later, node = beliefs(b)
            g = -belief
            g[np.arange(b.n), y] += 1
            # words: gradients are summed by word and place first
            by_word = np.zeros((len(model.ids), _SLOTS, K), np.float32)
            np.add.at(by_word[:, 0], b.ids, g)
            for slot, place in enumerate(PLACES[1:], 1):
                np.add.at(by_word[:, slot], b.shifted(b.ids, place), g)
            for k in range(LEADS):
                np.add.at(by_word[:, len(PLACES) + k], b.lead[k][b.led], g[b.led])
            grad, touched = np.zeros_like(model.words), set()
            for token, i in model.ids.items():
                rows = model.rows(i, token)
                touched.update(rows)
                grad[rows] += by_word[i]
            rows = np.asarray(sorted(touched))
            part, past = model.words[rows], seen["words"][rows]
            step(part, past, grad[rows], 1e-3)
            model.words[rows], seen["words"][rows] = part, past
            for name, code in b.codes.items():
                grad = np.zeros_like(model.tables[name])
                np.add.at(grad, code, g)
                step(model.tables[name], seen[name], grad, 1e-3)
            # transitions within chains
            inner = np.ones(b.n, dtype=bool)
            inner[b.chain_start] = False
            cur = np.flatnonzero(inner)
            first = forward[cur - 1] * node[cur - 1]
            E = np.exp(model.transition)
            z = np.maximum(((first @ E) * later[cur]).sum(axis=1, keepdims=True), 1e-30)
            expected = E * ((first / z).T @ later[cur])
            grad = -expected
            np.add.at(grad, (y[cur - 1], y[cur]), 1)
            step(model.transition, seen["transition"], grad, 1e-3)
            if len(b.ties):
                left, right = b.ties[:, 0], b.ties[:, 1]
                S = np.exp(model.tie)
                # beliefs of the two ends without each other are those of the last but one round, to a first order
                a, c = belief[left], belief[right]
                z = np.maximum(((a @ S) * c).sum(axis=1, keepdims=True), 1e-30)
                grad = -(S * ((a / z).T @ c))
                np.add.at(grad, (y[left], y[right]), 1)
                step(model.tie, seen["tie"], grad, 1e-2)
        model.given = whole
    model.passed_over = frozenset()
    model.forget()
    return model
