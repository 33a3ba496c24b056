"""Languages of documents and of the stretches of mixed documents, by hyperdimensional profiles.

Every character has a random vector of +1 and -1, drawn from a seed and the character's number.
Three letters in a row are bound by multiplying the first one's vector, permuted twice, the second
one's, permuted once, and the third one's. A text is the bundle (sum) of the vectors of its triples,
a language's prototype the bundle of texts in it, and a text is compared with the prototypes by cosine.

A document is cut into sentences; machine text (log lines, paths, numbers) and quoted phrases are left
out. The best sequence of languages under a price for each change gives the stretches.
"""

from __future__ import annotations

import io
import pkgutil
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS, SEED = 2048, 20170
LANGUAGES = ["en", "de", "fr", "es", "pt", "it", "nl", "sv", "pl", "tr", "ru", "ja"]
#: code of texts that resemble no known language (least cosine of a stretch with its language), or hold no sentence
UNKNOWN, LEAST_COSINE = "und", 0.05
#: price of a change of language between sentences, in cosine times SHARPNESS; less between close languages
SHARPNESS, CHANGE = 40.0, 6.0
MODEL = "models/language_prototypes.npy"

# Notations of the languages (ISO 639 codes, English and own names).
NOTATIONS = {
    "en": "en eng english", "de": "de deu ger german deutsch", "fr": "fr fra fre french français francais",
    "es": "es spa spanish español espanol castilian", "pt": "pt por portuguese português portugues",
    "it": "it ita italian italiano", "nl": "nl nld dut dutch nederlands flemish", "sv": "sv swe swedish svenska",
    "pl": "pl pol polish polski", "tr": "tr tur turkish türkçe turkce", "ru": "ru rus russian русский",
    "ja": "ja jpn japanese 日本語",
}
# a run of machine text ends at Japanese characters too, whose sentences have no blanks
_RUN = r"[^\s\u3001-\u30ff\u31f0-\u31ff\u3400-\u9fff\uf900-\ufaff\uff61-\uff9f\U00020000-\U0003ffff]*"
_MACHINE = re.compile(rf"\{{[^{{}}\n]*\}}|{_RUN}[\d=/\\{{}}<>|#@_\[\]§]{_RUN}")
_QUOTED = re.compile(r"\(?[\"“„«「][^\"“”„»」\n]{0,200}[\"”»」]\)?")
_END = re.compile(r"(?<=[.!?…])[\"'”»)]*\s+|(?<=[。！？])|\n+")
_WORD = re.compile(r"[^\W\d_]+")
_ODD, _WIDE = re.compile(r"[\d=/\\{}<>|#@_\[\]§\"“„«「]"), re.compile("[\u3041-\U0003ffff]")


def label_language(label: Column) -> Column:
    """Two-letter code of a language label in any notation, null if it names none of the languages."""
    head = F.regexp_extract(F.lower(F.trim(label)), r"^([^-_\s]+)(?:[-_].*)?$", 1)
    named = F.create_map(*[F.lit(x) for code, names in NOTATIONS.items() for n in names.split() for x in (n, code)])
    return F.try_element_at(named, head)


def sentences(text: str) -> list[tuple[int, int, str]]:
    """Start, end and bare wording of each sentence; a piece with too few words is none."""
    out, at = [], 0
    cuts = [m.span() for m in _END.finditer(text)] + [(len(text), len(text))]
    for stop, following in cuts:
        piece = text[at:stop]
        bare = _MACHINE.sub(" ", _QUOTED.sub(" ", piece)) if _ODD.search(piece) else piece
        words = _WORD.findall(bare)
        wording = " ".join(words).lower()
        letters = len(wording) - len(words) + 1
        wide = 0 if wording.isascii() else len(_WIDE.findall(wording))
        if len(words) >= 3 and letters >= 10 or wide >= 6:
            lead = len(piece) - len(piece.lstrip())
            out.append((at + lead, at + len(piece.rstrip()), wording))
        at = following
    return out


@lru_cache(200_000)
def _letter(code: int) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64([SEED, code]))
    return (rng.integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1).astype(np.int8)


def triple_vectors(keys: np.ndarray) -> np.ndarray:
    """Bound vectors of packed letter triples."""
    out = np.empty((len(keys), DIMENSIONS), dtype=np.int8)
    for i, key in enumerate(keys.tolist()):
        a, b, c = key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF
        out[i] = np.roll(_letter(a), 2) * np.roll(_letter(b), 1) * _letter(c)
    return out


def triples(text: str) -> np.ndarray:
    codes = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    if len(codes) < 3:
        return np.empty(0, dtype=np.int64)
    return codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:]


def bundle(text: str) -> np.ndarray:
    keys, counts = np.unique(triples(text), return_counts=True)
    return counts.astype(np.float32) @ triple_vectors(keys).astype(np.float32)


class Profiles:
    """Language prototypes with the products of the triples met so far."""

    def __init__(self, prototypes: np.ndarray, most_triples: int = 400_000):
        p = prototypes.astype(np.float32)
        self.unit = p / np.linalg.norm(p, axis=1, keepdims=True)
        self.price = prices(self.unit)
        self.most = most_triples
        self.place: dict[int, int] = {}
        self.dots = np.zeros((1024, len(p)), dtype=np.float32)

    def _rows(self, keys: np.ndarray) -> np.ndarray:
        if len(self.place) > self.most:
            self.place.clear()
        place = self.place
        new = [k for k in keys.tolist() if k not in place]
        for i in range(0, len(new), 2000):
            some = new[i:i + 2000]
            dots = triple_vectors(np.asarray(some, dtype=np.int64)).astype(np.float32) @ self.unit.T
            start = len(place)
            while start + len(some) > len(self.dots):
                self.dots = np.concatenate([self.dots, np.zeros_like(self.dots)])
            self.dots[start:start + len(some)] = dots
            place.update(zip(some, range(start, start + len(some))))
        return np.fromiter((place[k] for k in keys.tolist()), dtype=np.int64, count=len(keys))

    def cosines(self, texts: list[str]) -> np.ndarray:
        """Cosine of each text with each prototype.

        A text's length is taken from its triples' counts: vectors of different triples are
        orthogonal but for chance, so that the squares of the counts add up.
        """
        out = np.zeros((len(texts), self.unit.shape[0]), dtype=np.float32)
        sizes = np.asarray([len(t) + 2 for t in texts], dtype=np.int64)
        codes = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        if len(codes) < 3:
            return out
        owner = np.repeat(np.arange(len(texts)), sizes)
        # triples within one text
        inner = np.flatnonzero(owner[:-2] == owner[2:])
        if not len(inner):
            return out
        keys, inverse = np.unique(codes[inner] << 42 | codes[inner + 1] << 21 | codes[inner + 2], return_inverse=True)
        rows = self._rows(keys)
        # one number for each (text, triple), in order of the texts
        pairs, counts = np.unique(owner[inner] * len(keys) + inverse, return_counts=True)
        owner, weight = pairs // len(keys), counts.astype(np.float32)
        some = np.flatnonzero(np.bincount(owner, minlength=len(texts)))
        first = np.searchsorted(owner, some)
        sums = np.add.reduceat(weight[:, None] * self.dots[rows[pairs % len(keys)]], first, axis=0)
        out[some] = sums / np.sqrt(DIMENSIONS * np.add.reduceat(weight * weight, first))[:, None]
        return out


def prices(unit: np.ndarray) -> np.ndarray:
    """Price of a change between each two languages: in proportion to the distance of their prototypes up to the median one.

    Sentences of close languages differ less in cosine, so that a full price would swallow short stretches.
    """
    apart = 1 - unit @ unit.T
    usual = np.median(apart[~np.eye(len(unit), dtype=bool)])
    return CHANGE * np.minimum(1, np.maximum(apart, 0) / usual)


def best_path(scores: np.ndarray, change: float | np.ndarray = CHANGE) -> np.ndarray:
    """Language of each sentence: greatest sum of scores less ``change`` (one price, or one per pair) for every switch."""
    n, k = scores.shape
    best = scores.argmax(axis=1)
    if (best == best[0]).all():
        # nothing to gain from a change
        return best
    price = np.broadcast_to(np.asarray(change, dtype=np.float64), (k, k))
    back = np.zeros((n, k), dtype=np.int64)
    total = scores[0].astype(np.float64)
    for i in range(1, n):
        ways = total[:, None] - price
        top = ways.argmax(axis=0)
        switch = ways[top, np.arange(k)]
        back[i] = np.where(total >= switch, np.arange(k), top)
        total = np.maximum(total, switch) + scores[i]
    path = np.empty(n, dtype=np.int64)
    path[-1] = total.argmax()
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def without_lone(path: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """A single sentence between others is no stretch: it joins the neighbour that fits it better."""
    path = path.copy()
    n = len(path)
    for i in range(n):
        left = path[i - 1] if i else None
        right = path[i + 1] if i + 1 < n else None
        if n > 1 and path[i] != left and path[i] != right:
            near = [x for x in (left, right) if x is not None]
            path[i] = max(near, key=lambda x: scores[i, x])
    return path


def stretches(text: str, profiles: Profiles) -> list[tuple[int, int, int, str, float]]:
    """(seg_ix, start, end, language, confidence) of the stretches of a text, in reading order."""
    found = sentences(text) if text else []
    return _parted(found, profiles.cosines([s[2] for s in found]), profiles) if found else []


def stretches_of(texts: list[str | None], profiles: Profiles) -> Iterator[list[tuple[int, int, int, str, float]]]:
    """The stretches of each of several texts, whose sentences are compared with the languages at once."""
    found = [sentences(t) if t else [] for t in texts]
    cosines, at = profiles.cosines([s[2] for some in found for s in some]), 0
    for some in found:
        yield _parted(some, cosines[at:at + len(some)], profiles) if some else []
        at += len(some)


def _parted(found: list[tuple[int, int, str]], cos: np.ndarray, profiles: Profiles) -> list[tuple[int, int, int, str, float]]:
    scores = SHARPNESS * cos
    path = without_lone(best_path(scores, profiles.price), scores)
    out, first = [], 0
    for i in range(1, len(path) + 1):
        if i == len(path) or path[i] != path[first]:
            mean = scores[first:i].mean(axis=0)
            share = np.exp(mean - mean.max())
            known = mean[path[first]] >= SHARPNESS * LEAST_COSINE
            code, sure = (LANGUAGES[path[first]], float(share[path[first]] / share.sum())) if known else (UNKNOWN, 0.0)
            out.append((len(out), found[first][0], found[i - 1][1], code, sure))
            first = i
    return out


@lru_cache(1)
def trained() -> np.ndarray:
    return np.load(io.BytesIO(pkgutil.get_data("lodescan.llm", MODEL)))


#: characters of texts that are compared at once
BATCH_CHARS = 300_000
_SEGMENT = "array<struct<seg_ix:int,start_ix:int,end_ix:int,lang_code:string,confidence:double>>"


def _segmenter():
    @F.pandas_udf(_SEGMENT)
    def segment(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        profiles = Profiles(trained())
        names = ("seg_ix", "start_ix", "end_ix", "lang_code", "confidence")
        for texts in batches:
            out, some, size = [], [], 0
            for t in [*texts, None]:
                some.append(t)
                size += len(t or "")
                if size > BATCH_CHARS or len(out) + len(some) > len(texts):
                    out += [[dict(zip(names, s)) for s in found] for found in stretches_of(some, profiles)]
                    some, size = [], 0
            yield pd.Series(out[:len(texts)], dtype="object")

    # else the optimizer would compute it once for each place it is used in
    return segment.asNondeterministic()


def language_segments(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Stretches of whole sentences in one language: doc_id, seg_ix, start_ix, end_ix, lang_code, confidence.

    Documents without a sentence (null, empty, numbers or log lines only) give no row. A repeated id is
    treated as another document. Extra columns are ignored.
    """
    parted = df.select(F.col(f"`{doc_id}`").alias(doc_id), _segmenter()(F.col(f"`{text}`")).alias("_segments"))
    return parted.select(doc_id, F.inline("_segments"))


def document_languages(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The main language of every document (most characters) with confidence and number of languages.

    Every row of ``df`` gives one: documents without a sentence (null, empty, numbers or log lines only) have the code
    ``und``, confidence 0 and no language, as have texts that resemble none of the known ones. No row is shuffled.
    """
    parted = df.select(F.col(f"`{doc_id}`").alias(doc_id), _segmenter()(F.col(f"`{text}`")).alias("_s"))
    codes = F.array_distinct(F.transform("_s", lambda x: x["lang_code"]))

    def share(code: Column) -> Column:
        mine = F.filter("_s", lambda x: x["lang_code"] == code)
        chars = F.aggregate(mine, F.lit(0), lambda a, x: a + x["end_ix"] - x["start_ix"])
        weighed = F.aggregate(mine, F.lit(0.0), lambda a, x: a + (x["end_ix"] - x["start_ix"]) * x["confidence"])
        return F.struct(chars.alias("n"), code.alias("lang_code"), F.round(weighed / chars, 4).alias("confidence"))

    main = F.array_max(F.transform(codes, share))
    rows = parted.select(doc_id, main.alias("_m"), F.size(F.filter(codes, lambda c: c != UNKNOWN)).alias("languages"))
    return rows.select(
        doc_id, F.coalesce("_m.lang_code", F.lit(UNKNOWN)).alias("lang_code"), F.coalesce("_m.confidence", F.lit(0.0)).alias("confidence"), F.col("languages").cast("long").alias("languages"),
    )


def mislabelled(df: DataFrame, doc_id: str, text: str, label: str) -> DataFrame:
    """Segments of documents in several languages, or whose label is missing or names another one."""
    parted = df.select(
        F.col(f"`{doc_id}`").alias(doc_id), label_language(F.col(f"`{label}`")).alias("_label"),
        _segmenter()(F.col(f"`{text}`")).alias("_segments"),
    )
    first = F.try_element_at("_segments", F.lit(1)).getField("lang_code")
    wrong = (F.size("_segments") > 1) | F.coalesce(first != F.col("_label"), F.lit(True))
    return parted.where((F.size("_segments") > 0) & wrong).select(doc_id, F.inline("_segments")).where(F.col("lang_code") != UNKNOWN)


def fit_prototypes(labelled: pd.DataFrame, rounds: int = 3) -> np.ndarray:
    """Prototypes from a bounded sample of texts with (partly wrong) labels, columns text and lang_code.

    After each round only the sentences whose best language is their label are bundled again.
    """
    rows = [(s[2], LANGUAGES.index(code)) for text, code in labelled[["text", "lang_code"]].itertuples(index=False) for s in sentences(text or "")]
    vectors = np.stack([bundle(t) for t, _ in rows])
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    codes = np.asarray([c for _, c in rows])
    keep = np.ones(len(rows), dtype=bool)
    for _ in range(rounds):
        sums = np.stack([vectors[keep & (codes == c)].sum(axis=0) for c in range(len(LANGUAGES))])
        unit = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
        keep = (vectors @ unit.T).argmax(axis=1) == codes
    return unit.astype(np.float16)


def train(df: DataFrame, doc_id: str, text: str, label: str, per_language: int = 150) -> np.ndarray:
    """Fit on at most ``per_language`` documents of each label, the ones whose hashed ids come first."""
    named = df.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), label_language(F.col(label)).alias("lang_code"))
    rows = []
    for code in LANGUAGES:
        own = named.where((F.col("lang_code") == code) & F.col("text").isNotNull())
        rows.append(own.orderBy(F.xxhash64("id")).limit(per_language).toPandas())
    return fit_prototypes(pd.concat(rows))
