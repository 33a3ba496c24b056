"""Text that looks the same, in one form.

Values are mapped character by character (look-alike letters to one prototype, width variants to
the ordinary width, blanks to a space, invisible characters away), grouped under the accent- and
case-sensitive Unicode collation, for which composed and decomposed accents are equal, and every
value is given the canonical member of its group, the least one in code point order.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodescan.runtime import checkpointed, small, spread

COLLATION = "UNICODE"

# Letters of other scripts and their Latin look-alikes.
LOOKALIKES = {
    "Latin": ("ɑɡᴄᴏᴜᴠᴡᴢꜱ", "agcouvwzs"),
    "Cyrillic small": ("асԁеһіјӏорԛѕѵԝху", "acdehijlopqsvwxy"),
    "Cyrillic capital": ("АВСЕԌНІЈКМОРԚЅТѴԜХУӀҮ", "ABCEGHIJKMOPQSTVWXYIY"),
    "Greek small": ("αγινορυϲϳ", "ayivopucj"),
    "Greek capital": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ABEZHIKMNOPTYXCJ"),
    "Armenian": ("օոսհյզցՕՏՍԼ", "onuhjqgOSUL"),
    "Cherokee": ("ᎪᏴᏟᎬᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "ABCEHJKLMPRSTVWZ"),
}
# Signs.
HYPHENS = "‐‑‒–⁃˗−➖"
DOTS = "․ꓸ"
# Fillers and selectors that show nothing although they are no format characters.
FILLERS = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ"
BLANK_LIKE = "\t⠀"
_SAME_SHAPE = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<small>", "<compat>")


def _invisible(c: str) -> bool:
    kind = unicodedata.category(c)
    return (
        kind == "Cf" or (kind == "Cc" and c not in "\t\n\r") or c in FILLERS
        or "︀" <= c <= "️" or "\U000e0100" <= c <= "\U000e01ef"
    )


@lru_cache(1)
def mapping() -> dict[str, str]:
    """Every character whose prototype is another text, by rule from the Unicode data and the fixed values."""
    base: dict[str, str] = {}
    for theirs, ours in LOOKALIKES.values():
        base |= dict(zip(theirs, ours, strict=True))
    base |= dict.fromkeys(HYPHENS, "-") | dict.fromkeys(DOTS, ".") | dict.fromkeys(BLANK_LIKE, " ")
    out: dict[str, str] = {}
    # the planes that hold letters, compatibility forms and format characters
    for code in (*range(0xD800), *range(0xE000, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE0200)):
        c = chr(code)
        if c in base:
            to = base[c]
        elif _invisible(c):
            to = ""
        elif unicodedata.category(c) == "Zs":
            to = " "
        else:
            way = unicodedata.decomposition(c)
            if not way:
                continue
            if way.startswith("<"):
                to = unicodedata.normalize("NFKC", c) if way.startswith(_SAME_SHAPE) else c
                if to[:1].isspace():
                    continue
            else:
                to = c
            parts = unicodedata.normalize("NFD", to)
            to = unicodedata.normalize("NFC", "".join("" if _invisible(x) else base.get(x, x) for x in parts))
        if to != c:
            out[c] = to
    return out


def mapped(value: Column) -> Column:
    """The look-alike-mapped value, in the engine: the whole of ``mapping``.

    Characters that stand for one other or for nothing are translated at once; only values that hold one which stands for
    several are taken apart.
    """
    table = mapping()
    single = {c: to for c, to in table.items() if len(to) == 1}
    gone = "".join(c for c, to in table.items() if to == "")
    several = {c: to for c, to in table.items() if len(to) > 1}
    out = F.translate(value, "".join(single) + gone, "".join(single.values()))
    pairs = F.from_json(F.lit(json.dumps(several)), "map<string,string>")
    wide = F.array_join(F.transform(F.regexp_extract_all(out, F.lit("(?s)(.)"), F.lit(1)), lambda c: F.coalesce(F.try_element_at(pairs, c), c)), "")
    return F.when(F.translate(out, "".join(several), "") != out, wide).otherwise(out)


def canonical_members(values: DataFrame, value: str) -> DataFrame:
    """Each different value and the canonical member of its class: columns ``value``, ``canonical``.

    The canonical member is the least of the class in code point order, found by a combining aggregation and joined back
    by class, so that no class is gathered anywhere. Null has no class and gives no row; values that show nothing share
    the class of the empty text.
    """
    different = values.select(F.col(f"`{value}`").alias("value")).where(F.col("value").isNotNull()).distinct()
    keyed = different.withColumn("_class", F.collate(mapped(F.col("value")), COLLATION))
    classes = keyed.groupBy(F.col("_class").alias("_of")).agg(F.min("value").alias("canonical"))
    return keyed.join(classes, F.col("_class") == F.col("_of")).select("value", "canonical")


def canonicalised(df: DataFrame, column: str, out: str = "canonical") -> DataFrame:
    """``df`` with the canonical form of a column; null stays null."""
    members = canonical_members(df, column).select(F.col("value").alias("_v"), F.col("canonical").alias("_c"))
    joined = df.join(members, F.col(f"`{column}`") == F.col("_v"), "left")
    return joined.select(*[df[f"`{c}`"] for c in df.columns if c != out], F.col("_c").alias(out))


@lru_cache(1)
def _folding() -> dict[int, str]:
    """The same mapping with accents apart, for ``str.translate``."""
    table = {ord(c): unicodedata.normalize("NFD", to) for c, to in mapping().items()}
    for code in range(0xC0, 0x3000):
        c = chr(code)
        parts = unicodedata.normalize("NFD", c)
        if code not in table and parts != c:
            table[code] = parts
    return table


def folded(text: str) -> str:
    return text.translate(_folding())


def _beside(c: str) -> bool:
    return c.isalnum()


def stretches(text: str, automaton) -> list[str]:
    """The stretches of a text that look like one of the automaton's values, as written."""
    flat = folded(text)
    hits = list(automaton.iter(flat))
    if not hits:
        return []
    table, at = _folding(), []
    for i, c in enumerate(text):
        at += [i] * len(table.get(ord(c), c))
    out = set()
    for last, length in hits:
        start, end = last - length + 1, last + 1
        before, after = flat[start - 1:start], flat[end:end + 1]
        if (before and _beside(before)) or (after and (_beside(after) or unicodedata.combining(after))):
            continue
        if (start and at[start - 1] == at[start]) or (end < len(at) and at[end] == at[end - 1]):
            continue
        out.add(text[at[start]:at[end - 1] + 1])
    return sorted(out)


def stretch_finder(values: list[str]):
    """A function of texts that yields the stretches that look like one of the values."""
    patterns = sorted({folded(v) for v in values if v and folded(v)})

    @F.pandas_udf("array<string>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for p in patterns:
            automaton.add_word(p, len(p))
        automaton.make_automaton()
        for texts in batches:
            yield texts.map(lambda t: stretches(t, automaton) if t and patterns else [])

    return find


#: bytes of references that go to every task at once; more are searched for shard by shard
SHARD_BYTES = 32 << 20


def reference_shards(refs: DataFrame, ref_value: str) -> list[list[str]]:
    """The different references in shards of about ``SHARD_BYTES`` at most."""
    listed = refs.select(F.col(f"`{ref_value}`").alias("_v")).where("_v <> ''").distinct()
    size = listed.agg(F.sum(F.octet_length("_v"))).first()[0] or 0
    n = max(1, -(-size // SHARD_BYTES))
    part = F.pmod(F.xxhash64("_v"), F.lit(n))
    return [[r[0] for r in listed.where(part == i).collect()] for i in range(n)]


def lookalikes(
    cells: DataFrame, cell_id: str, cell_value: str, texts: DataFrame, text_id: str, text: str, refs: DataFrame, ref_id: str, ref_value: str,
) -> DataFrame:
    """Whole cells and stretches of texts that look like a reference value without being the same characters.

    Result: src (``cell`` or ``blob``), row_id, ref_id, each once. The stretches of texts are looked for with automata of the
    references; more than ``SHARD_BYTES`` of references are searched for shard by shard, each over all texts. Nulls and
    values that show nothing match nothing. All classes are formed over all cells, stretches and references.
    """
    found = None
    for shard in reference_shards(refs, ref_value):
        part = spread(texts.select(text_id, text)).select(F.col(text_id).alias("row_id"), F.explode(stretch_finder(shard)(F.col(text))).alias("value"))
        found = part if found is None else found.unionByName(part)
    found = checkpointed(found)  # read by the classes and by the result; finding is the dear part
    ours = cells.select(F.lit("cell").alias("src"), F.col(cell_id).alias("row_id"), F.col(cell_value).alias("value"))
    theirs = found.select(F.lit("blob").alias("src"), "row_id", "value")
    rows = ours.unionByName(theirs).where(F.col("value").isNotNull())
    wanted = refs.select(F.col(ref_id).alias("ref_id"), F.col(ref_value).alias("value")).where(F.col("value").isNotNull())
    members = canonical_members(rows.select("value").unionByName(wanted.select("value")), "value")
    named = wanted.join(members, "value").select("ref_id", F.col("value").alias("ref"), F.col("canonical").alias("ref_canonical"))
    pairs = members.join(small(named), F.col("canonical") == F.col("ref_canonical")).where(
        (F.col("value") != F.col("ref")) & (mapped(F.col("value")) != "")
    ).select(F.col("value").alias("v"), "ref_id")
    return rows.join(pairs, F.col("value") == F.col("v")).select("src", "row_id", "ref_id").distinct()
