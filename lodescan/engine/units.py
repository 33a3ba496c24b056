"""What a unit's name says about what it holds: a table of credit cards, an export of passports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodescan.engine.fields import HINTS, field_words
from lodescan.engine.rules import catalogue


def singular(word: str) -> str:
    """Singular of a plural in -ies or -s; short words and those in -ss stay."""
    if len(word) > 4 and word.endswith("ies"):
        return word[:-3] + "y"
    return word[:-1] if len(word) > 3 and word.endswith("s") and not word.endswith("ss") else word


def hinted_detectors(name: str | None) -> list[str]:
    """Detectors whose field patterns name what the words of a unit's name say, as written or in the singular."""
    words = field_words(name).split()
    forms = [" ".join(words), " ".join(map(singular, words))]
    if not words:
        return []
    found = [d for d, pattern in HINTS.items() if any(map(pattern.search, forms))]
    return found + [r.name for r in catalogue() if r.hint and r.name not in HINTS and any(map(r.hint.search, forms))]


def unit_hints(units: DataFrame, unit_id: str = "unit_id", name: str = "unit_name") -> DataFrame:
    """unit_id, unit_name, detector: one row per detector that a unit's name hints at. Each different name is looked at once."""
    names = units.select(F.col(name).alias("_n")).where(F.col("_n").isNotNull()).distinct()
    hints = names.select("_n", F.explode(F.udf(hinted_detectors, "array<string>")("_n")).alias("detector"))
    return units.select(F.col(unit_id).alias("unit_id"), F.col(name).alias("unit_name")).join(hints, F.col("unit_name") == F.col("_n")).select("unit_id", "unit_name", "detector").distinct()
