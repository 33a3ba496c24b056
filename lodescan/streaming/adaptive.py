"""Early stop of a scan whose verdicts have settled.

The rule looks at a scan from its beginning, so it goes in slices of records: after each slice the profiles of the
slice are added to the ones before and the rule is asked. The stop lies at the end of a slice. Every record is scanned
once: a slice's hits are written before its profile is taken.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodescan.engine.policies import policy_for
from lodescan.runtime import checkpointed

LEAST_RECORDS, QUIET_RECORDS, MARGIN = 2000, 1000, 0.05


def settled(seen: int, last_new: int, shares: list[tuple[float, float]], least: int = LEAST_RECORDS, quiet: int = QUIET_RECORDS, margin: float = MARGIN) -> bool:
    """Enough records, no new (column, detector) pair for a while, and no share near its threshold."""
    return seen >= least and seen - last_new >= quiet and all(abs(share - limit) > margin for share, limit in shares)


def scan_until_settled(
    cells: DataFrame, scan: Callable[[DataFrame], DataFrame], *, slice_records: int = 1000, threshold: float | None = None, **rule: float,
) -> tuple[DataFrame, int]:
    """Hits of the records up to the stop and the number of records scanned. ``cells`` has record_ix from 0, column and value.

    A share is measured against the column ratio of its detector's policy, or against ``threshold`` if given. An empty table gives no hits and 0.
    """
    last = cells.agg(F.max("record_ix")).first()[0]
    total = 0 if last is None else last + 1
    known: dict[tuple[str, str], tuple[int, float]] = {}
    values: dict[str, int] = {}
    at, last_new, hits = 0, 0, None
    while at < total:
        part = cells.where((F.col("record_ix") >= at) & (F.col("record_ix") < at + slice_records))
        found = checkpointed(scan(part))
        hits = found if hits is None else hits.unionByName(found)
        at = min(at + slice_records, total)
        category = F.first("category") if "category" in found.columns else F.lit("")
        # a row per column and detector, not per hit
        for column, detector, n, kind in found.groupBy("column", "detector").agg(F.count_distinct("record_ix"), category).collect():
            if (column, detector) not in known:
                last_new = at
            limit = policy_for(detector, kind or "").column_ratio if threshold is None else threshold
            known[column, detector] = (known.get((column, detector), (0, 0))[0] + n, limit)
        for column, n in part.groupBy("column").count().collect():
            values[column] = values.get(column, 0) + n
        if settled(at, last_new, [(n / max(1, values.get(c, 1)), limit) for (c, _), (n, limit) in known.items()], **rule):
            break
    return hits if hits is not None else scan(cells.limit(0)), at
