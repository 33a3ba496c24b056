"""The named queries of the engine and, where SQL can say the same, their SQL."""

from __future__ import annotations

from lodescan.plans import nested, pipeline, values


def _merged(attribute: str) -> dict:
    out: dict = {}
    for module in (nested, pipeline, values):
        out |= getattr(module, attribute)
    return out


QUERIES = _merged("QUERIES")
ORACLES = _merged("ORACLES")
