"""SQL that reads field names as the engine does: words, kinds and hints."""

from __future__ import annotations

import re

from lodescan.engine.fields import COUNTER, CREDENTIAL, IDENTIFIER, PERSONAL_ID, VOCABULARY


def words_of(names: str, before: str = "") -> str:
    """CTEs up to ``words(name, words)``: the names of a query cut at signs, humps and, where a run of letters is made of known words, between those.

    All ways to cut a run into known words are built up; of the whole ones that with the longest first pieces counts. ``before``: CTEs that come first.
    """
    start = before.replace("WITH ", "WITH RECURSIVE ", 1) + ", " if before else "WITH RECURSIVE "
    chunks = r"list_filter(regexp_split_to_array(name, '[^\p{L}\p{N}]+'), lambda x: x <> '')"
    return start + rf"""names AS ({names}),
chunks AS (SELECT name, unnest({chunks}) AS chunk, generate_subscripts({chunks}, 1) AS i FROM names),
humps AS (SELECT name, i, string_split(regexp_replace(regexp_replace(chunk, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), ' ') AS parts FROM chunks),
pieces AS (SELECT name, i, unnest(parts) AS piece, generate_subscripts(parts, 1) AS k FROM humps),
runs AS (SELECT DISTINCT lower(piece) AS run FROM pieces),
known(w) AS (VALUES {', '.join(f"('{w}')" for w in sorted(VOCABULARY))}),
cuts AS (SELECT run, 0::BIGINT AS upto, []::VARCHAR[] AS parts, []::BIGINT[] AS sizes FROM runs WHERE length(run) >= 6 AND regexp_full_match(run, '\p{{L}}+')
  UNION ALL SELECT run, upto + length(w), list_append(parts, w), list_append(sizes, length(w)) FROM cuts JOIN known ON substr(run, upto + 1, length(w)) = w),
best AS (SELECT run, parts FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY sizes DESC) AS rn FROM cuts WHERE upto = length(run) AND len(parts) > 1) WHERE rn = 1),
words AS (SELECT n.name, coalesce(string_agg(coalesce(array_to_string(b.parts, ' '), lower(p.piece)), ' ' ORDER BY p.i, p.k), '') AS words
  FROM (SELECT DISTINCT name FROM names) n LEFT JOIN pieces p USING (name) LEFT JOIN best b ON b.run = lower(p.piece) GROUP BY n.name)"""


def described(hints: dict[str, re.Pattern]) -> str:
    """CTEs ``hinted(name, detector)`` and ``kinds(name, kind, counter)`` after those of ``words_of``."""
    values = ", ".join(f"('{d}', '{p.pattern}')" for d, p in hints.items())

    def last(p: re.Pattern) -> str:
        rest = f"list_last(string_split(regexp_replace(words, '{p.pattern}', chr(1), 'g'), chr(1)))"
        return f"CASE WHEN regexp_matches(words, '{p.pattern}') THEN length(words) - length({rest}) ELSE -1 END"

    return f""", hinted AS (SELECT name, detector FROM words, (VALUES {values}) h(detector, pattern) WHERE words <> '' AND regexp_matches(words, pattern)),
ends AS (SELECT name, words, {last(CREDENTIAL)} AS cred, {last(IDENTIFIER)} AS ident, regexp_matches(words, '{PERSONAL_ID.pattern}') AS person FROM words),
kinds AS (SELECT name, CASE WHEN cred < 0 AND (ident < 0 OR person) THEN NULL WHEN cred >= ident OR (person AND cred >= 0) THEN 'credential' ELSE 'identifier' END AS kind,
  regexp_matches(words, '{COUNTER.pattern}') AND NOT person AS counter FROM ends)"""
