"""All queries of the library and the SQL that gives the same rows."""

from __future__ import annotations

from . import oracles, queries

#: Without SQL, as word differences are beyond it, and hashes of whole texts too slow in it.
_OWN = ("text_diff", "name_diff", "shingle_hashes")

QUERIES = {name: getattr(queries, name) for name in (*oracles.SQL, *_OWN)}
ORACLES: dict[str, str] = dict(oracles.SQL)
