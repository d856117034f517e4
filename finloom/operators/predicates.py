"""Metadata predicates written as nested dicts, compiled to one Column that Catalyst pushes into the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPARE = {
    "$eq": lambda c, v: c.eqNullSafe(F.lit(v)) if v is None else c == F.lit(v),
    "$ne": lambda c, v: ~c.eqNullSafe(F.lit(v)),
    "$gt": lambda c, v: c > F.lit(v),
    "$gte": lambda c, v: c >= F.lit(v),
    "$lt": lambda c, v: c < F.lit(v),
    "$lte": lambda c, v: c <= F.lit(v),
    "$in": lambda c, v: c.isin(list(v)),
    "$nin": lambda c, v: ~F.coalesce(c.isin(list(v)), F.lit(False)),
}


def compile_where(where: dict | None, aliases: dict[str, str] | None = None) -> Column:
    """``{"a": 1, "b": {"$gte": 2}, "$or": [...]}`` as a Column. Keys side by side must all hold; ``$and`` and ``$or``
    nest; a null value never satisfies a comparison but ``$ne`` and ``$nin``. Unknown operators raise ValueError;
    an empty dict or None holds for every row. ``aliases`` renames fields."""
    parts: list[Column] = []
    for key, value in (where or {}).items():
        if key in ("$and", "$or"):
            if not isinstance(value, list | tuple) or not value:
                raise ValueError(f"{key} takes a list of predicates")
            subs = [compile_where(v, aliases) for v in value]
            parts.append(reduce((lambda a, b: a & b) if key == "$and" else (lambda a, b: a | b), subs))
        elif key.startswith("$"):
            raise ValueError(f"unknown operator {key}")
        else:
            col = F.col((aliases or {}).get(key, key))
            for op, v in (value if isinstance(value, dict) else {"$eq": value}).items():
                if op not in _COMPARE:
                    raise ValueError(f"unknown operator {op}")
                parts.append(_COMPARE[op](col, v))
    return reduce(lambda a, b: a & b, parts, F.lit(True)) if parts else F.lit(True)
