"""Rows of either engine in one form, so that they can be compared without regard to order."""

from __future__ import annotations

import math
from decimal import Decimal


def plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def spark_rows(df) -> list[str]:
    columns = sorted(df.columns)
    return sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())


def duck_rows(con, sql: str) -> list[str]:
    result = con.execute(sql)
    names = [x[0] for x in result.description]
    order = [names.index(n) for n in sorted(names)]
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in result.fetchall())
