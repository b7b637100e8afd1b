"""Comparison of a query with its oracle, the way the driver does it: columns by name, rows in any order."""

from __future__ import annotations


def _value(x):
    return round(x, 6) + 0.0 if isinstance(x, float) else x


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(_value(r[c]) for c in columns) for r in df.collect()), key=repr)


def rows_of_sql(duck, sql):
    found = duck.sql(sql)
    columns = sorted(found.columns)
    at = [found.columns.index(c) for c in columns]
    return columns, sorted((tuple(_value(r[i]) for i in at) for r in found.fetchall()), key=repr)
