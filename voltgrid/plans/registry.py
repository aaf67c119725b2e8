"""Named queries with the SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voltgrid.plans.inputs import FX, LATTICES, Tables, fx_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}
VIEWS: dict[str, str] = {}
_NAME = re.compile(r"\b(?:fx|v)_[a-z0-9_]+\b")


def view(name: str, sql: str) -> None:
    """A named sub-query that check SQL may use; names start with ``v_``."""
    VIEWS[name] = sql


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            CHECKS[name] = sql
        return fn
    return register


NUDGE = 1e-9


def _nudged(sql: str) -> str:
    """Give every ``round(x, d)`` with d < 9 the same nudge as the compared query has."""
    out, i = [], 0
    for m in re.finditer(r"(?<![a-z_])round\(", sql):
        if m.start() < i:
            continue
        depth, j, comma = 1, m.end(), None
        while depth:
            ch = sql[j]
            depth += (ch == "(") - (ch == ")")
            if ch == "," and depth == 1:
                comma = j
            j += 1
        out.append(sql[i:m.start()])
        if comma is not None and int(sql[comma + 1:j - 1]) < 9:
            out.append(f"round(({_nudged(sql[m.end():comma])}) + {NUDGE}, {sql[comma + 1:j - 1].strip()})")
        else:
            out.append(f"round({_nudged(sql[m.end():j - 1])})")
        i = j
    return "".join(out) + sql[i:]


def full_sql(sql: str) -> str:
    """Put the input views and named sub-queries that ``sql`` mentions in front of it."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for ref in dict.fromkeys(_NAME.findall(text)):
            if ref in ordered or not (ref in FX or ref in LATTICES or ref in VIEWS):
                continue
            body = VIEWS[ref] if ref in VIEWS else fx_sql(ref)
            visit(body)
            if ref not in ordered:
                ordered.append(ref)

    visit(sql)
    if not ordered:
        return _nudged(sql)
    ctes = ", ".join(f"{n} AS ({VIEWS[n] if n in VIEWS else fx_sql(n)})" for n in ordered)
    body = _nudged(sql.strip())
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    return f"WITH {ctes}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ctes} {body}"
