"""Registered queries: one name, one output layout, one Spark plan and, where SQL can say it, one SQL text.

A layout lists the output columns. ``name*`` rounds a float to six places, ``name*2`` to two,
and ``name$`` shows money in millions; both sides are finished from the same layout.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from equiloom.plans.derived import Derived, Kept, Priced

COLUMN = re.compile(r"^(\w+?)(?:(\*)(\d*)|(\$))?$")
MILLION = 1e6
#: Queries composed of many score tables: they store the bars and quarters once and read those.
COMPOSED = ("a17_", "c01_", "g07_", "g10_", "g11_", "g14_", "g16_", "g17_", "g18_", "g19_", "g20_", "g21_", "g22_", "g23_", "g24_", "g25_", "g26_", "g28_", "g29_", "g31_", "g35_strategy_returns_kelly", "g36_", "g38_", "g39_", "a21_", "c13_", "g60_", "j02_", "k01_", "u01_", "u02_")

#: Queries that read closes several times and no other column of the bars.
CLOSES_ONLY = ("g47_",)


@dataclass(frozen=True)
class Query:
    layout: tuple[tuple[str, int | None, bool], ...]
    plan: Callable[[Derived], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}
VIEWS: dict[str, str] = {}


def _layout(text: str) -> tuple[tuple[str, int | None, bool], ...]:
    out = []
    for item in text.split():
        name, star, places, money = COLUMN.match(item).groups()
        out.append((name, 6 if money else int(places or 6) if star else None, bool(money)))
    return tuple(out)


def add(name: str, layout: str, plan: Callable[[Derived], DataFrame], sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"query {name} is registered twice")
    QUERIES[name] = Query(_layout(layout), plan, sql)


def view(name: str, sql: str) -> None:
    """A named SQL step the oracle texts may use; it is included only where it is used."""
    VIEWS[name] = sql


def run(name: str, spark: SparkSession, directory: str) -> DataFrame:
    query = QUERIES[name]
    columns = []
    for column, places, money in query.layout:
        value = F.col(column) / MILLION if money else F.col(column)
        columns.append((value if places is None else F.round(value, places)).alias(column))
    tables = Kept if name.startswith(COMPOSED) else Priced if name.startswith(CLOSES_ONLY) else Derived
    return query.plan(tables(spark, directory)).select(*columns)


def _used(text: str) -> list[str]:
    """Views a text needs, itself depending on others, in definition order."""
    needed, queue = set(), [text]
    while queue:
        words = set(re.findall(r"\w+", queue.pop()))
        for name in words & VIEWS.keys() - needed:
            needed.add(name)
            queue.append(VIEWS[name])
    return [name for name in VIEWS if name in needed]


def oracle(name: str) -> str | None:
    query = QUERIES[name]
    if query.sql is None:
        return None
    columns = []
    for column, places, money in query.layout:
        value = f"{column} / {MILLION:.0f}" if money else column
        columns.append(column if places is None else f"round({value}, {places}) + 0.0 AS {column}")
    steps = ",\n".join(f"{view_name} AS ({VIEWS[view_name].strip()})" for view_name in _used(query.sql))
    prefix = f"WITH {steps}\n" if steps else ""
    return f"{prefix}SELECT {', '.join(columns)} FROM (\n{query.sql.strip()}\n) AS result"
