"""Registered queries, and frames of the library's shapes that SQL derives from the given tables.

A frame is one SELECT that Spark and DuckDB read alike: `DIV` stands for integer division, `EACH(n)` for a
row for each number below n. Spark runs it over the tables, the SQL check repeats it as a common
table expression.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FRAMES: dict[str, tuple[tuple[str, ...], str]] = {}


def define(name: str, needs: tuple[str, ...], sql: str) -> None:
    FRAMES[name] = (needs, sql.strip())


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or a derived frame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    needs, sql = FRAMES[name]
    return spark.sql(spark_sql(sql, needs), **{n: frame(spark, sf_dir, n) for n in needs})


def spark_sql(sql: str, needs: tuple[str, ...]) -> str:
    sql = sql.replace("{", "{{").replace("}", "}}")
    for n in needs:
        sql = re.sub(rf"@{n}\b", "{" + n + "}", sql)
    return re.sub(r"EACH\((\d+)\)", r"explode(sequence(0, \1 - 1))", sql)


def duck_sql(sql: str) -> str:
    return re.sub(r"EACH\((\d+)\)", r"unnest(range(\1))", sql).replace(" DIV ", " // ").replace("@", "")


def with_frames(names: tuple[str, ...], sql: str) -> str:
    """sql with the frames it names as common table expressions."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in TABLES or name in order:
            return
        for n in FRAMES[name][0]:
            add(n)
        order.append(name)

    for n in names:
        add(n)
    ctes = [f"{n} AS ({duck_sql(FRAMES[n][1])})" for n in order]
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ", ".join([*ctes, body[15:]])
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join([*ctes, body[5:]])
    return ("WITH " + ", ".join(ctes) + " " if ctes else "") + body


def query(name: str, uses: tuple[str, ...] | str, sql: str | None = None):
    """Registers f(*frames) as query `name`, and sql over the same frames as its check."""
    uses = (uses,) if isinstance(uses, str) else uses

    def add(f: Callable[..., DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(*[frame(spark, sf_dir, u) for u in uses])
        if sql is not None:
            ORACLES[name] = with_frames(uses, sql)
        return f

    return add
