"""Registry of runnable queries and of the SQL each is checked against."""

from __future__ import annotations

import re

from .testviews import VIEWS

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

SPREAD = ["lineitem", "orders", "events", "documents", "pages", "customer", "conversations"]

QUERIES: dict = {}
ORACLES: dict = {}


def _needs(sql: str, found: list, within: tuple = ()) -> list:
    for name, body in VIEWS.items():
        if name not in found and name not in within and re.search(rf"\b{name}\b", sql):
            _needs(body, found, (*within, name))
            found.append(name)
    return found


def with_views(sql: str) -> str:
    """Prefix a statement with the CTEs of the views it names."""
    order = _needs(sql, [])
    head = "WITH "
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        head, body, join = "WITH RECURSIVE ", body[15:], ",\n"
    elif body.upper().startswith("WITH "):
        body, join = body[5:], ",\n"
    else:
        join = "\n"
    if not order:
        return sql.strip()
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in order)
    return head + ctes + join + body


class Tables:
    """Input of a query: raw parquet tables and the views derived from them."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def raw(self, name: str):
        """A table. One that lies in fewer files than there are cores is spread first, as the views below
        derive whole texts from its rows; a table of many files is read as it lies."""
        df = self.spark.read.parquet(f"{self.path}/{name}.parquet")
        cores = self.spark.sparkContext.defaultParallelism
        if name in SPREAD and len(df.inputFiles()) < cores:
            return df.repartition(cores)
        return df

    def sql(self, statement: str):
        full = with_views(statement)
        for name in TABLES:
            if re.search(rf"\b{name}\b", full):
                self.raw(name).createOrReplaceTempView(name)
        return self.spark.sql(full)

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        return self.sql(f"SELECT * FROM {name}") if name in VIEWS else self.raw(name)


def query(name: str, sql: str | None = None):
    """Register ``fn(Tables) -> DataFrame`` under a name, with its SQL twin where one exists."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark, sf_dir):
            return fn(Tables(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn
    return deco
