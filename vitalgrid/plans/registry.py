"""Registry of named queries and the SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vitalgrid.session import configure
from vitalgrid.sources.tables import as_zoneless
from vitalgrid.sources.views import Dataset, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(
    name: str, oracle: str | None = None, views: list[str] = (), steps: list[tuple[str, str]] = (), inline: bool = False
):
    """Register ``fn(dataset) -> DataFrame`` with the statement that must give the same rows.

    ``inline`` has the checking engine expand views in place: its shared copies
    of a view fail on some plans with text columns.
    """

    def register(fn: Callable[[Dataset], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return as_zoneless(fn(Dataset(configure(spark), folder)))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            prefix = with_views(list(views), "duckdb", list(steps))
            if inline:
                prefix = re.sub(r"(^WITH |\n)(v_\w+) AS \(", r"\1\2 AS NOT MATERIALIZED (", prefix)
            ORACLES[name] = f"{prefix}\n{oracle}".strip()
        return fn

    return register
