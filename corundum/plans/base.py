"""What the query modules share: the registers, views over the driver's tables, rounding."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    names = set(re.findall(r"\{(\w+)\}", sql))
    return spark.sql(sql, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


def plain(sql: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def query(oracle: str, **types: str) -> Callable:
    """Registers a query with its SQL; types: those of columns that differ between the engines, as
    the DataFrame has them."""

    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[fn.__name__] = fn
        casts = ", ".join(f'CAST("{k}" AS {t}) AS "{k}"' for k, t in types.items())
        ORACLES[fn.__name__] = f"SELECT * REPLACE ({casts}) FROM ({plain(oracle)}) typed" if casts else plain(oracle)
        return fn

    return add


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})
