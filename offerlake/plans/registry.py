"""Registry of driver queries: name -> (spark builder, oracle SQL or None).

A builder takes (spark, sf_dir) and returns a DataFrame over the whole input
tables. The oracle SQL is the same computation for DuckDB over the same
Parquet views; ``None`` means no SQL form (rows-only check plus own tests).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlake.sources.offers import OFFERS_SQL

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

DIGITS = 4  # final doubles are rounded to this many decimals on both sides


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def with_offers(body: str, extra: str = "") -> str:
    """Prefix oracle SQL with the proxy offers view (plus optional extra CTEs)."""
    more = f",\n{extra}" if extra else ""
    return f"WITH offers AS ({OFFERS_SQL}){more}\n{body}"


def finish(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double column; widen integers to bigint (same types as DuckDB)."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            # round(x * 10^d) / 10^d on the binary value, as DuckDB's round(x, d) does;
            # Spark's round(x, d) rounds the shortest decimal string, which differs on ties
            scale = float(10 ** digits)
            out.append((F.round(c.cast("double") * scale, 0) / scale).alias(f.name))
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            out.append(c.cast("long").alias(f.name))
        else:
            out.append(c)
    return df.select(*out)
