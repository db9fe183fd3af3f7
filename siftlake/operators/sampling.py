"""Bounded samples that are the same at any partitioning."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounded_sample(df: DataFrame, key: str, rows: int, keep: Column | None = None, salt: int = 0) -> pd.DataFrame:
    """At most `rows` rows for which keep holds, by hash of the key, on the driver.

    The hash range is set by the table's number of rows, which Parquet's footers tell without reading a column: so many
    are drawn that the sample is full if a third of all rows are kept, and fewer come where less are. One scan.
    """
    n = df.count()
    draw = F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(salt)), F.lit(1_000_000))
    part = df if n <= rows else df.where(draw < min(1_000_000, int(3_000_000 * rows / n) + 1))
    part = part if keep is None else part.where(keep)
    return part.orderBy(draw, *[F.col(c) for c in df.columns if c == key]).limit(rows).toPandas()
