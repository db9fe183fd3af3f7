"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a key from which it is joined by broadcast instead of being sent to one task.
HOT = 100_000


def hot_join(rows: DataFrame, groups: DataFrame, key: str, size: str = "n", hot: int = HOT) -> DataFrame:
    """Inner join of rows with groups, which has one row a key and in `size` at least the number of rows of that key.

    Keys of more than `hot` rows are joined by broadcast: there can be no more of them than rows / hot, so what is
    sent is bounded by the data. All other keys are shuffled, none of them larger than `hot`. Null keys match nothing.
    """
    big = groups.where(F.col(size) > hot)
    rest = groups.where(F.col(size) <= hot)
    wide = rows.join(F.broadcast(big.drop(size)), key)
    narrow = rows.join(F.broadcast(big.select(key)), key, "left_anti").join(rest.drop(size), key)
    return wide.unionByName(narrow)


def shards(rows: DataFrame, key: str, most: int) -> DataFrame:
    """key, shards of the keys with more than `most` rows: how many shards of about that size they make. Keys of fewer have no row, so there are at most rows / most, fit for broadcast."""
    return rows.groupBy(key).agg(F.ceil(F.count("*") / most).alias("shards")).where("shards > 1")


def shard_of(value: Column) -> Column:
    """The shard of a value by its hash, among the row's shards; null shards are one."""
    return F.pmod(F.xxhash64(value), F.coalesce("shards", F.lit(1)))


def by_key(rows: DataFrame, key: str) -> DataFrame:
    """rows with those of a key together in one task, for whole_groups()."""
    return rows.repartition(key).sortWithinPartitions(key)


def whole_groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """The rows of each key at once, of batches in which equal keys follow each other; small groups cost less than in applyInPandas."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        k = pdf[key].to_numpy()
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1), len(k)]
        for lo, hi in zip(cuts, cuts[1:]):
            if held and lo < hi and held[0][key].iloc[0] != k[lo]:
                yield pd.concat(held, ignore_index=True)
                held = []
            held += [pdf.iloc[lo:hi]] if lo < hi else []
    if held:
        yield pd.concat(held, ignore_index=True)
