"""Differences between consecutive full snapshots by Merkle trees over hash ranges of the keys."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.functions.text import collapse
from siftlake.functions.urls import canonical_url
from siftlake.session import cut

#: Keys that a leaf of the tree is meant to hold, so that most leaves of a snapshot with a few per cent of changes are
#: alike; bits of the key hash that one level of the tree takes, and that number the leaves at most.
LEAF_KEYS, STEP_BITS, MOST_BITS = 8, 4, 32


def page_states(pages: DataFrame) -> DataFrame:
    """The state of each canonical URL in each run: run_id, key, digest of the text with white space collapsed.

    Of several rows the one with the latest fetched_at counts (a null one is the earliest, ties go to the larger
    page_id). Rows without run_id or without any URL belong to no snapshot. Texts never leave the scan: a digest does.
    """
    text = collapse(F.col("text"))
    rows = pages.select(
        "run_id", canonical_url(F.coalesce("url", "final_url")).alias("key"), "fetched_at", "page_id",
        F.xxhash64(text).alias("d"),
    )
    latest = F.max(F.struct("fetched_at", "page_id", "d")).alias("s")
    return rows.where("run_id is not null and key is not null").groupBy("run_id", "key").agg(latest).select("run_id", "key", F.col("s.d").alias("digest"))


def run_order(runs: DataFrame) -> list[int]:
    """The calendar's run ids in order. One row for each snapshot taken: a small table at any size of the data."""
    return sorted(r[0] for r in runs.select("run_id").where("run_id is not null").distinct().collect())


def _sides(df: DataFrame, ids: list[int], *keep: Column | str) -> DataFrame:
    """Each row twice: as the present of its own snapshot's comparison and as the past of the next one's."""
    following = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).cast("bigint").alias("n")) for i, n in zip(ids, [*ids[1:], None])])
    other = F.try_element_at(F.filter(following, lambda p: p["i"] == F.col("run_id")), F.lit(1))["n"]
    both = F.explode(F.array(F.struct(F.col("run_id").cast("bigint").alias("run"), F.lit(True).alias("now")), F.struct(other.alias("run"), F.lit(False).alias("now"))))
    return df.where(F.col("run_id").isin(ids)).select(both.alias("side"), *keep).select("side.run", "side.now", *keep).where("run is not null")


def snapshot_changes(states: DataFrame, runs: DataFrame, leaf_bits: int | None = None, step_bits: int = STEP_BITS) -> DataFrame:
    """run_id, key, change_kind (added, removed, changed) of every snapshot but the first against the one before it.

    states: run_id, key, digest, one row for each key of a snapshot; runs: the snapshots' run_id (a row for each, so its
    size is that of the calendar), which follow each other in their order. A snapshot without rows is an empty one.
    Keys fall into 2^leaf_bits hash ranges, by default so many that a leaf holds LEAF_KEYS keys of a snapshot. A leaf's digest is the exclusive or of its rows' hashes with their count, an
    inner node's is made of its children's; from the root down only children of nodes that differ are compared, and
    rows only within leaves that differ. All groups are pre-aggregated before they are shuffled, so that no bucket or
    key can be hot. Empty tables give an empty result.
    """
    ids = run_order(runs)
    if len(ids) < 2:
        return states.select("run_id", "key", F.lit("added").alias("change_kind")).limit(0)
    rows = cut(states.where(F.col("run_id").isin(ids)).select("run_id", "key", "digest"))
    leaf_bits = leaf_bits or min(MOST_BITS, max(STEP_BITS, math.ceil(math.log2(max(1, rows.count() / len(ids) / LEAF_KEYS)))))
    rows = rows.withColumn("leaf", F.shiftrightunsigned(F.xxhash64("key"), 64 - leaf_bits))
    node = lambda bits: F.shiftright("leaf", leaf_bits - bits)
    digests = rows.groupBy("run_id", "leaf").agg(F.bit_xor(F.xxhash64("key", "digest")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "digest", "key")).alias("y"), F.count("*").alias("n"))
    digests = cut(_sides(digests, ids, "leaf", "x", "y", "n").where(F.col("run") != ids[0]))
    differ = None
    for bits in [*range(0, leaf_bits, step_bits), leaf_bits]:
        at = digests.withColumn("node", node(bits))
        if differ is not None:
            parent = F.shiftright("node", bits - last)
            at = at.withColumn("up", parent).join(differ.withColumnRenamed("node", "up"), ["run", "up"], "left_semi")
        side = lambda now: F.bit_xor(F.when(F.col("now") == now, F.xxhash64("leaf", "x", "y", "n")))
        differ = at.groupBy("run", "node").agg(side(True).alias("a"), side(False).alias("b")).where("not (a <=> b)").select("run", "node")
        last = bits
    changed = differ.withColumnRenamed("node", "leaf")
    following = F.create_map(*[F.lit(x).cast("bigint") for i, n in zip(ids, ids[1:]) for x in (i, n)])
    side = lambda run, now: rows.withColumn("run", run).join(changed, ["run", "leaf"], "left_semi").select("run", F.lit(now).alias("now"), "key", "digest")
    near = side(F.col("run_id").cast("bigint"), True).unionAll(side(F.try_element_at(following, F.col("run_id").cast("bigint")), False))
    value = lambda now: F.max(F.when(F.col("now") == now, F.col("digest")))
    pairs = near.groupBy("run", "key").agg(value(True).alias("a"), value(False).alias("b")).where("not (a <=> b)")
    kind = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").otherwise("changed")
    return pairs.select(F.col("run").alias("run_id"), "key", kind.alias("change_kind"))


def page_changes(pages: DataFrame, runs: DataFrame) -> DataFrame:
    """run_id, canonical_url, change_kind of the pages' snapshots; content_hash and status_code play no part."""
    return snapshot_changes(page_states(pages), runs).withColumnRenamed("key", "canonical_url")
