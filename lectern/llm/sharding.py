"""Histogram sort into shards of near-equal bytes.

Rows are ordered by (md5 of the text, doc_id), so equal texts stand together. The driver keeps the few key
prefixes that hold one of the shards - 1 boundaries; each round counts, on the executors, the exact bytes and rows below
finer probes inside those prefixes only, until each boundary is a single row or a group of equal texts that may stay
whole. Then one exchange by ranges of the key gives every row its place in the order, and with the counts of the ranges
its slot. The driver sees at most (shards - 1) * 4096 counts a round, whatever the number of rows.

A boundary that falls into a group of equal texts moves to the group's nearer end if that is at most half of
`tolerance` of a shard away, so shards stay within `tolerance` of equal size; a group that cannot move so is split.

Defined cases: a null text has size 1 and the crc32 of no bytes; a null doc_id sorts first among equal texts;
rows equal in text and doc_id are ties and get neighbouring slots; an empty table gives an empty result; extra columns
are ignored. A very long text counts as one row; only its size and hashes are moved.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import forget, keep

#: Lengths of the key prefixes probed in turn: hexadecimal digits of md5 (32), then of doc_id (16).
PROBES = (3, 6, 9, 32, 35, 38, 41, 44, 47, 48)
TEXT_DIGITS = 32
#: Shards are within this share of equal size.
TOLERANCE = 0.02


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the sort key of every row."""
    body = F.coalesce(F.col("text"), F.lit(""))
    ordered = F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(2**63)).cast("long"))
    digits = F.lpad(F.coalesce(F.lower(F.hex(ordered)), F.lit("")), 16, "0")
    return docs.select(
        F.col("doc_id"),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.concat(F.md5(body.cast("binary")), digits).alias("key"),
    )


def splitters(rows: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[str]:
    """Keys S_1 <= ... <= S_(shards-1): a row belongs to shard r if exactly r of them are <= its key.

    A boundary falls on the nearer side of the unit it cuts: a row, or a group of equal texts whose nearer side lies
    within tolerance / 2 of a shard.
    """
    found: dict[int, str] = {}
    active: dict[str, tuple[int, list[int]]] = {"": (0, list(range(1, shards)))}
    total = 0
    for before, length in zip((0, *PROBES), PROBES, strict=False):
        if not active:
            break
        part = rows if before == 0 else rows.where(F.left("key", F.lit(before)).isin(list(active)))
        counted = part.groupBy(F.left("key", F.lit(length)).alias("p")).agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
        children: dict[str, list] = {}
        for r in sorted(counted):
            children.setdefault(r.p[:before], []).append(r)
        if before == 0:
            total = sum(r.b for r in counted)
            if not total:
                return []
        following: dict[str, tuple[int, list[int]]] = {}
        for prefix, (below, wanted) in active.items():
            at, todo = below, list(wanted)
            for r in children.get(prefix, []):
                end = at + r.b
                while todo and todo[0] * total <= end * shards:
                    j = todo.pop(0)  # its goal is j * total / shards
                    after, short = j * total - at * shards, end * shards - j * total
                    if after <= 0:
                        found[j] = r.p
                    elif short == 0:
                        found[j] = r.p + "g"
                    elif r.n == 1 or length == PROBES[-1] or (length == TEXT_DIGITS and 2 * min(after, short) <= tolerance * total):
                        found[j] = r.p if short >= after else r.p + "g"
                    else:
                        following.setdefault(r.p, (at, []))[1].append(j)
                at = end
            for j in todo:
                found[j] = prefix + "g"
        active = following
    return [found[j] for j in range(1, shards)]


def histogram_sort(docs: DataFrame, shards: int = 8, tolerance: float = TOLERANCE, rows_per_range: int = 500_000) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row; sizes of shards near equal, slots gapless from 0."""
    spark = docs.sparkSession
    rows = keep(keyed(docs), "shard-keys")
    cuts = splitters(rows, shards, tolerance)
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / rows_per_range))
    shard = reduce(lambda a, c: a + (F.col("key") >= c).cast("int"), cuts, F.lit(0))
    # The exchange: the number that a row is given holds its range and its place in it.
    ordered = rows.repartitionByRange(ranges, "key").sortWithinPartitions("key", "size").withColumn("at", F.monotonically_increasing_id())
    placed = keep(ordered.select("doc_id", "size", "text_crc32", shard.alias("shard"), F.shiftright("at", 33).alias("range"), F.col("at").bitwiseAND(F.lit(2**33 - 1)).alias("place")), "placed")
    forget(rows)
    counts = placed.groupBy("shard", "range").agg(F.count("*").alias("n"), F.min("place").alias("low"))
    # As many rows as there are ranges, and one more for each boundary.
    earlier = F.sum("n").over(Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("shard", "range", (F.coalesce(earlier, F.lit(0)) - F.col("low")).alias("offset"))
    return placed.join(F.broadcast(keep(offsets, "offsets")), ["shard", "range"]).select("doc_id", "size", "text_crc32", "shard", (F.col("place") + F.col("offset")).cast("long").alias("slot"))
