"""Sharding by sampled splitters (DataFrame operations only).

Law ``bytes``: shard sizes are nearly equal.  Records are ordered by a key
that begins with a hash of the text, so equal texts are neighbours; or by a
given ``order``, so that a shard is a run of this order and slots follow it.  Key
samples are drawn with a chance in proportion to record size, their quantiles
become range boundaries, ranges that turn out overfull are split again at
quantiles of samples drawn inside them, and a running sum inside each range
plus the sizes of the ranges before it gives every record its exact place in
the byte sequence.  Equal texts are a group, and the middle byte of a group
decides the shard of all its records: a boundary that would fall inside moves to the
group's edge.  Only a group of more than a whole shard is cut, by the middle bytes of
its records.  So a shard differs from the mean by at most half a group (or one record
of a group that is cut) at each end.

What reaches the driver is one number per range; the number of ranges comes
from the shard count and ``spark.sql.shuffle.partitions``, not from the data.

Ranges are cut between groups as long as that helps.  A range that is still
overfull begins with a large group; this gets ranges of its own, cut at places of the identifier's
hash, and the driver, which knows the sizes of all ranges, adds up its size.

Defined cases: null text has no bytes and a CRC of 0; without ``order`` equal
texts stay in one shard if they fit one (texts whose hashes agree in 40 bits count as
equal here); with ``order`` every record is a group; repeated rows get slots of their own; a null identifier is a value like any other; an empty table
gives an empty result; columns beyond the two named ones are not read.
"""

from __future__ import annotations

import bisect
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sqlscore.session import stash

RECORD_BYTES = 8      # fixed cost of a record beside its text
SAMPLES_PER_RANGE = 64
OVERFULL = 2.0        # a range this many times the mean range is split again
TIE_BITS = 24         # low bits of the key: hash of the identifier


def range_of(key: Column, bounds: list[int]) -> Column:
    """How many bounds are <= key: a search among every ``step``-th bound,
    then among the ``step`` bounds of the block found."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    blocks = [bounds[i:i + step] for i in range(0, len(bounds), step)]
    block = F.size(F.filter(F.lit([b[0] for b in blocks]), lambda b: b <= key))
    own = F.get(F.array(*[F.lit(b) for b in blocks]), block - 1)
    return F.when(block == 0, 0).otherwise((block - 1) * step + F.size(F.filter(own, lambda b: b <= key)))


def splitters(rows: DataFrame, wanted: dict[int, int], sizes: dict[int, int], seed: int) -> list[int]:
    """New boundaries: for each range in ``wanted`` so many quantiles, less one,
    of a size-weighted key sample drawn inside it."""
    rate = {r: n * SAMPLES_PER_RANGE / sizes[r] for r, n in wanted.items()}
    if len(sizes) == 1:  # all rows are one range: nothing to join by
        within = rows.withColumn("rate", F.lit(rate[0])).withColumn("pieces", F.lit(wanted[0]).cast("long"))
    else:
        within = rows.join(F.broadcast(rows.sparkSession.createDataFrame(
            [(r, rate[r], n) for r, n in wanted.items()], "range int, rate double, pieces long")), "range")
    draw = F.col("size") * F.col("rate")
    u = F.shiftrightunsigned(F.xxhash64("key", "row_id", F.lit(seed)), 11) / F.lit(float(1 << 53))
    sample = (within
              .withColumn("draws", (F.floor(draw) + (u < draw - F.floor(draw)).cast("long")))
              .filter("draws > 0").groupBy("range", "key", "pieces").agg(F.sum("draws").alias("draws")))
    w = Window.partitionBy("range").orderBy("key")
    all_draws = F.sum("draws").over(Window.partitionBy("range"))
    piece = F.floor((F.sum("draws").over(w) - F.col("draws")) * F.col("pieces") / all_draws)
    cuts = (sample.withColumn("piece", piece).withColumn("last", F.lag("piece").over(w))
            .filter("piece > last").select("key"))
    return sorted({r["key"] for r in cuts.collect()})


def _between_groups(cuts: list[int], bounds: list[int], tie: int) -> set[int]:
    """Cuts moved down to the edges of their groups.  Where all cuts of a range fall on its
    lower bound, its first group is a large one: it gets the cuts as they are, and a bound at its end."""
    by_range: dict[int, list[int]] = {}
    for c in cuts:
        by_range.setdefault(bisect.bisect_right(bounds, c), []).append(c)
    new: set[int] = set()
    for own in by_range.values():
        edges = {c & ~tie for c in own}
        if edges <= set(bounds):
            end = (max(edges) | tie) + 1
            edges = {*own, end} if end < 1 << 63 else set(own)
        new |= edges
    return new


def _split_groups(before: list[tuple[int, int]], sizes: dict[int, int], bounds: list[int], tie: int) -> dict[int, tuple[int, int]]:
    """Start and size of the group, for each range that holds a part of a group with several ranges."""
    large = {b & ~tie for b in bounds if b & tie}
    parts: dict[int, list[tuple[int, int]]] = {}
    for r, start in before:
        low = bounds[r - 1] if r else None  # range r begins at bound r - 1
        if low is not None and low & ~tie in large:
            parts.setdefault(low & ~tie, []).append((r, start))
    return {r: (own[0][1], sum(sizes[x] for x, _ in own)) for own in parts.values() for r, _ in own}


def shard_by_bytes(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text",
                   seed: int = 7, ranges: int | None = None, carry: bool = False,
                   order: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: identifier, ``size``, ``text_crc32``, ``law``,
    ``shard`` (0 to n_shards - 1), ``slot`` (gapless from 0 in each shard) and
    ``grown_shard`` (null under this law).  With ``carry`` a struct ``row`` of all
    columns of ``docs`` stands for the identifier.  ``order``, a long that is not null,
    orders the records in place of their text's hash; equal ones are ordered by identifier."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    tie = (1 << TIE_BITS) - 1
    key = F.xxhash64(text).bitwiseAND(F.lit(~tie)).bitwiseOR(F.xxhash64(id_col).bitwiseAND(F.lit(tie)))
    key = key if order is None else order
    group = key.bitwiseAND(F.lit(~tie)) if order is None else key
    narrow = [F.col(id_col).alias("row_id"), (F.octet_length(text) + RECORD_BYTES).cast("long").alias("size"),
              F.crc32(text.cast("binary")).alias("crc"), key.alias("key"), group.alias("group")]
    rows = stash(docs.select(*narrow), "shard-rows")
    whole = docs.select(*narrow, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")) if carry else rows
    own = "row" if carry else "row_id"
    n_ranges = ranges or max(4 * n_shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    total = rows.agg(F.sum("size")).first()[0] or 0
    bounds: list[int] = []
    sizes = {0: total}
    wanted = {0: n_ranges} if total else {}
    while wanted:
        cuts = splitters(rows.withColumn("range", range_of(F.col("key"), bounds)), wanted, sizes, seed + len(bounds))
        new = _between_groups(cuts, bounds, tie) if order is None else set(cuts)
        if not new - set(bounds):
            break  # what is still overfull holds a single key
        bounds = sorted({*bounds, *new})
        sizes = dict(rows.groupBy(range_of(F.col("key"), bounds).alias("range")).agg(F.sum("size")).collect())
        wanted = {r: math.ceil(s * n_ranges / total) for r, s in sizes.items() if s * n_ranges > OVERFULL * total}
    before, at = [], 0
    for r in sorted(sizes):
        before.append((r, at))
        at += sizes[r]
    split = _split_groups(before, sizes, bounds, tie) if order is None else {}
    offsets = spark.createDataFrame([(r, start, *split.get(r, (None, None))) for r, start in before],
                                    "range int, before long, first long, group_size long")
    w = Window.partitionBy("range").orderBy("group", "key", "row_id", "crc", "size")
    end = F.col("before") + F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    same = Window.partitionBy("range", "group")
    start = F.coalesce("first", F.min("start").over(same)) if order is None else F.col("start")
    size = F.coalesce("group_size", F.sum("size").over(same)) if order is None else F.col("size")
    fits = F.col("whole") * n_shards <= F.lit(total)
    middle = F.when(fits, 2 * F.col("begin") + F.col("whole")).otherwise(2 * F.col("start") + F.col("size"))
    place = F.floor(middle * n_shards / F.lit(2 * max(total, 1)))
    ranged = whole.withColumn("range", range_of(F.col("key"), bounds)).join(F.broadcast(offsets), "range")
    ranged = ranged.withColumn("start", end - F.col("size")).withColumn("begin", start).withColumn("whole", size)
    placed = stash(ranged.select(own, "size", "crc", "range", F.least(place, F.lit(n_shards - 1)).cast("int").alias("shard"),
                           F.row_number().over(w).cast("long").alias("nth")), "shard-placed")
    # at most one row per range and shard that meet: ranges + shards rows
    meet = placed.groupBy("range", "shard").agg(F.count("*").alias("n"), F.min("nth").alias("first"))
    starts = meet.select("range", "shard", "first", (F.sum("n").over(
        Window.partitionBy("shard").orderBy("range")) - F.col("n")).alias("earlier"))
    return placed.join(F.broadcast(starts), ["range", "shard"]).select(
        F.col(own).alias("row" if carry else id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", (F.col("earlier") + F.col("nth") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
