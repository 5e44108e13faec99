"""Mixing sources to target weights by Pfair scheduling (DataFrame operations only).

The rows of a source, in an order drawn from a hash, form
blocks of ``block_rows`` rows.  Block k of a source of weight w is released
at slot floor(k/w) and has its deadline at ceil((k+1)/w); every slot goes to
the released block with the earliest deadline.  On one sequence this meets
all deadlines, so after any number t of slots a source has had between
w*t - 1 and w*t + 1 blocks, both exclusive.

Weights are whole parts, so the sequence repeats after sum(parts) slots: only
this period is laid out, from the parameters alone, and a block finds its slot
by arithmetic and a lookup in the period.  When a source has no block left,
the others go on in proportion to their parts (a new phase with a period of
its own); there are at most as many phases as sources, and no row is dropped.

Blocks need each row's number within its source.  A source is cut at fixed
places of the hash range into chunks of at most about ``CHUNK_ROWS`` rows; rows are
numbered inside chunks and chunk sizes are summed up, so a source that holds a
third of all rows is spread like the others.  The hash is of the identifier and the
whole row, so rows that share an identifier are spread, too.

Defined cases: sources that are not named in ``parts``, null among them, share
``rest_parts``; the last block of a source may be short; rows that share an
identifier, null among them, come in an order drawn from their other columns, and
rows that are equal in all columns share a chunk, in any order; an empty table gives
an empty result; a text only counts as part of its row.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sqlscore.session import stash

CHUNK_ROWS = 1024


def period(parts: dict[int, int]) -> dict[int, list[int]]:
    """For each source the slots of its blocks in one period of sum(parts) slots."""
    total = sum(parts.values())
    ready: list[tuple[int, int, int]] = []
    later = [(0, s, 0) for s in parts]  # (release, source, block)
    heapq.heapify(later)
    slots: dict[int, list[int]] = {s: [] for s in parts}
    for t in range(total):
        while later and later[0][0] <= t:
            _, s, k = heapq.heappop(later)
            heapq.heappush(ready, (-(-(k + 1) * total // parts[s]), s, k))
        _, s, k = heapq.heappop(ready)
        slots[s].append(t)
        if k + 1 < parts[s]:
            heapq.heappush(later, ((k + 1) * total // parts[s], s, k + 1))
    return slots


def phases(parts: dict[int, int], blocks: dict[int, int]) -> tuple[list[tuple], list[tuple]]:
    """Phase rows (source, phase, first block, end block, parts, period, start
    slot) and period rows (phase, source, block in period, slot in period)."""
    left = {s: n for s, n in blocks.items() if n}
    done, start, plan, layout = dict.fromkeys(left, 0), 0, [], []
    for phase in range(len(left)):
        if not left:
            break
        active = {s: parts[s] for s in left}
        slots, total = period(active), sum(active.values())
        length = min((n - 1) // active[s] * total + slots[s][(n - 1) % active[s]] + 1 for s, n in left.items())
        for s in list(left):
            n = length // total * active[s] + sum(x < length % total for x in slots[s])
            if n:
                plan.append((s, phase, done[s], done[s] + n, active[s], total, start))
                done[s], left[s] = done[s] + n, left[s] - n
            if not left[s]:
                del left[s]
        layout += [(phase, s, j, x) for s in active for j, x in enumerate(slots[s])]
        start += length
    return plan, layout


def pfair_mix(rows: DataFrame, parts: dict[str, int], rest_parts: int = 1, block_rows: int = 16,
              id_col: str = "doc_id", source_col: str = "source", seed: int = 11) -> DataFrame:
    """``row`` (a struct of all columns of ``rows``), ``block`` (number within
    the source), ``slot`` (place of the block in the mix) and ``place`` (of the
    row in its block): by slot and place, the rows are in mixed order."""
    spark = rows.sparkSession
    names = sorted(parts)
    weights = dict(enumerate([*(parts[n] for n in names), rest_parts]))
    if min(weights.values()) < 1:
        raise ValueError("parts are whole numbers from 1")
    own = spark.createDataFrame([*enumerate(names)], "mix_source int, name string")
    columns = [F.col(f"`{c}`") for c in rows.columns]
    content = [F.to_json(F.struct(*columns))] if "map<" in rows.schema.simpleString() else columns  # maps have no hash
    base = (rows.select(F.struct(*columns).alias("row"), F.col(source_col).cast("string").alias("name"),
                        F.xxhash64(F.col(id_col), *content, F.lit(seed)).alias("u"),
                        F.xxhash64(*content, F.lit(seed + 1)).alias("tie"), F.col(id_col).alias("mix_id"))
            .join(F.broadcast(own), "name", "left")  # as long as the parameter
            .select("row", "mix_id", "u", "tie", F.coalesce("mix_source", F.lit(len(names))).alias("mix_source")))
    n_chunks = rows.count() // CHUNK_ROWS + 1
    chunk = F.shiftright(F.shiftrightunsigned(F.col("u").bitwiseXOR(F.lit(-1 << 63)), 33) * n_chunks, 31)
    base = base.withColumn("chunk", chunk)
    sizes = stash(base.groupBy("mix_source", "chunk").agg(F.count("*").alias("n")), "mix-sizes")
    counts = {r["mix_source"]: r["n"] for r in sizes.groupBy("mix_source").agg(F.sum("n").alias("n")).collect()}
    plan, layout = phases(weights, {s: -(-n // block_rows) for s, n in counts.items()})
    before = sizes.select("mix_source", "chunk", (F.sum("n").over(
        Window.partitionBy("mix_source").orderBy("chunk")) - F.col("n")).alias("before"))
    nth = F.row_number().over(Window.partitionBy("mix_source", "chunk").orderBy("u", "mix_id", "tie")) - 1
    numbered = (base.join(before, ["mix_source", "chunk"]).withColumn("nth", F.col("before") + nth)
                .select("row", "mix_source", F.expr(f"nth div {block_rows}").alias("block"),
                        (F.col("nth") % block_rows).cast("int").alias("place")))
    plan_rows = spark.createDataFrame(plan, "mix_source int, phase int, first long, end long, parts long, "
                                            "period long, start long")
    layout_rows = spark.createDataFrame(layout, "phase int, mix_source int, nth_in_period long, at long")
    k = F.col("block") - F.col("first")
    return (numbered.join(F.broadcast(plan_rows), "mix_source")  # sources x phases rows
            .filter((F.col("block") >= F.col("first")) & (F.col("block") < F.col("end")))
            .withColumn("nth_in_period", k % F.col("parts"))
            .join(F.broadcast(layout_rows), ["phase", "mix_source", "nth_in_period"])  # phases x parts rows
            .select("row", "block", (F.col("start") + F.expr("(block - first) div parts") * F.col("period")
                                     + F.col("at")).alias("slot"), "place"))
