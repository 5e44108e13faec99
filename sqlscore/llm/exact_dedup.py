"""Exact dedup: a tree merge of sorted digest runs.

Every task turns its rows into a run: digests in order, one entry each with
the smallest identifier (with its row's number) and a count.  The tasks then exchange runs in
binomial rounds over a hypercube of 2**b slots: in each round ``radix_bits``
bits of the slot number are replaced by the same bits of the digest, so a
slot swaps parts of its run with the 2**radix_bits - 1 slots that differ from
it in those bits, merges what it gets and passes on only the merged run.
After all rounds a slot holds every entry whose digest begins with its
number.  Copies meet early and travel on as one entry, so a group that holds
a third of all rows costs one entry per task from the first level on.

Equality is verified at every level: entries merge only if the SHA-256, the
byte length and an independent 64-bit hash of the normalised text all agree.

Defined cases: null text counts as empty; texts are processed whole; a null
identifier is larger than any other and stays only if its group has no
other; repeated rows are members like any other, so a group's size counts
rows, and of rows that share the smallest identifier the first read stays; columns beyond the two named ones are not read, so clashing names don't
matter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlscore.session import stash

WHITESPACE = r"[\x20\x09-\x0D]+"
KEY = ["digest", "n_bytes", "check"]


def merge_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold a stream sorted by key and identifier (nulls last) into one entry
    per key: the first identifier and the sum of counts.  Holds one batch."""
    carry = None  # the last, still open entry
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch] if carry is None else [carry, batch]).combine_chunks()
        digest = np.array(table["digest"].to_pylist(), dtype="S32")
        rest = np.stack([table[c].to_numpy() for c in ("n_bytes", "check")])
        new = np.ones(table.num_rows, dtype=bool)
        new[1:] = (digest[1:] != digest[:-1]) | (rest[:, 1:] != rest[:, :-1]).any(axis=0)
        first = np.flatnonzero(new)
        merged = table.take(pa.array(first)).set_column(
            table.schema.get_field_index("n"), table.schema.field("n"),
            pa.array(np.add.reduceat(table["n"].to_numpy(), first)))
        out = merged.combine_chunks().to_batches()[0]
        carry = out.slice(out.num_rows - 1)
        if out.num_rows > 1:
            yield out.slice(0, out.num_rows - 1)
    if carry is not None:
        yield carry


def merge_runs(entries: DataFrame) -> DataFrame:
    """One sorted run per partition (Spark's sort merges the fetched pieces and spills)."""
    ordered = entries.sortWithinPartitions(*KEY, F.col("keep_id").asc_nulls_last(), "keep_no")
    return ordered.mapInArrow(merge_sorted, entries.schema)


def tree_merge(entries: DataFrame, slots_log2: int, radix_bits: int = 3) -> DataFrame:
    """Merge ``digest, n_bytes, check, keep_id, keep_no, n`` in ceil(slots_log2 / radix_bits) rounds."""
    slots = 1 << slots_log2
    prefix = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    runs = merge_runs(entries)
    for low in range(0, slots_log2, radix_bits):
        bits = ((1 << min(radix_bits, slots_log2 - low)) - 1) << low
        own = F.pmod(F.spark_partition_id(), F.lit(slots)).cast("long")
        slot = own.bitwiseAND(F.lit(slots - 1 - bits)).bitwiseOR(prefix.bitwiseAND(F.lit(bits)))
        runs = merge_runs(runs.repartitionById(slots, slot.cast("int")))
    return runs


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                radix_bits: int = 3) -> DataFrame:
    """One row per row of ``docs``: identifier, ``keep_id`` (smallest identifier of
    the group of equal texts), ``group_size``, ``kept`` and ``text_sha256``."""
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), WHITESPACE, " ")
    rows = stash(docs.select(F.col(id_col), text.alias("text"))
                 .select(F.col(id_col).alias("row_id"), F.unhex(F.sha2("text", 256)).alias("digest"),
                         F.octet_length("text").cast("long").alias("n_bytes"), F.xxhash64("text").alias("check"),
                         F.monotonically_increasing_id().alias("row_no")), "exact-rows")
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entries = rows.select(*KEY, F.col("row_id").alias("keep_id"), F.col("row_no").alias("keep_no"), F.lit(1).cast("long").alias("n"))
    groups = stash(tree_merge(entries, max(1, (partitions - 1).bit_length()), radix_bits)
                   .withColumnRenamed("n", "group_size"), "exact-groups")
    return rows.join(groups, KEY).select(
        F.col("row_id").alias(id_col), "keep_id", "group_size",
        (F.col("row_no") == F.col("keep_no")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
