"""Corpus pipeline: toxicity, near-dedup, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet and read again as the next stage's ``docs``.  All stages but
the last return the columns they were given.  Rows are told apart by their
identifier together with their text, so a null or repeated identifier costs no
other row its place; an empty table passes through as an empty table.

The mix stage hands its order on as the places of the rows it writes: part files
are in range order.  The shard stage reads these places (file and row number), so
a shard is a run of the mix.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlscore.llm.decontaminate import decontaminate as contaminated_by
from sqlscore.llm.mixing import pfair_mix
from sqlscore.llm.settings import MIX_BLOCK_ROWS, MIX_PARTS, MIX_REST_PARTS, N_SHARDS, toxicity_categories
from sqlscore.llm.sharding import shard_by_bytes
from sqlscore.llm.simhash import keep_one, simhash_dedup
from sqlscore.llm.toxicity import toxicity_chain
from sqlscore.session import drop_scratch, scratch_folder, scratch_path, stash
from sqlscore.sources.tables import load

PART_FILE = r"/part-(\d+)-[^/]*-c(\d+)[^/]*$"  # Spark's name of a part file: its task, its number in the task
ROW_BITS = 34  # low bits of a row's place: its number in the file


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain calls toxic go."""
    scored = toxicity_chain(docs, load(spark, sf_dir, "labels"), toxicity_categories(), carry=True)
    return scored.filter(~F.col("is_toxic")).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of SimHash neighbours the document with the smallest identifier stays."""
    return keep_one(docs, simhash_dedup(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage like a benchmark item go."""
    key = F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("text"))
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), key.alias("key"))
    found = contaminated_by(keyed.select("key", "row.text"), load(spark, sf_dir, "benchmark"), id_col="key")
    return keyed.join(found.select("key").distinct(), "key", "left_anti").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in an order in which every source has its target weight: the
    order of the rows as they are written."""
    mixed = pfair_mix(docs, MIX_PARTS, rest_parts=MIX_REST_PARTS, block_rows=MIX_BLOCK_ROWS)
    return mixed.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place").select("row.*")


def part_files(docs: DataFrame) -> list[tuple[int, int]]:
    """For a table read from the part files of one write the task and file numbers
    in their names, in order; for any other frame nothing."""
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        return []
    found = [re.search(PART_FILE, path) for path in docs.inputFiles()]
    numbers = sorted((int(m[1]), int(m[2])) for m in found if m)
    return numbers if len(set(numbers)) == len(found) else []


def file_order(docs: DataFrame, files: list[tuple[int, int]]) -> Column:
    """A number that grows with the row's place: by part file, then by row in the file."""
    meta = docs.metadataColumn("_metadata")
    task, file = (F.regexp_extract(F.concat(F.lit("/"), meta["file_name"]), PART_FILE, i).cast("long") for i in (1, 2))
    per_task = max(c for _, c in files) + 1
    return F.shiftleft(task * per_task + file, ROW_BITS) + meta["row_index"]


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, cut into shards in the order they were written in, with their
    ``size``, ``shard`` and ``slot`` (place in the shard), which stand for columns of
    these names that they had before."""
    if not (files := part_files(docs)):  # rows without places get them in the order they stand in
        docs = stash(docs, "pipeline-order")
        files = part_files(docs)
    placed = shard_by_bytes(docs, n_shards=N_SHARDS, carry=True, order=file_order(docs, files))
    own = ["size", "shard", "slot"]
    return placed.select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in own), *own)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]

ORACLE_SQL = None  # a trained classifier decides in the first stage


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other.  What a stage wrote on its way goes when its
    result is written, and that goes when the next stage's is: the last one stays."""
    docs, before = load(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        with scratch_folder(spark, f"pipeline-{name}-work"):
            docs = stash(stage(spark, docs, sf_dir), name, path)
        if before:
            drop_scratch(spark, before)
        before = path
    return docs
