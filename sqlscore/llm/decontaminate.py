"""Benchmark decontamination (DataFrame operations only).

A document is contaminated by a benchmark item if some window of the item's
size in it resembles the item: weighted-shingle similarity (shingles of five
words, a shingle's weight is its count; sum of smaller over sum of larger
weights) of at least 0.8.

1. Index.  A window that reaches similarity t lacks at most (1 - t) of the
   item's shingle weight, so it holds one of the item's rarest
   floor((1 - t) m) + 1 shingles.  Only these are looked up, in one pass over
   all shingles of all texts; phrases that many items share are indexed last.
2. Windows.  Moving a window's start up to its first shingle that the item has
   too never lowers the similarity, so windows start at such places; each is
   made once, at the first indexed shingle in it.  Windows with the same content
   are one from here on, so a passage in a third of all texts costs one.
3. SimHash.  Windows and items get 64-bit SimHash fingerprints of their
   distinct pairs of shingle and occurrence number, whose plain similarity is
   the weighted one.  With ``radius + 1`` blocks, any two fingerprints within ``radius`` agree in one
   block: the join on (item, block, value) finds all of them.  Texts at the
   threshold differ in 9.7 +- 2.9 bits, so radius 23 misses one in 100,000
   there, and none that are equal.
4. Verification of the exact similarity, then the best window per document
   and item.

The index is broadcast only while it has at most ``broadcast_rows`` rows
(of some 40 bytes); beyond that the lookup is a shuffle join on the shingle.

Defined cases: words are runs of letters and digits, lower-cased; items of
fewer than five words match nothing; a text shorter than the item is one
window; null texts have no words; repeated items and rows give their pair
once; texts that share an item identifier, null among them, are compared each
by itself and give one pair, of the most similar; ties go to the first window;
empty tables give an empty result; columns beyond the named ones are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlscore.session import stash

WORD = r"[\p{L}\p{N}]+"
SHINGLE = 5
LANE = 0x0001000100010001  # one bit in each of four 16-bit counters
COUNTED = 32000            # hashes that such counters can count without a carry


def with_shingles(rows: DataFrame, text: str, out: str) -> DataFrame:
    """Replace a text by the hashes of all its five-word shingles, in order.  The
    words are a column of their own, as a lambda would find them anew each time."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    rows = rows.withColumn("words", F.transform(words, lambda w: F.xxhash64(w))).drop(text)
    every = F.transform(F.sequence(F.lit(0), F.size("words") - SHINGLE),
                        lambda i: F.xxhash64(*(F.get("words", i + k) for k in range(SHINGLE))))
    none = F.array().cast("array<bigint>")
    return rows.withColumn(out, F.when(F.size("words") >= SHINGLE, every).otherwise(none)).drop("words")


def _lane_sums(array: str, group: int) -> str:
    """SQL: sums of the hashes' bits group, group + 16, + 32 and + 48, as four 16-bit
    counters in a long, for each part of the array that they can count."""
    return (f"transform(sequence(0, (size({array}) - 1) div {COUNTED}), p -> aggregate("
            f"slice({array}, cast(p * {COUNTED} + 1 as int), {COUNTED}), 0L, "
            f"(s, h) -> s + (shiftrightunsigned(h, {group}) & {LANE}L)))")


def _majority(array: str, bit: int) -> str:
    """SQL: 2**bit if the bit is set in over half the hashes."""
    lane = f"(shiftrightunsigned(x, {16 * (bit // 16)}) & 65535L)"
    return f"if(2 * aggregate(lanes[{bit % 16}], 0L, (s, x) -> s + {lane}) > size({array}), shiftleft(1L, {bit}), 0L)"


def with_simhash(rows: DataFrame, array: str) -> DataFrame:
    """Add ``fp``, the SimHash of an array of hashes.  The second and later places of a
    hash count as hashes of their own, so that bits differ by the weighted similarity.
    ``same`` is a column of its own, as the lambda would sort it anew each time."""
    rows = rows.selectExpr("*", f"if(size(array_distinct({array})) = size({array}), cast(array() AS array<bigint>), "
                                f"sort_array({array})) AS same")
    nth = "i - cast(array_position(same, h) AS int) + 1"
    rows = rows.selectExpr("*", f"if(size(same) = 0, {array}, transform(same, (h, i) -> "
                                f"if(i > 0 AND get(same, i - 1) = h, xxhash64(h, {nth}), h))) AS told").drop("same")
    lanes = f"array({', '.join(_lane_sums('told', g) for g in range(16))}) AS lanes"
    fp = " | ".join(_majority("told", bit) for bit in range(64))
    return rows.selectExpr("*", lanes).selectExpr("*", f"{fp} AS fp").drop("lanes", "told")


def blocks(fp: Column, radius: int) -> Column:
    """``radius + 1`` blocks of a fingerprint, as structs of number and value."""
    n = radius + 1
    edge = [64 * i // n for i in range(n + 1)]
    return F.array(*(F.struct(F.lit(i).alias("no"), F.shiftrightunsigned(fp, edge[i]).bitwiseAND(
        F.lit((1 << (edge[i + 1] - edge[i])) - 1)).alias("value")) for i in range(n)))


def similarity(a: Column, b: Column) -> Column:
    """Weighted-shingle similarity of two arrays of hashes."""
    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    times = lambda x, array: F.size(F.filter(array, lambda y: y == x))
    repeated = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, x: s + F.least(times(x, a), times(x, b)))
    common = F.when(plain, F.size(F.array_intersect(a, b))).otherwise(repeated)
    return common / (F.size(a) + F.size(b) - common)


def item_table(benchmark: DataFrame, id_col: str, text_col: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Items (``item_key``, ``item`` and the indexed ``rare`` hashes) and the index (``h``, ``item_key``, ``m``)."""
    texts = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    key = F.struct("id", F.xxhash64("item").alias("hash"))  # a null identifier and each text of a repeated one count
    items = stash(with_shingles(texts, "text", "item").filter(F.size("item") > 0).distinct()
                  .select(key.alias("item_key"), "item"), "bench-items")
    each = items.select("item_key", F.explode(F.array_distinct("item")).alias("h"), F.size("item").alias("m"), "item")
    spread = items.select(F.explode(F.array_distinct("item")).alias("h")).groupBy("h").agg(F.count("*").alias("shared"))
    # all places of a repeated shingle count towards the weight that may be lacking
    ranked = (each.join(spread, "h").groupBy("item_key", "item")
              .agg(F.array_sort(F.collect_list(F.struct("shared", "h"))).alias("ranked")))
    n_rare = F.floor((1 - threshold) * F.size("item") + 1e-9).cast("int") + 1
    items = stash(ranked.select("item_key", "item", F.transform(F.slice("ranked", 1, n_rare), lambda x: x["h"]).alias("rare")),
                  "bench-items")
    return items, stash(items.select(F.explode("rare").alias("h"), "item_key", F.size("item").alias("m")), "bench-index")


def region(p: Column, m: Column) -> Column:
    """Shingles that windows of ``m`` shingles around place ``p`` can have."""
    return F.slice("sh", F.greatest(p - m + 1, F.lit(0)) + 1, 2 * m - 1)


def lookups(docs: DataFrame, index: DataFrame, broadcast_rows: int) -> DataFrame:
    """Every indexed shingle of every text: ``doc``, ``item_key``, place ``p`` and
    the ``region`` around it, which begins at place ``low``."""
    # the outer form, as for the other Spark would test the array's size before the
    # scan's projection, where its expression stands in full and is worked out again
    if index.count() <= broadcast_rows:
        found = docs.select("doc", "sh", F.posexplode_outer("sh").alias("p", "h")).join(F.broadcast(index), "h")
    else:
        places = docs.select("doc", F.posexplode_outer("sh").alias("p", "h")).join(index, "h")
        found = (places.groupBy("doc").agg(F.collect_set(F.struct("p", "item_key", "m")).alias("at"))
                 .withColumnRenamed("doc", "of").join(docs, F.col("of").eqNullSafe(F.col("doc")))
                 .select("doc", "sh", F.explode("at").alias("at")).select("doc", "sh", "at.*"))
    return found.select("doc", "item_key", "p", F.greatest(F.col("p") - F.col("m") + 1, F.lit(0)).alias("low"),
                        region(F.col("p"), F.col("m")).alias("region"))


def windows(found: DataFrame, items: DataFrame) -> DataFrame:
    """``doc``, ``item_key``, ``start`` and ``win`` of every window to look at."""
    at = F.col("p") - F.col("low")  # place of the indexed shingle in its region
    # a window that holds an earlier indexed shingle belongs to that one
    earlier = F.coalesce(F.array_max(F.filter(F.sequence(F.lit(0), at), lambda i: (i < at) & F.array_contains(
        F.col("rare"), F.get("region", i)))), F.lit(-1))
    starts = F.filter(F.sequence(F.lit(0), at), lambda i: (i > earlier) & F.array_contains(F.col("item"), F.get("region", i)))
    return (found.join(items, "item_key").select("doc", "item_key", "low", "region", F.size("item").alias("m"),
                                                F.explode(starts).alias("i"))
            .select("doc", "item_key", (F.col("low") + F.col("i")).alias("start"),
                    F.slice("region", F.col("i") + 1, F.col("m")).alias("win")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text", threshold: float = 0.8,
                  radius: int = 23, broadcast_rows: int = 1_000_000) -> DataFrame:
    """One row per contaminated document and item: ids, ``similarity`` of the best
    window and ``start_word``, the place (in words, from 0) where it starts."""
    items, index = item_table(benchmark, item_id_col, item_text_col, threshold)
    read = with_shingles(docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")), "text", "sh")
    found = stash(windows(lookups(read, index, broadcast_rows), items)
                  .withColumn("key", F.xxhash64("win")).withColumn("key2", F.hash("win")), "bench-windows")
    contents = found.groupBy("item_key", "key", "key2").agg(F.first("win").alias("win"))
    seen = with_simhash(contents, "win").withColumn("block", F.explode(blocks(F.col("fp"), radius)))
    wanted = with_simhash(items.select("item_key", "item"), "item").withColumnRenamed("fp", "item_fp")
    wanted = wanted.withColumn("block", F.explode(blocks(F.col("item_fp"), radius)))
    near = (seen.join(wanted, ["item_key", "block"])
            .filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
            .groupBy("item_key", "key", "key2").agg(F.first("win").alias("win"), F.first("item").alias("item")))
    good = stash(near.withColumn("similarity", similarity(F.col("win"), F.col("item")))
                 .filter(F.col("similarity") >= threshold).select("item_key", "key", "key2", "similarity"), "bench-good")
    best = F.max_by(F.struct("similarity", "start"), F.struct("similarity", -F.col("start")))
    return (found.select("doc", "item_key", "start", "key", "key2").join(good, ["item_key", "key", "key2"])
            .groupBy("doc", F.col("item_key")["id"].alias("item_id")).agg(best.alias("best"))
            .select(F.col("doc").alias(id_col), F.col("item_id"), "best.similarity", F.col("best.start").alias("start_word")))
