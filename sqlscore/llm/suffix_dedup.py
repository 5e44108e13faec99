"""Removal of repeated byte strings by suffix arrays.

Every byte covered by a string of ``length`` bytes that also starts anywhere
else (in any text, its own included) is removed.  Strings are judged on the
input and never cross texts.

Dealing out.  Of the ``GRAM``-byte grams in a window of ``length`` bytes, the
one with the least hash (the last of equals) is its anchor.  Equal windows
have equal anchors at equal places, so it is enough to compare windows with
the same anchor.  Neighbouring windows with the same anchor form a context: its
bytes, stored once, hold all of them.  Per text there is a context in about
(length - GRAM) / 2 bytes.

What contexts already decide.  Windows of a context whose bytes occur twice
are repeated; those whose anchor occurs once are not.  Contexts are counted
by hash with partial sums, so a passage in a third of all texts is one row per
task.  What remains are anchors that have several different contexts, one of
them unique: the edges of repeated passages.

Suffix arrays.  The remaining contexts are dealt out by anchor, and a task
takes them a few megabytes at a time: it sorts the suffixes to depth
``length``, forms the Burrows-Wheeler transform and expands intervals breadth
first by backward extension.  All intervals of strings of one length are
extended at once; an extension whose right end is not yet a boundary makes it
one with that length as common prefix.  Common prefixes come in increasing
order, and the expansion stops at ``length``: what is no boundary by then has at
least ``length`` bytes in common.  Runs of the transform are extended as one
piece, so many copies cost no more than a few.

An anchor with more than ``group_contexts`` different contexts is not taken
into one task: its windows are counted by a 128-bit hash of each (exact but for
hash collisions), again with partial sums.

Defined cases: null text counts as empty; texts shorter than ``length`` stay
whole; in a row of equal texts all are removed alike (from ``length`` bytes);
repeated rows count as texts of their own; very long texts are read in pieces; an
empty table gives an empty result; columns beyond the two named ones are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sqlscore.session import stash

GRAM = 32
SLAB = 1 << 19             # bytes hashed at once
PLACE_BITS = 21            # of a sort key: place in a slab
GROUP_CONTEXTS = 4096      # of about 600 bytes
SUFFIX_BYTES = 1 << 20     # a suffix array is closed at the next anchor after so many bytes
BASE = 0x9E3779B97F4A7C15  # odd, so that its powers have inverses modulo 2**64
BASE_2 = 0xD6E8FEB86659FD93


@cache
def powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base modulo 2**64 and their inverses, for every place in a slab."""
    n = SLAB + (1 << 16)
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.r_[np.uint64(1), np.full(n, b, dtype=np.uint64)])
                     for b in (base, pow(base, -1, 1 << 64)))


def rolling(data: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hash of every ``width`` consecutive bytes."""
    up, down = powers(base)
    with np.errstate(over="ignore"):
        total = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)])]
        h = (total[width:] - total[:-width]) * down[:len(total) - width]
        h ^= h >> np.uint64(32)
        h *= np.uint64(BASE)
        return h ^ (h >> np.uint64(29))


def sliding_min(key: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` consecutive keys."""
    n = -(-len(key) // width) * width
    rows = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64)
    rows[:len(key)] = key
    rows = rows.reshape(-1, width)
    front = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:len(key) - width + 1], front[width - 1:len(key)])


def contexts_of(data: np.ndarray, ends: np.ndarray, length: int):
    """Contexts in a slab of whole pieces that end at ``ends``: first window,
    number of windows, and hash of the anchor."""
    if len(data) < length:
        return np.empty((3, 0), dtype=np.int64)
    gram = rolling(data, GRAM, BASE)
    mask = np.uint64((1 << PLACE_BITS) - 1)
    key = (gram & ~mask) | (mask - np.arange(len(gram), dtype=np.uint64))
    anchor = (mask - (sliding_min(key, length - GRAM + 1) & mask)).astype(np.int64)
    end_of = np.repeat(ends, np.diff(np.r_[0, ends]))
    at = np.flatnonzero(np.arange(len(anchor)) + length <= end_of[:len(anchor)])
    if not len(at):
        return np.empty((3, 0), dtype=np.int64)
    own = anchor[at]
    first = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (np.diff(at) != 1)])
    return np.stack([at[first], np.diff(np.r_[first, len(at)]), gram[own[first]].view(np.int64)])


def slabs(batch: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The texts of a batch as slabs of pieces: bytes, ends of the pieces, their
    rows and their places in the text.  Pieces of a long text overlap by length - 1."""
    texts, parts, size = batch.column("text"), [], 0

    def slab():
        ends = np.cumsum([len(p[2]) for p in parts])
        return (np.frombuffer(b"".join(p[2] for p in parts), dtype=np.uint8), ends,
                np.array([p[0] for p in parts]), np.array([p[1] for p in parts]))

    for row in range(batch.num_rows):
        view = memoryview(texts[row].as_buffer())
        for at in range(0, max(1, len(view) - length + 1), SLAB - length):
            piece = view[at:at + SLAB - 1]
            if size + len(piece) > SLAB and parts:
                yield slab()
                parts, size = [], 0
            parts.append((row, at, piece))
            size += len(piece)
    if parts:
        yield slab()


def find_contexts(texts: DataFrame, length: int) -> DataFrame:
    """``text_id``, ``lo`` (first window), ``n`` (windows), ``anchor`` and
    ``content`` (hash of the bytes) of every context."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, ends, rows, places in slabs(batch, length):
                lo, n, anchor = contexts_of(data, ends, length)
                piece = np.searchsorted(ends, lo, side="right")
                view = memoryview(data)
                content = np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(
                    lo.tolist(), (lo + n + length - 1).tolist(), strict=True)), dtype=np.uint64, count=len(lo))
                start = np.r_[0, ends[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("text_id").take(pa.array(rows[piece])), pa.array(lo - start[piece] + places[piece]),
                     pa.array(n), pa.array(anchor), pa.array(content.view(np.int64))],
                    ["text_id", "lo", "n", "anchor", "content"])

    return texts.mapInArrow(run, "text_id binary, lo bigint, n bigint, anchor bigint, content bigint")


# ---------------------------------------------------------------- suffix arrays

def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Places in order of the first ``depth`` symbols from there, by prefix doubling."""
    n = len(symbols)
    known = 7
    key = np.zeros(n, dtype=np.int64)
    for j in range(known):
        key[:n - j] |= symbols[j:].astype(np.int64) << (9 * (known - 1 - j))
    while True:
        order = np.argsort(key)
        if known >= depth:
            return order
        inner = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(np.r_[True, inner[1:] != inner[:-1]])
        step = min(known, depth - known)
        key = rank * (n + 1)
        key[:n - step] += rank[step:]
        known += step


def common_prefix_boundaries(symbols: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Flags of places i in ``order`` where the suffixes i - 1 and i have fewer than
    ``depth`` symbols in common."""
    n = len(symbols)
    bwt = symbols[order - 1]
    last_to_first = np.empty(n, dtype=np.int64)
    last_to_first[np.argsort(bwt, kind="stable")] = np.arange(n)
    run_start = np.flatnonzero(np.r_[True, bwt[1:] != bwt[:-1]])
    run_end = np.r_[run_start[1:], n] - 1
    run_of = np.cumsum(np.r_[0, bwt[1:] != bwt[:-1]])
    bound = np.zeros(n + 1, dtype=bool)
    bound[0] = bound[n] = True
    low, high = np.array([0]), np.array([n - 1])  # the interval of the empty string
    for _ in range(depth):
        first = run_of[low]
        count = run_of[high] - first + 1
        upto = np.cumsum(count)
        run = np.arange(upto[-1]) + np.repeat(first - upto + count, count)
        start = np.maximum(run_start[run], np.repeat(low, count))
        end = np.minimum(run_end[run], np.repeat(high, count))
        if upto[-1] > len(low):  # runs of one symbol in one interval extend together
            part = np.repeat(np.arange(len(low)), count) * 512 + bwt[start]
            by = np.argsort(part, kind="stable")
            part, start, end = part[by], start[by], end[by]
            new = np.r_[True, part[1:] != part[:-1]]
            start, end = start[new], end[np.r_[np.flatnonzero(new)[1:], len(part)] - 1]
        low, high = last_to_first[start], last_to_first[end]
        fresh = ~bound[high + 1]
        low, high = low[fresh], high[fresh]
        if not len(low):
            break
        bound[high + 1] = True
    return bound[:n]


def repeated_windows(contexts: list[bytes], windows: np.ndarray, weight: np.ndarray, length: int) -> list[np.ndarray]:
    """For each context flags of its windows that occur at least twice in all
    contexts; a context counts as often as its weight says."""
    data = np.frombuffer(b"".join(contexts), dtype=np.uint8).astype(np.int16) + 2
    size = np.array([len(c) for c in contexts])
    symbols = np.ones(len(data) + len(contexts) + 1, dtype=np.int16)  # 1 ends a context, 0 ends all
    symbols[-1] = 0
    start = np.cumsum(size + 1) - size - 1
    symbols[np.arange(len(data)) + np.repeat(np.arange(len(contexts)), size)] = data
    order = suffix_order(symbols, length)
    group = np.empty(len(symbols), dtype=np.int64)
    group[order] = np.cumsum(common_prefix_boundaries(symbols, order, length))
    at = np.arange(windows.sum()) + np.repeat(start - np.cumsum(windows) + windows, windows)
    own = group[at]
    often = np.bincount(own, weights=np.repeat(weight, windows)) >= 2
    return np.split(often[own], np.cumsum(windows)[:-1])


def ranges_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of true flags."""
    edge = np.diff(np.r_[0, flags.astype(np.int8), 0])
    start = np.flatnonzero(edge == 1)
    return start, np.flatnonzero(edge == -1) - start


FOUND = "text_id binary, lo bigint, n bigint"


def search_suffixes(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of anchors to ranges of repeated windows in the unique
    contexts.  Held: one batch and what a suffix array takes."""
    held: list[tuple] = []
    size, last = 0, None

    def search():
        flags = repeated_windows([h[5] for h in held], np.array([h[3] for h in held]), np.array([h[4] for h in held]), length)
        out = [(h[1], h[2] + a, b) for h, f in zip(held, flags, strict=True) if h[4] == 1 for a, b in zip(*ranges_of(f), strict=True)]
        ids, lo, n = zip(*out, strict=True) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(lo, pa.int64()), pa.array(n, pa.int64())],
                                          ["text_id", "lo", "n"])

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("anchor", "text_id", "lo", "n", "copies", "bytes")]
        for row in zip(*columns, strict=True):
            if row[0] != last and size >= SUFFIX_BYTES:
                yield search()
                held, size = [], 0
            held.append(row)
            size += len(row[5])
            last = row[0]
    if held:
        yield search()


def count_windows(crowded: DataFrame, length: int) -> DataFrame:
    """The same ranges for anchors with very many contexts, by counting hashes of windows."""
    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = np.frombuffer(batch.column("bytes")[i].as_py(), dtype=np.uint8)
                n, copies = len(data) - length + 1, batch.column("copies")[i].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rolling(data, length, b).view(np.int64)) for b in (BASE, BASE_2)]
                    + [pa.array(np.arange(n) + batch.column("lo")[i].as_py()), pa.array(np.full(n, copies)),
                       pa.array([batch.column("text_id")[i].as_py()] * n, pa.binary())], ["h1", "h2", "lo", "copies", "text_id"])

    each = stash(crowded.mapInArrow(hashes, "h1 bigint, h2 bigint, lo bigint, copies bigint, text_id binary"), "suffix-hashes")
    often = stash(each.groupBy("h1", "h2").agg(F.sum("copies").alias("all")).filter("all >= 2").select("h1", "h2"), "suffix-often")
    return each.filter("copies = 1").join(often, ["h1", "h2"]).select("text_id", "lo", F.lit(1).cast("long").alias("n"))


def remove_ranges(texts: DataFrame, id_type: str, length: int) -> DataFrame:
    """Cut the bytes of the windows in ``found`` (array of lo, n) out of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, spans = [], []
            for text, found in zip(batch.column("text"), batch.column("found").to_pylist(), strict=True):
                data, cuts = text.as_py(), []
                for lo, n in sorted((f["lo"], f["n"]) for f in found or ()):
                    if cuts and lo <= cuts[-1][1]:
                        cuts[-1][1] = max(cuts[-1][1], lo + n + length - 1)
                    else:
                        cuts.append([lo, lo + n + length - 1])
                edges = [0, *(x for c in cuts for x in c), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                spans.append([{"start": a, "end": b} for a, b in cuts])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_id"), pa.array(map(len, batch.column("text").to_pylist()), pa.int64()), pa.array(kept, pa.binary()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                ["row_id", "n_bytes", "kept", "spans"])

    return texts.mapInArrow(run, f"row_id {id_type}, n_bytes bigint, kept binary, spans array<struct<start:bigint,end:bigint>>")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400,
                 group_contexts: int = GROUP_CONTEXTS) -> DataFrame:
    """One row per row of ``docs``: identifier, ``n_bytes``, ``kept`` (the bytes that
    stay) and ``spans`` (maximal removed runs)."""
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id_col).alias("row_id"), text.alias("text"),
                       F.substring(F.unhex(F.sha2(text, 256)), 1, 16).alias("text_id"))
    long = rows.filter(F.octet_length("text") >= length).select("text_id", "text")
    all_contexts = stash(find_contexts(long, length), "suffix-contexts")
    counted = all_contexts.groupBy("anchor", "content").agg(
        F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("text_id", "lo", "n")))
    contents = stash(counted, "suffix-contents")
    anchors = contents.groupBy("anchor").agg(F.sum("copies").alias("all"), F.count("*").alias("contents"),
                                             F.sum((F.col("copies") == 1).cast("long")).alias("unique"))
    shared = stash(anchors.filter("all > 1").drop("all"), "suffix-anchors")
    copied = contents.filter("copies > 1").select("anchor", "content")
    whole = all_contexts.join(copied, ["anchor", "content"]).select("text_id", "lo", "n").distinct()
    open_ = shared.filter("unique > 0 AND contents > 1")
    wanted = contents.join(open_, "anchor").select("anchor", "contents", "copies", "text_id", "lo", "n")
    # one text of each kind; the limit of one is applied before the shuffle, too
    nth = F.row_number().over(Window.partitionBy("text_id").orderBy(F.lit(1)))
    one = long.withColumn("nth", nth).filter("nth = 1").drop("nth")
    cut = stash(wanted.join(one, "text_id").withColumn("bytes", F.expr(
        f"substring(text, cast(lo + 1 as int), cast(n + {length - 1} as int))")).drop("text"), "suffix-bytes")
    dealt = (cut.filter(F.col("contents") <= group_contexts).repartition("anchor").sortWithinPartitions("anchor")
             .select("anchor", "text_id", "lo", "n", "copies", "bytes"))
    edges = dealt.mapInArrow(lambda batches: search_suffixes(batches, length), FOUND)
    crowded = count_windows(cut.filter(F.col("contents") > group_contexts), length)
    found = stash(whole.union(edges).union(crowded).groupBy("text_id").agg(
        F.collect_list(F.struct("lo", "n")).alias("found")), "suffix-found")
    joined = rows.join(found, "text_id", "left").select("row_id", "text", "found")
    return remove_ranges(joined, dict(rows.dtypes)["row_id"], length).withColumnRenamed("row_id", id_col)
