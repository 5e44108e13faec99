"""SimHash near-dedup by bit-sliced comparison.

Fingerprints.  A text's bytes (A-Z lower-cased) are cut at ASCII whitespace;
each run of ``shingle_words`` words is hashed with XXH64 and bit i of the
fingerprint is the majority of bit i over all shingles.

Candidates.  Equal fingerprints are one class from the start.  A fingerprint
of 64 bits is cut into 5 blocks; two that differ in at most 3 bits agree in at
least 2 blocks, so they meet in one of 10 tables keyed by a pair of blocks.
A bucket of more than ``hot`` fingerprints is refined: the other 3 blocks are
cut into 6 pieces of which at least 3 must agree (20 sub-tables); what then
meets agrees in 44 bits or more, so a bucket holds 2**20 fingerprints at the very
most, whatever the corpus, and no pair is lost.

Comparison.  A task keeps the fingerprints of its buckets as 64 vertical bit
planes, 64 fingerprints to a machine word.  A query is compared with whole
words: plane by plane the differing bits go into carry-save counters (ones,
twos, and a sticky overflow at four), and a word is abandoned once all its
lanes have overflowed.  Of the links found in a bucket a spanning forest
leaves the task, never all pairs; ``components`` joins the forests.

Defined cases: null and blank texts have fingerprint zero and link like any
other; fewer words than a shingle make one shingle; long texts are read in
pieces; repeated rows and copies share a fingerprint; a component's id is its
smallest non-null identifier (null only if all are); an empty table gives an
empty result; columns beyond the two named ones are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sqlscore.llm.components import components
from sqlscore.session import stash

SEED = 42
RADIUS = 3            # the blocks below are made for this
BLOCKS = (13, 13, 13, 13, 12)
HOT_BUCKET = 2048
PIECE_BYTES = 1 << 20
PIECE_SHINGLES = 1 << 15
PAIR_WORDS = 1 << 16  # (query, word) pairs compared at once
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
BLANK = re.compile(rb"[\x20\x09-\x0d]")


# ---------------------------------------------------------------- fingerprints

def word_pieces(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a bounded number of bytes at a time."""
    at = 0
    while at < len(data):
        end = at + PIECE_BYTES
        if end < len(data):
            cut = BLANK.search(data, end)
            end = cut.start() if cut else len(data)
        yield data[at:end].lower().split()
        at = end


def fingerprint(data: bytes, shingle_words: int = 3) -> int:
    """Majority fingerprint of a text, as a signed 64-bit number."""
    ones, n, words = np.zeros(64, dtype=np.int64), 0, []
    for piece in word_pieces(data):
        words += piece
        for at in range(0, len(words) - shingle_words + 1, PIECE_SHINGLES):
            part = words[at:at + PIECE_SHINGLES + shingle_words - 1]
            shingles = map(b" ".join, zip(*(part[i:] for i in range(shingle_words)), strict=False))
            hashes = np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles, repeat(SEED))), dtype=np.uint8)
            bits = np.unpackbits(hashes.reshape(-1, 8), axis=1)
            ones += bits.sum(axis=0, dtype=np.int32)
            n += len(bits)
        words = words[max(0, len(words) - shingle_words + 1):]
    if not n and words:
        ones += np.unpackbits(np.frombuffer(xxhash.xxh64_digest(b" ".join(words), SEED), dtype=np.uint8))
        n = 1
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle_words: int) -> DataFrame:
    """``row_id``, ``fp`` and a hash of the text of every row."""
    rows = docs.select(F.col(id_col).alias("row_id"), F.col(text_col).cast("binary").alias("text"),
                       F.xxhash64(text_col).alias("text_key"))
    id_type = rows.schema["row_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(x.as_py() or b"", shingle_words) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), pa.array(fps, pa.int64()), batch.column("text_key")],
                                             ["row_id", "fp", "text_key"])

    return rows.mapInArrow(run, f"row_id {id_type}, fp bigint, text_key bigint")


# ---------------------------------------------------------------- buckets

def _bits(value: Column, low: int, n: int) -> Column:
    return F.shiftrightunsigned(value, low).bitwiseAND(F.lit((1 << n) - 1))


def _glue(parts: list[tuple[Column, int]]) -> Column:
    out = F.lit(0).cast("long")
    for value, n in parts:
        out = F.shiftleft(out, n).bitwiseOR(value)
    return out


def buckets(fps: DataFrame, hot: int) -> DataFrame:
    """``tab``, ``key`` and ``fp``: each fingerprint in all its buckets."""
    lows = [sum(BLOCKS[:i]) for i in range(len(BLOCKS))]
    block = [(_bits(F.col("fp"), low, n), n) for low, n in zip(lows, BLOCKS, strict=True)]
    tables = []
    for t, pair in enumerate(combinations(range(len(BLOCKS)), 2)):
        rest = _glue([block[i] for i in range(len(BLOCKS)) if i not in pair])
        tables.append(F.struct(F.lit(t).alias("tab"), _glue([block[i] for i in pair]).alias("key"), rest.alias("rest")))
    coarse = fps.select("fp", F.explode(F.array(*tables)).alias("b")).select("fp", "b.*")
    crowded = stash(coarse.groupBy("tab", "key").agg(F.count("*").alias("n")).filter(F.col("n") > hot)
                    .select("tab", "key", F.lit(True).alias("hot")), "simhash-hot")
    marked = coarse.join(crowded, ["tab", "key"], "left")
    piece = [(_bits(F.col("rest"), low, n), n) for low, n in zip((0, 7, 14, 21, 27, 33), (7, 7, 7, 6, 6, 6), strict=True)]
    finer = [F.struct((F.col("tab") + 10 * (1 + s)).alias("tab"),
                      F.shiftleft("key", 21).bitwiseOR(_glue([piece[i] for i in three])).alias("key"))
             for s, three in enumerate(combinations(range(6), 3))]
    own = F.array(F.struct("tab", "key"))
    return marked.select("fp", F.explode(F.when(F.col("hot"), F.array(*finer)).otherwise(own)).alias("b")).select("b.*", "fp")


# ---------------------------------------------------------------- bit-sliced comparison

def bit_planes(fps: np.ndarray) -> np.ndarray:
    """(64, words): bit i of word w of plane p is bit p of fingerprint 64 w + i."""
    padded = np.zeros(-(-len(fps) // 64) * 64, dtype=np.uint64)
    padded[:len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def within_radius(fps: np.ndarray, planes: np.ndarray, query: np.ndarray, word: np.ndarray,
                  over: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of a query's index and a word, the pairs (query, lane) that
    differ in at most 3 bits; ``over`` has ones where a lane does not count."""
    ones, twos, value = np.zeros_like(over), np.zeros_like(over), fps[query]
    for p in range(64):
        differ = planes[p][word] ^ (np.uint64(0) - ((value >> np.uint64(p)) & np.uint64(1)))
        carry = ones & differ
        ones ^= differ
        over |= twos & carry
        twos ^= carry
        if p % 8 == 7:
            alive = over != ALL
            if not alive.any():
                return np.empty(0, np.int64), np.empty(0, np.int64)
            if alive.mean() < 0.75:
                query, word, value, ones, twos, over = (x[alive] for x in (query, word, value, ones, twos, over))
    row, lane = np.nonzero(np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return query[row], word[row] * 64 + lane


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (least index of the component) after linking a[i] with b[i]."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, up := label[label]):
            label = up


def forest(fps: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest among fingerprints in order of buckets;
    ``ends[i]`` is the end of the bucket of fingerprint i."""
    planes, label, at = bit_planes(fps), np.arange(len(fps)), np.arange(len(fps))
    first, last = (at + 1) // 64, (ends - 1) // 64
    n_words = np.where(at + 1 < ends, last - first + 1, 0)
    upto = np.cumsum(n_words)
    done = 0
    while done < len(fps) and upto[-1]:
        base = upto[done - 1] if done else 0
        stop = max(done + 1, int(np.searchsorted(upto, base + PAIR_WORDS, side="right")))
        n = n_words[done:stop]
        query = np.repeat(np.arange(done, stop), n)
        word = first[query] + np.arange(len(query)) - np.repeat(np.cumsum(n) - n, n)
        low = np.clip(query + 1 - 64 * word, 0, 63).astype(np.uint64)
        high = np.clip(64 * (word + 1) - ends[query], 0, 63).astype(np.uint64)
        a, b = within_radius(fps, planes, query, word, ~((ALL << low) & (ALL >> high)))
        label = unite(label, a, b)
        done = stop
    linked = np.flatnonzero(label != at)
    return fps[linked], fps[label[linked]]


def compare_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``tab, key, fp`` in order of buckets to links ``u, v``.  What is held is one
    batch and the bucket still open; a bucket has a fixed largest size."""
    held: list[list[np.ndarray]] = []

    def links(tab, key, fp):
        start = np.flatnonzero(np.r_[True, (tab[1:] != tab[:-1]) | (key[1:] != key[:-1])])
        size = np.diff(np.r_[start, len(tab)])
        many = np.repeat(size > 1, size)
        size = size[size > 1]
        u, v = forest(fp[many].view(np.uint64), np.repeat(np.cumsum(size), size))
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(i).to_numpy() for i in range(3)]
        held.append(now)
        open_from = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
        if len(open_from):  # a bucket ends in this batch
            rows = [np.concatenate(x) for x in zip(*held, strict=True)]
            cut = len(rows[0]) - (batch.num_rows - 1 - open_from[-1])
            yield links(*(x[:cut] for x in rows))
            held = [[x[cut:] for x in rows]]
    if held:
        yield links(*(np.concatenate(x) for x in zip(*held, strict=True)))


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3,
                  hot: int = HOT_BUCKET) -> DataFrame:
    """One row per row of ``docs``: identifier, ``fingerprint`` (16 hex digits),
    ``component_id``, ``root`` (least fingerprint of the component) and ``text_key``
    (hash of the text, which tells apart rows that share an identifier)."""
    rows = stash(fingerprints(docs, id_col, text_col, shingle_words), "simhash-rows")
    classes = stash(rows.groupBy("fp").agg(F.min("row_id").alias("first_id")), "simhash-classes")
    dealt = buckets(classes.select("fp"), hot).repartition("tab", "key").sortWithinPartitions("tab", "key", "fp")
    members = stash(components(dealt.mapInArrow(compare_buckets, "u bigint, v bigint")), "simhash-members")
    rooted = stash(classes.join(members.withColumnRenamed("node", "fp"), "fp", "left")
                   .select("fp", "first_id", F.coalesce("root", "fp").alias("root")), "simhash-rooted")
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_class = stash(rooted.join(ids, "root").select("fp", "root", "component_id"), "simhash-ids")
    digits = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return rows.join(of_class, "fp").select(
        F.col("row_id").alias(id_col), digits("fp").alias("fingerprint"), "component_id", digits("root").alias("root"), "text_key")


def keep_one(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their group in ``groups`` (as from
    ``simhash_dedup``): one for each, with the smallest identifier."""
    first = F.min(F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("of_id"), F.col("text_key").alias("of_key")))
    chosen = groups.groupBy("root").agg(first.alias("first")).select("first.of_id", "first.of_key").distinct()
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*columns).alias("row"), F.col(id_col).alias("own_id"), F.xxhash64(text_col).alias("own_key"))
    kept = rows.join(chosen, F.col("own_id").eqNullSafe(F.col("of_id")) & (F.col("own_key") == F.col("of_key")), "left_semi")
    nth = F.row_number().over(Window.partitionBy("own_id", "own_key").orderBy(F.lit(1)))  # repeated rows
    return kept.withColumn("nth", nth).filter("nth = 1").select("row.*")
