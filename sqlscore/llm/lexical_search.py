"""Ranked lexical search over bit-sliced Bloom signatures.

Index.  Documents are packed into blocks, one row each; of a block's documents the
longest has at most twice the words of the shortest (or 64), so that a signature is never much larger than its texts.  A
block holds its word list with document frequencies, its documents' words
with counts, and a signature: a matrix of bits with a column per document.  A
(word, level) pair sets ``HASHES`` bits of a document's column; level j says that
the word occurs more than 2**(j-1) times in it (level 0: at all).  The matrix is
stored by rows, so the documents that may have a pair are the AND of a few bit rows.
Such a bitmap holds every document that has the pair and some that don't.

Search.  A task keeps for every item the scores of its best documents so
far.  For a block it takes the bitmaps of all query words and sums them by weight,
level by level: each level adds what a word can add at most by occurring up to
2**j times in a document of that length.  The sums are never below the score.
A document whose sum is less than the item's ``top``-th best score so far is
provably out; all others are scored exactly from the block's counts.  Whatever
is among the task's best is merged over all tasks.

Items are taken in blocks of ``ITEM_BYTES`` of text against all documents, so what
goes to the tasks has a fixed largest size.  All weights and scores are exact
64-bit integers (the logarithm in doubles).

Defined cases: null texts have no terms; an item without terms, or whose terms
are in no document, has no result; documents without terms don't count; rows that
share an identifier are ranked each by itself, among equals in any order; items that share
an identifier, null among them, get a ranking each; null document identifiers
come last among equal scores; texts are read whole; an empty table on either side gives an
empty result; columns beyond the named ones are not read.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sqlscore.llm.arrays import portions_of, spans
from sqlscore.session import stash

ALNUM = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in range(256))
BLOCK_DOCS = 1024
SLAB_BYTES = 1 << 23      # of text that a task cuts into blocks at once
BLOCK_BYTES = 1 << 22     # of text in a block (one document at least)
HASHES = 3                # bits of a (word, level) pair
BITS_A_PAIR = 8
ITEM_BYTES = 1 << 20      # of item texts searched together
MIX = 0x9E3779B97F4A7C15


def terms_of(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters, digits and other characters beyond ASCII; A-Z lower-cased."""
    return (text or b"").translate(ALNUM).lower().split()  # no white space but blanks is left


def levels_of(count: np.ndarray) -> np.ndarray:
    """The least j with count <= 2**j."""
    return np.frexp(count - 0.5)[1].clip(0)


def rows_of(hashes: np.ndarray, level: int, rows: int) -> np.ndarray:
    """The signature rows of (word, level) pairs, ``HASHES`` each (rows: a power of two)."""
    with np.errstate(over="ignore"):
        h = (hashes + np.uint64(level + 1)) * np.uint64(MIX)
        h ^= h >> np.uint64(29)
        h *= np.uint64(MIX)
        first, step = h >> np.uint64(32), h & np.uint64(0xFFFFFFFF) | np.uint64(1)
        return ((first[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) & np.uint64(rows - 1)).astype(np.int64)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


# ---------------------------------------------------------------- index

BLOCK = ("docs array<{id}>, lengths binary, n_docs bigint, n_terms bigint, words array<binary>, frequency array<bigint>, "
         "ends binary, word binary, count binary, levels int, signature binary")
BLOCK_NAMES = [part.split()[0] for part in BLOCK.split(", ")]


def signature_of(doc: np.ndarray, word: np.ndarray, level: np.ndarray, hashes: np.ndarray, n_docs: int) -> np.ndarray:
    """Bit rows of a block: one row of documents per hash value."""
    pairs = np.bincount(doc, weights=level + 1, minlength=n_docs).max()
    rows = 1 << max(6, math.ceil(math.log2(max(1, pairs * BITS_A_PAIR))))
    bits = np.zeros((rows, n_docs), dtype=bool)
    for j in range(int(level.max()) + 1):
        has = level >= j
        own = rows_of(hashes, j, rows)[word[has]]
        bits[own.ravel(), np.repeat(doc[has], HASHES)] = True
    return np.packbits(bits, axis=1)


def make_blocks(docs: DataFrame) -> DataFrame:
    """Rows of ``BLOCK`` for documents (``doc``, ``text`` as bytes); those without terms are left out."""
    def block(ids: pa.Array, rows: list[int], found: list[tuple], words: list[bytes]) -> pa.RecordBatch:
        size = np.array([len(found[r][0]) for r in rows])
        own, word = np.unique(np.concatenate([found[r][0] for r in rows]), return_inverse=True)
        count = np.concatenate([found[r][1] for r in rows])
        lengths = np.array([found[r][1].sum() for r in rows], dtype=np.int64)
        names = [words[i] for i in own.tolist()]
        level = levels_of(count)
        bits = signature_of(np.repeat(np.arange(len(rows)), size), word, level, word_hashes(names), len(rows))
        picked = ids.take(pa.array(rows))
        values = [lengths.tobytes(), len(rows), int(lengths.sum()), names, np.bincount(word, minlength=len(own)),
                  np.cumsum(size).tobytes(), word.astype(np.int32).tobytes(), count.astype(np.int32).tobytes(),
                  int(level.max()) + 1, bits.tobytes()]
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()),
                 pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), picked),
                                           *(pa.array([v], k) for v, k in zip(values, kinds, strict=True))], BLOCK_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions_of(batch, "text", SLAB_BYTES):
                number: dict[bytes, int] = defaultdict()
                number.default_factory = number.__len__
                found, size = [], []
                for text in part.column("text"):
                    text = text.as_py()
                    terms = terms_of(text)
                    got = np.fromiter(map(number.__getitem__, terms), dtype=np.int64, count=len(terms))
                    found.append(np.unique(got, return_counts=True))
                    size.append(len(text or b""))
                words = [*number]
                order = sorted((r for r in range(len(found)) if len(found[r][0])), key=lambda r: len(found[r][0]))
                rows, held = [], 0
                for r in order:
                    longest = max(64, 2 * len(found[rows[0]][0])) if rows else 0
                    if rows and (len(rows) == BLOCK_DOCS or held + size[r] > BLOCK_BYTES or len(found[r][0]) > longest):
                        yield block(part.column("doc"), rows, found, words)
                        rows, held = [], 0
                    rows.append(r)
                    held += size[r]
                if rows:
                    yield block(part.column("doc"), rows, found, words)

    return docs.mapInArrow(run, BLOCK.format(id=dict(docs.dtypes)["doc"]))


# ---------------------------------------------------------------- search

def gain(count: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What an occurrence count adds per unit of weight in a document of length factor m."""
    return (1_000_000_000 * count) // (1000 * count + 12 * m)


def upper_bounds(signature: np.ndarray, levels: int, most: int, m: np.ndarray, hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each item (row of ``weights``, by query word) and document a sum that is never below the score."""
    bound = np.zeros((len(weights), len(m)), dtype=np.int64)
    may, before = None, np.zeros(len(m), dtype=np.int64)
    for j in range(levels):
        rows = signature[rows_of(hashes, j, len(signature))]
        bits = np.bitwise_and.reduce(rows, axis=1)
        may = bits if may is None else may & bits
        here = gain(np.full(len(m), min(1 << j, most), dtype=np.int64), m)
        present = np.unpackbits(may, axis=1, count=len(m)).astype(weights.dtype)
        bound += (weights @ present).astype(np.int64) * (here - before)
        before = here
    return bound


class BestScores:
    """Per item the ``top`` best scores that a task has seen."""

    def __init__(self, items: int, top: int):
        self.scores = np.zeros((items, top), dtype=np.int64)

    def least(self, item: int) -> int:
        """A score that at least ``top`` documents have (1 until then)."""
        return max(1, int(self.scores[item, 0]))

    def add(self, item: int, scores: np.ndarray) -> None:
        self.scores[item] = np.sort(np.partition(np.r_[self.scores[item], scores], len(scores))[len(scores):])


def search_blocks(blocks: DataFrame, vocabulary: list[bytes], items: list[dict[int, int]], n_docs: int, n_terms: int,
                  id_type: str, top: int) -> DataFrame:
    """``item`` (number), ``doc`` and ``score`` of all documents that can be among an item's
    best.  ``items``: weight of each query word (by place in the vocabulary)."""
    total = max((sum(i.values()) for i in items), default=0)
    weights = np.zeros((len(items), len(vocabulary)), dtype=np.float32 if total < 1 << 24 else np.float64)  # sums stay exact
    for i, item in enumerate(items):
        weights[i, [*item]] = [*item.values()]
    hashes = word_hashes(vocabulary)
    place = {w: i for i, w in enumerate(vocabulary)}

    def search(batch: pa.RecordBatch, r: int, best: BestScores) -> Iterator[pa.RecordBatch]:
        cell = {name: batch.column(name)[r] for name in batch.schema.names}
        integers = lambda name, kind: np.frombuffer(cell[name].as_buffer(), dtype=kind)
        m = 75 + (25 * integers("lengths", np.int64) * n_docs) // n_terms
        ends, word, count = integers("ends", np.int64), integers("word", np.int32), integers("count", np.int32).astype(np.int64)
        size = np.diff(np.r_[0, ends])
        signature = integers("signature", np.uint8).reshape(-1, -(-len(m) // 8))
        bound = upper_bounds(signature, cell["levels"].as_py(), int(count.max()), m, hashes, weights)
        local = np.array([place.get(w, -1) for w in cell["words"].as_py()])[word]  # query word of each entry
        added = gain(count, np.repeat(m, size))
        out = []

        def score(item: int, docs: np.ndarray) -> None:
            entries = spans(ends[docs] - size[docs], size[docs])
            each = np.where(local[entries] >= 0, whole[local[entries]], 0) * added[entries]
            scores = np.add.reduceat(each, np.cumsum(size[docs]) - size[docs])
            best.add(item, scores)
            out.append((item, docs, scores))

        for item in range(len(items)):
            able = np.flatnonzero(bound[item] >= best.least(item))
            if not len(able):
                continue
            whole = weights[item].astype(np.int64)
            able = able[np.argsort(-bound[item, able], kind="stable")]
            score(item, able[:top])  # the most promising ones first: they raise what the others must reach
            rest = able[top:]
            rest = rest[bound[item, rest] >= best.least(item)]
            if len(rest):
                score(item, rest)
        for item, docs, scores in out:
            good = scores >= best.least(item)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(int(good.sum()), item, dtype=np.int32)), cell["docs"].values.take(pa.array(docs[good])),
                 pa.array(scores[good])], ["item", "doc", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = BestScores(len(items), top)
        for batch in batches:
            for r in range(batch.num_rows):
                yield from search(batch, r, best)

    needed = blocks.select("docs", "lengths", "words", "ends", "word", "count", "levels", "signature")
    return needed.mapInArrow(run, f"item int, doc {id_type}, score bigint")


def item_blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """Items (identifier and terms) in blocks of about ``ITEM_BYTES`` of text."""
    block, size = [], 0
    for row in items.toLocalIterator():
        text = bytes(row["text"] or b"")
        block.append((row["item"], Counter(terms_of(text))))
        size += len(text)
        if size >= ITEM_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def lexical_search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   item_id_col: str = "item_id", item_text_col: str = "text", top: int = 20) -> DataFrame:
    """The ``top`` documents of each item: its identifier, ``rank``, the document's identifier and ``score``."""
    spark = docs.sparkSession
    binary = lambda c: F.col(f"`{c}`").cast("string").cast("binary").alias("text")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), binary(text_col))
    id_type, item_type = dict(rows.dtypes)["doc"], items.schema[item_id_col].dataType.simpleString()
    blocks = stash(make_blocks(rows), "search-blocks")
    n_docs, n_terms = blocks.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    found = spark.createDataFrame([], f"item_no long, item_key {item_type}, doc {id_type}, score long")
    base = 0
    for block in item_blocks(items.select(F.col(f"`{item_id_col}`").alias("item"), binary(item_text_col))) if n_docs else ():
        words = spark.createDataFrame([(w,) for w in sorted({t for _, terms in block for t in terms})], "word binary")
        counted = (blocks.select(F.explode(F.arrays_zip("words", "frequency")).alias("w"))
                   .select(F.col("w.words").alias("word"), F.col("w.frequency").alias("n"))
                   .join(F.broadcast(words), "word").groupBy("word").agg(F.sum("n")))  # a block of items: its size is fixed
        frequency = {bytes(w): n for w, n in counted.collect()}
        vocabulary = sorted(frequency)
        weight = {w: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for w, n in frequency.items()}
        place = {w: i for i, w in enumerate(vocabulary)}
        weights = [{place[t]: n * weight[t] for t, n in terms.items() if t in place} for _, terms in block]
        names = spark.createDataFrame([(i, base + i, key) for i, (key, _) in enumerate(block)],
                                      f"item int, item_no long, item_key {item_type}")
        hits = search_blocks(blocks, vocabulary, weights, n_docs, n_terms, id_type, top)
        found = found.unionByName(hits.join(F.broadcast(names), "item").drop("item"))
        base += len(block)
    best = Window.partitionBy("item_no").orderBy(F.desc("score"), F.col("doc").asc_nulls_last())
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
            .select(F.col("item_key").alias(item_id_col), "rank", F.col("doc").alias(id_col), "score"))
