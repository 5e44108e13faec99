"""Phrase collocations from FM-indexes over word ids.

Texts are cut into pieces at punctuation and line ends and into words at blanks.
Everything is per language.  A task packs the words of its texts into shards of
one language and about ``SHARD_WORDS`` words, as numbers from the shard's own word
list (0 between pieces).

A shard's index is bidirectional: the Burrows-Wheeler transforms of the number
sequence and of the sequence read backwards, in order of the first ``max_words``
words (more is never compared).  A phrase is a pair of intervals of one size.  In
the forward transform the interval holds the words to the left of all its
occurrences, in the backward transform the words to the right; counting them
gives all extensions by one word with their numbers of occurrences and both new
intervals.  All phrases of one length are extended at once.

Shards work length by length and sums across shards decide between.  A phrase
of k + 1 words is counted in a shard only if it comes up as left extension of a
phrase of k words and as right extension of another, both of which occur
``min_count`` times in all shards together: no rarer part can be in a wanted phrase.

Words and phrases that occur ``min_count`` times have numbers, per length and nearly
without gaps.  A longer phrase is the pair of the numbers of what is before its last
and after its first word: one number of twice the bits, mixed one to one (no two
phrases share one), so that ranges of it are of one size.  A shard reports its phrases
in order, as differences of some 3 bytes each with counts; ranges are added up over
all shards, which is exact.  A shard gets back one bit a phrase and some 2 bytes for
the number of each that passes, and finds its phrases a second time to keep those.  A
phrase as such is one row, whatever the number of shards that have it, and no row
per shard and phrase is dealt out.  No table of phrases is broadcast, and the shards
stay where they are (a table bucketed by shard).

Counts of first and last parts come along from the shorter phrases, products are
DECIMAL(38,0).  A phrase is dropped if an extension by one word has at least
``covered`` percent of its count; a longer phrase with it holds such an extension, so
one word is enough.

Defined cases: null text has no words, null language is ``und``; only A-Z are
lower-cased; texts are read whole, very long ones in portions cut between pieces;
repeated rows count as texts of their own; ties go by score, count, phrase in
byte order; an empty table gives an empty result; columns beyond the two named
ones are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sqlscore.llm.arrays import spans
from sqlscore.session import scratch_path, stash

BETWEEN_PIECES = b".,;:!?\n\x0b\x0c\r"
TO_PIECES = bytes.maketrans(BETWEEN_PIECES + b"\t", b"." * len(BETWEEN_PIECES) + b" ")  # no other white space is left
SHARD_WORDS = 1 << 20
HELD_WORDS = 3 * SHARD_WORDS  # of all languages that a task is filling shards of
PORTION = 1 << 22             # bytes of a long text taken at a time
TASK_BITS = 16                # of a shard number: shard in the task
RANGE_BITS = 6                # ranges of the keys at least, as a power of two
RANGE_WORDS = 21              # words of the input for each range, as a power of two
MANY = 255                    # counts from here on stand apart
MIXERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)  # odd

SHARDS = "shard bigint, lang string, size bigint, words array<binary>, counts array<bigint>, numbers binary"
GIVEN = "shard bigint, place binary, back binary, n binary, number binary"  # in planes


# ---------------------------------------------------------------- numbers as bytes

def to_planes(numbers: np.ndarray, width: int) -> bytes:
    """All first bytes, then all second ones and so on: small numbers then compress."""
    return np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def from_planes(data: bytes, width: int, n: int | None = None) -> np.ndarray:
    n = len(data) // width if n is None else n
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(data, dtype=np.uint8, count=n * width).reshape(width, n).T
    return out.reshape(-1).view("<u8")


# ---------------------------------------------------------------- shards

def portions(data: bytes) -> Iterator[bytes]:
    """A text in portions that end between pieces."""
    start = 0
    while len(data) - start > PORTION:
        cut = data.find(b".", start + PORTION)
        if cut < 0:
            break
        yield data[start:cut]
        start = cut
    yield data[start:]


class Filling:
    """A shard that is being filled."""

    def __init__(self):
        self.words: dict[bytes, int] = defaultdict()
        self.words.default_factory = self.words.__len__
        self.words[b"."]  # 0 stands between pieces
        self.numbers, self.size = [np.zeros(1, dtype=np.int32)], 0

    def add(self, portion: bytes) -> int:
        words = portion.replace(b".", b" . ").split()
        got = np.fromiter(map(self.words.__getitem__, words), dtype=np.int32, count=len(words))
        kept = (got != 0) | np.r_[False, got[:-1] != 0]  # one 0 is enough
        self.numbers += [got[kept], np.zeros(1, dtype=np.int32)]
        n = int(np.count_nonzero(got))
        self.size += n
        return n

    def row(self, shard: int, lang: str) -> pa.RecordBatch:
        numbers = np.concatenate(self.numbers)
        numbers = numbers[(numbers != 0) | np.r_[True, numbers[:-1] != 0]]
        counts = np.bincount(numbers, minlength=len(self.words))[1:]
        return pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int64()), pa.array([lang]), pa.array([self.size], pa.int64()),
             pa.array([[*self.words][1:]], pa.list_(pa.binary())), pa.array([counts], pa.list_(pa.int64())),
             pa.array([numbers.tobytes()], pa.binary())], ["shard", "lang", "size", "words", "counts", "numbers"])


def make_shards(docs: DataFrame, shard_words: int) -> DataFrame:
    """Texts (``lang``, ``text`` as bytes) to rows of ``SHARDS``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filling: dict[str, Filling] = {}
        made, held = TaskContext.get().partitionId() << TASK_BITS, 0

        def close(lang: str) -> pa.RecordBatch:
            nonlocal made, held
            shard = filling.pop(lang)
            held -= shard.size
            made += 1
            return shard.row(made - 1, lang)

        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
                lang = lang.as_py()
                for portion in portions(text.as_py().lower().translate(TO_PIECES)):
                    held += filling.setdefault(lang, Filling()).add(portion)
                    if filling[lang].size >= shard_words:
                        yield close(lang)
                    elif held > HELD_WORDS:
                        yield close(max(filling, key=lambda k: filling[k].size))
        for lang in [*filling]:
            yield close(lang)

    return docs.mapInArrow(run, SHARDS)


# ---------------------------------------------------------------- index

class Intervals(NamedTuple):
    """Phrases of one length: first row in the forward and in the backward order,
    occurrences and number."""
    lo: np.ndarray
    back: np.ndarray
    n: np.ndarray
    number: np.ndarray


def word_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Places in order of the first ``depth`` symbols from there (cyclic), by prefix doubling."""
    n, bits = len(symbols), int(symbols.max()).bit_length() + 1
    known = min(depth, 62 // bits)
    key = np.zeros(n, dtype=np.int64)
    for j in range(known):
        key = (key << bits) | np.roll(symbols, -j)
    while True:
        order = np.argsort(key)
        if known >= depth:
            return order
        inner = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(np.r_[False, inner[1:] != inner[:-1]])
        step = min(known, depth - known)
        key = rank * n + np.roll(rank, -step)
        known += step


def transform(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Burrows-Wheeler transform (symbol before the suffix of each row) and the
    row of the suffix that begins with that symbol."""
    order = word_order(symbols, depth)
    row = np.empty(len(order), dtype=np.int64)
    row[order] = np.arange(len(order))
    return symbols[order - 1], row[order - 1]


def extend(lo: np.ndarray, other: np.ndarray, n: np.ndarray, index: tuple[np.ndarray, np.ndarray]):
    """Extensions of all intervals by one symbol (0 aside): new first row here
    and in the other order, occurrences and the place of the phrase extended."""
    symbol, to = index
    rows = spans(lo, n)
    if not len(rows):
        return (np.empty(0, dtype=np.int64),) * 4
    parent = np.repeat(np.arange(len(lo)), n)
    key = parent * (int(symbol.max()) + 1) + symbol[rows]
    by = np.argsort(key, kind="stable")
    key = key[by]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    parent = parent[by[first]]
    new_lo = np.minimum.reduceat(to[rows[by]], first)
    new_other = other[parent] + first - (np.cumsum(n) - n)[parent]  # smaller symbols come before
    count = np.diff(np.r_[first, len(key)])
    real = symbol[rows[by[first]]] != 0
    return new_lo[real], new_other[real], count[real], parent[real]


def longer_phrases(symbols: np.ndarray, numbers: np.ndarray, phrases: Intervals | None, depth: int):
    """Phrases one word longer that are a left extension of one given phrase and
    a right extension of another: Intervals (without numbers), and the numbers of
    the phrase before the last and after the first word.  ``numbers``: of the words
    (symbols from 1); without ``phrases`` these are the words."""
    forward, backward = transform(symbols, depth), transform(symbols[::-1], depth)
    if phrases is None:
        n = np.bincount(symbols, minlength=len(numbers) + 1)
        lo = (np.cumsum(n) - n)[1:]
        phrases = Intervals(lo, lo, n[1:], numbers)
    left_lo, left_back, n, after = extend(phrases.lo, phrases.back, phrases.n, forward)
    _, right_lo, _, before = extend(phrases.back, phrases.lo, phrases.n, backward)
    _, a, b = np.intersect1d(left_lo, right_lo, assume_unique=True, return_indices=True)
    return left_lo[a], left_back[a], n[a], phrases.number[before[b]], phrases.number[after[a]]


def longer_of(cell: dict, depth: int) -> dict[str, np.ndarray]:
    """The longer phrases of a shard with ``known`` words (place and number) and, beyond
    two words, given phrases (as in ``GIVEN``), in a fixed order."""
    known = cell["known"].as_py()
    local, numbers = (np.concatenate([from_planes(k[f], w) for k in known]).astype(np.int64) for f, w in (("place", 4), ("number", 8)))
    order = np.argsort(local)
    text = np.frombuffer(cell["numbers"].as_buffer(), dtype=np.int32)
    recode = np.zeros(max(int(text.max()), int(local.max())) + 1, dtype=np.int64)
    recode[local[order]] = np.arange(1, len(local) + 1)
    symbols = recode[text]
    symbols = symbols[(symbols != 0) | np.r_[True, symbols[:-1] != 0]]
    phrases = None
    if "place" in cell:
        place, back, n = (from_planes(cell[f].as_py(), 4).astype(np.int64) for f in ("place", "back", "n"))
        phrases = Intervals(np.cumsum(place), back, n, from_planes(cell["number"].as_py(), 8).astype(np.int64))
    lo, back, n, prefix, suffix = longer_phrases(symbols, numbers[order], phrases, depth)
    return {"place": lo, "back": back, "n": n.astype(np.int64), "prefix": prefix, "suffix": suffix}


# ---------------------------------------------------------------- sums across shards

class Keys(NamedTuple):
    """Phrases as numbers: those of both parts, of ``half`` bits each, mixed one to one."""
    half: int
    range_bits: int

    @property
    def bits(self) -> int:
        return max(2 * self.half, self.range_bits + 8)

    @property
    def width(self) -> int:
        """Bytes of a difference within a range."""
        return -(-(self.bits - self.range_bits) // 8)

    def of(self, prefix: np.ndarray, suffix: np.ndarray) -> np.ndarray:
        key = (prefix.astype(np.uint64) << np.uint64(self.half)) | suffix.astype(np.uint64)
        mask, shift = np.uint64((1 << self.bits) - 1), np.uint64(-(-self.bits // 2))
        with np.errstate(over="ignore"):
            for odd in MIXERS:
                key = (key * np.uint64(odd)) & mask
                key ^= key >> shift
        return key

    def parts(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask, shift = np.uint64((1 << self.bits) - 1), np.uint64(-(-self.bits // 2))
        with np.errstate(over="ignore"):
            for odd in MIXERS[::-1]:
                key = key ^ (key >> shift)
                key = (key * np.uint64(pow(odd, -1, 1 << 64))) & mask
        return (key >> np.uint64(self.half)).astype(np.int64), (key & np.uint64((1 << self.half) - 1)).astype(np.int64)

    def start(self, r: int) -> np.uint64:
        return np.uint64(r << (self.bits - self.range_bits))

    def in_order(self, found: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys in order, the order, and where each range begins and the last ends."""
        key = self.of(found["prefix"], found["suffix"])
        order = np.argsort(key)
        edges = np.arange((1 << self.range_bits) + 1, dtype=np.uint64) << np.uint64(self.bits - self.range_bits)
        return key[order], order, np.searchsorted(key[order], edges)


def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i] for name in batch.schema.names}


def by_range(reported: DataFrame, range_bits: int, add: Callable[[list[dict]], pa.RecordBatch], schema: str) -> DataFrame:
    """``add`` gets all rows of one range at a time, in order of the shards."""
    def add_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for cell in cells_of(batches):
            if held and held[-1]["range"] != cell["range"].as_py():
                yield add(held)
                held = []
            held.append({k: v if k == "words" else v.as_py() for k, v in cell.items()})
        if held:
            yield add(held)

    dealt = reported.repartition(1 << range_bits, "range").sortWithinPartitions("range", "shard")
    return dealt.mapInArrow(add_ranges, schema)


def often_words(shards: DataFrame, min_count: int, range_bits: int) -> tuple[DataFrame, DataFrame]:
    """Words that occur ``min_count`` times: one row each (``number``, ``lang``, ``a``, ``word``), and
    for each shard with some of them a row of ``known`` (``place`` and ``number`` in planes)."""
    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in cells_of(batches):
            lang, n = cell["lang"].as_py().encode() + b" ", np.asarray(cell["counts"].values)
            words = [lang + w for w in cell["words"].values.to_pylist()]
            of = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words)) >> np.uint64(64 - range_bits)
            order = np.argsort(of, kind="stable")
            edges = np.searchsorted(of[order], np.arange((1 << range_bits) + 1, dtype=np.uint64))
            rows = np.flatnonzero(np.diff(edges))
            offsets = pa.array(np.r_[edges[rows], len(words)].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(rows), cell["shard"].as_py(), dtype=np.int64)), pa.array(rows.astype(np.int32)),
                 pa.ListArray.from_arrays(offsets, pa.array(words, pa.binary()).take(pa.array(order))),
                 pa.array([to_planes(n[order[edges[r]:edges[r + 1]]], 8) for r in rows], pa.binary()),
                 pa.array([to_planes(order[edges[r]:edges[r + 1]] + 1, 4) for r in rows], pa.binary())],
                ["shard", "range", "words", "n", "place"])

    def add(held: list[dict]) -> pa.RecordBatch:
        coded = pa.concat_arrays([x["words"].values for x in held]).dictionary_encode()
        group = np.asarray(coded.indices)
        total = np.bincount(group, weights=np.concatenate([from_planes(x["n"], 8) for x in held])).astype(np.int64)
        often = total >= min_count
        number = ((np.cumsum(often) - 1) << range_bits) + held[0]["range"]
        shard, places, numbers = [], [], []
        for x, own in zip(held, np.split(group, np.cumsum([len(x["words"]) for x in held])[:-1]), strict=True):
            if (passed := often[own]).any():
                shard.append(x["shard"])
                places.append(to_planes(from_planes(x["place"], 4)[passed], 4))
                numbers.append(to_planes(number[own[passed]], 8))
        found = [w.rsplit(b" ", 1) for w in coded.dictionary.take(pa.array(np.flatnonzero(often))).to_pylist()]
        none = [None] * len(shard)
        return pa.RecordBatch.from_arrays(
            [pa.array([*shard, None], pa.int64()), pa.array([*places, None], pa.binary()), pa.array([*numbers, None], pa.binary()),
             pa.array([*none, [{"number": i, "lang": lang.decode(), "a": a, "word": word} for i, a, (lang, word)
                               in zip(number[often].tolist(), total[often].tolist(), found, strict=True)]],
                      pa.list_(pa.struct([("number", pa.int64()), ("lang", pa.string()), ("a", pa.int64()), ("word", pa.binary())])))],
            ["shard", "place", "number", "found"])

    reported = shards.mapInArrow(report, "shard bigint, range int, words array<binary>, n binary, place binary")
    summed = stash(by_range(reported, range_bits, add, "shard bigint, place binary, number binary, "
                            "found array<struct<number:bigint,lang:string,a:bigint,word:binary>>"), "phrases-1")
    known = summed.filter("shard IS NOT NULL").groupBy("shard").agg(F.collect_list(F.struct("place", "number")).alias("known"))
    return summed.filter("shard IS NULL").select(F.inline("found")), known


def often_phrases(shards: DataFrame, find: Callable[[dict], dict], keys: Keys, min_count: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Phrases that ``find`` finds in shards and that occur ``min_count`` times in all: one row each (``number``,
    ``a``, ``prefix``, ``suffix``), and for each shard with some of them a row of ``GIVEN``."""
    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in cells_of(batches):
            found = find(cell)
            key, order, edges = keys.in_order(found)
            n = found["n"][order]
            rows = np.flatnonzero(np.diff(edges))
            packed = []
            for r in rows:
                a, b = edges[r], edges[r + 1]
                packed.append(to_planes(np.diff(key[a:b], prepend=keys.start(int(r))), keys.width) + np.minimum(n[a:b], MANY).astype(np.uint8).tobytes()
                              + n[a:b][n[a:b] >= MANY].astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), cell["shard"].as_py(), dtype=np.int64)), pa.array(rows.astype(np.int32)),
                                              pa.array(np.diff(edges)[rows].astype(np.int32)), pa.array(packed, pa.binary())],
                                             ["shard", "range", "size", "packed"])

    def add(held: list[dict]) -> pa.RecordBatch:
        all_keys, counts = [], []
        for x in held:
            all_keys.append(np.cumsum(from_planes(x["packed"], keys.width, x["size"])))
            n = np.frombuffer(x["packed"], dtype=np.uint8, count=x["size"], offset=x["size"] * keys.width).astype(np.int64)
            n[n == MANY] = np.frombuffer(x["packed"][x["size"] * (keys.width + 1):], dtype="<i4")
            counts.append(n)
        key, group = np.unique(np.concatenate(all_keys), return_inverse=True)
        total = np.bincount(group, weights=np.concatenate(counts)).astype(np.int64)
        often = total >= min_count
        rank = np.cumsum(often) - 1
        shard, bits, ranks = [], [], []
        for x, own in zip(held, np.split(group, np.cumsum([x["size"] for x in held])[:-1]), strict=True):
            if (passed := often[own]).any():
                shard.append(x["shard"])
                bits.append(np.packbits(passed).tobytes())
                ranks.append(to_planes(np.diff(rank[own[passed]], prepend=0), 4))
        none = [None] * len(shard)
        return pa.RecordBatch.from_arrays(
            [pa.array([*shard, None], pa.int64()), pa.array([held[0]["range"]] * (len(shard) + 1), pa.int32()),
             pa.array([*bits, None], pa.binary()), pa.array([*ranks, None], pa.binary()),
             pa.array([*none, to_planes(key[often] + keys.start(held[0]["range"]), 8)], pa.binary()), pa.array([*none, to_planes(total[often], 8)], pa.binary())],
            ["shard", "range", "bits", "ranks", "key", "a"])

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in cells_of(batches):
            prefix, suffix = keys.parts(from_planes(cell["key"].as_py(), 8))
            number = (np.arange(len(prefix)) << keys.range_bits) + cell["range"].as_py()
            yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(from_planes(cell["a"].as_py(), 8).astype(np.int64)), pa.array(prefix),
                                              pa.array(suffix)], ["number", "a", "prefix", "suffix"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in cells_of(batches):
            found = find(cell)
            _, order, edges = keys.in_order(found)
            at, number = [], []
            for m in cell["masks"].as_py():
                a, b = edges[m["range"]], edges[m["range"] + 1]
                at.append(order[a:b][np.unpackbits(np.frombuffer(m["bits"], dtype=np.uint8), count=b - a).astype(bool)])
                number.append((np.cumsum(from_planes(m["ranks"], 4)).astype(np.int64) << keys.range_bits) + m["range"])
            at, number = np.concatenate(at), np.concatenate(number)
            by = np.argsort(at)  # in order of places
            at = at[by]
            yield pa.RecordBatch.from_arrays(
                [pa.array([cell["shard"].as_py()], pa.int64())] + [pa.array([x], pa.binary()) for x in (
                    to_planes(np.diff(found["place"][at], prepend=0), 4), to_planes(found["back"][at], 4),
                    to_planes(found["n"][at], 4), to_planes(number[by], 8))], ["shard", "place", "back", "n", "number"])

    reported = shards.mapInArrow(report, "shard bigint, range int, size int, packed binary")
    summed = stash(by_range(reported, keys.range_bits, add, "shard bigint, range int, bits binary, ranks binary, key binary, a binary"), name)
    masks = summed.filter("shard IS NOT NULL").groupBy("shard").agg(F.collect_list(F.struct("range", "bits", "ranks")).alias("masks"))
    return (summed.filter("shard IS NULL").select("range", "key", "a")
            .mapInArrow(phrases, "number bigint, a bigint, prefix bigint, suffix bigint"),
            shards.join(masks, "shard").mapInArrow(keep, GIVEN))


def by_shard(rows: DataFrame, buckets: int, name: str) -> DataFrame:
    """Write a table bucketed by shard: joins by shard then leave it where it is."""
    spark = rows.sparkSession
    path = scratch_path(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    rows.write.bucketBy(buckets, "shard").option("path", path).saveAsTable(table)
    return spark.table(table)


def phrase_tables(words: DataFrame, longer: list[DataFrame]) -> list[DataFrame]:
    """For each length a table of ``number``, ``lang``, ``a``, ``words`` and the counts
    ``heads`` of the first 1, 2, ... words and ``tails`` of what is left after them."""
    none = F.array().cast("array<bigint>")
    tables = [words.select("number", "lang", "a", F.array(F.col("word").cast("string")).alias("words"),
                                            none.alias("heads"), none.alias("tails"))]
    for level, rows in enumerate(longer):
        shorter = tables[-1]
        head = shorter.select(F.col("number").alias("prefix"), "lang", F.col("words").alias("first_words"),
                              F.concat("heads", F.array("a")).alias("heads"))
        tail = shorter.select(F.col("number").alias("suffix"), F.element_at("words", -1).alias("last_word"),
                              F.concat(F.array("a"), "tails").alias("tails"))
        table = (rows.join(head, "prefix").join(tail, "suffix")
                 .select("number", "lang", "a", F.concat("first_words", F.array("last_word")).alias("words"),
                         "heads", "tails", "prefix", "suffix"))
        tables.append(stash(table, f"phrases-{level + 2}"))
    return tables


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = 100,
                 max_words: int = 5, covered: int = 100, top: int = 2000, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The ``top`` phrases of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``,
    ``r``, ``n`` and ``score``."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"),
                        F.col(f"`{text_col}`").cast("string").cast("binary").alias("text")).filter(F.col("text").isNotNull())
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = by_shard(make_shards(texts, shard_words), buckets, "phrase-shards")
    total = shards.agg(F.sum("size")).first()[0] or 0
    range_bits = max(RANGE_BITS, int(total).bit_length() - RANGE_WORDS)
    words, known = often_words(shards.select("shard", "lang", "words", "counts"), min_count, range_bits)
    indexed = shards.select("shard", "numbers").join(by_shard(known, buckets, "phrase-words"), "shard")
    longer: list[DataFrame] = []
    given, shorter = indexed, words
    for size in range(2, max_words + 1):
        half = max(1, int(shorter.agg(F.max("number")).first()[0] or 0).bit_length())
        if half > 31:
            raise ValueError("more than 2**31 phrases of one length occur min_count times")
        shorter, kept = often_phrases(given, partial(longer_of, depth=size), Keys(half, range_bits), min_count, f"phrases-sums-{size}")
        longer.append(shorter)
        if size < max_words:
            given = indexed.join(by_shard(kept, buckets, f"phrase-rows-{size}"), "shard")
    tables = phrase_tables(words, longer)[1:]
    pairs = [t.select(F.explode(F.array("prefix", "suffix")).alias("number"), F.col("a").alias("longer")) for t in tables[1:]]
    found = None
    for i, table in enumerate(tables):
        table = table.select("number", "lang", "a", "words", "heads", "tails")
        if i < len(pairs):
            most = pairs[i].groupBy("number").agg(F.max("longer").alias("longer"))
            table = (table.join(most, "number", "left")
                     .filter(F.coalesce(100 * F.col("longer") < covered * F.col("a"), F.lit(True))).drop("longer"))
        found = table if found is None else found.unionByName(table)
    totals = shards.groupBy("lang").agg(F.sum("size").alias("n"))
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    cut = F.posexplode(F.arrays_zip("heads", "tails")).alias("k", "cut")
    score = F.expr("cast(1000 * whole AS decimal(38,0)) div cast(part AS decimal(38,0))")
    cuts = (found.join(totals, "lang").select("lang", "a", "n", "words", cut)
            .select("lang", "a", "n", "words", "k", F.col("cut.heads").alias("l"), F.col("cut.tails").alias("r"))
            .withColumn("whole", exact("a") * exact("n")).withColumn("part", exact("l") * exact("r"))
            .withColumn("score", score))
    scored = (cuts.groupBy("lang", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("least"))
              .select("lang", F.array_join("words", " ").alias("phrase"), "a", "least.l", "least.r", "n", "least.score"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (scored.withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= top)
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
