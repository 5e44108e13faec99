"""Byte-level BPE: texts to token ids and back.

Encoding.  Special tokens are cut out of a text first, the rest is cut into
words by the pre-tokenizer's pattern.  A task takes the words of some megabytes
of text at a time and keeps each different word once: their bytes stand as
symbols in one flat array.  Then come merge rounds.  In a round every pair of
neighbouring symbols has a rank, found by binary search over the sorted pair
keys of the vocabulary; of each word all pairs of its lowest rank are merged, from
the left, and only pairs beside a merge are looked up again.  A word without a
ranked pair is done and leaves the array.

All pairs of a word's lowest rank may go at once because a token made by rank
r is only ever part of pairs of higher rank.  The vocabulary is tested for this;
for one that lacks it a round merges a single pair a word, the leftmost.

Decoding joins the tokens' bytes and reads them as UTF-8; bytes that are none
become U+FFFD, as ids of incomplete sequences do with the tokenizers library.

The vocabulary (a file of that library, read by the driver) goes to the tasks;
its size does not depend on the data.  The pattern's engine and the library follow
different versions of Unicode, and class some code points differently that an older
version leaves unassigned; texts that hold such a one are cut into words by the library.

Defined cases: null and empty texts have no tokens; texts are encoded whole,
long ones portion by portion; repeated rows and null identifiers are rows like any
other; an empty table gives an empty result; columns beyond the two named ones
are not read.
"""

from __future__ import annotations

import json
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed: the byte-level pre-tokenizer's
NO_RANK = np.iinfo(np.int32).max
ID_BITS = 24
SLAB_CHARS = 1 << 21       # of texts whose words are merged together
DECODE_ROWS = 256
PORTION = 1 << 18          # words of a long text taken at a time


class Vocabulary(NamedTuple):
    """What a task needs; a few megabytes, whatever the data."""
    byte_ids: np.ndarray    # token of each byte
    pair_keys: np.ndarray   # left id << ID_BITS | right id, sorted
    pair_ranks: np.ndarray
    pair_ids: np.ndarray    # token of the merged pair
    at_once: bool           # parts of a pair always rank below it
    special: dict[str, int]
    token_bytes: np.ndarray  # bytes of all tokens, one after the other
    token_ends: np.ndarray


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte: itself where it is printable
    Latin-1, the others from U+0100 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def library_words(text: str) -> list[str]:
    from tokenizers.pre_tokenizers import ByteLevel
    return [text[a:b] for _, (a, b) in ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str(text)]


@cache
def unassigned() -> np.ndarray:
    """Flag of every code point that Python's own Unicode table leaves unassigned."""
    return np.fromiter((unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)), dtype=bool, count=0x110000)


def in_doubt(text: str) -> bool:
    """Whether pattern and library may class a code point of the text differently."""
    return not text.isascii() and bool(unassigned()[np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)].any())


def read_vocabulary(path: str) -> Vocabulary:
    """A vocabulary file of the tokenizers library; only the forms handled here are taken."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, cut, out = spec["model"], spec["pre_tokenizer"], spec["decoder"]
    plain = (model["type"] == "BPE" and not any(model.get(k) for k in (
        "dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        and spec["normalizer"] is None and cut["type"] == out["type"] == "ByteLevel"
        and cut["use_regex"] and not cut["add_prefix_space"]
        and not any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]))
    if not plain:
        raise ValueError(f"not a plain byte-level BPE vocabulary: {path}")
    alphabet, ids = byte_alphabet(), model["vocab"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    made = {a + b: rank for rank, (a, b) in reversed([*enumerate(merges)])}
    at_once = len(made) == len(merges) and all(max(made.get(a, -1), made.get(b, -1)) < r for r, (a, b) in enumerate(merges))
    keys = np.array([ids[a] << ID_BITS | ids[b] for a, b in merges], dtype=np.int64)
    order = np.argsort(keys)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    raw = {i: bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
           for token, i in {**ids, **special}.items()}
    tokens = [raw.get(i, b"") for i in range(max(raw) + 1)]
    return Vocabulary(np.array([ids[c] for c in sorted(alphabet, key=alphabet.get)], dtype=np.int32), keys[order],
                      np.arange(len(merges), dtype=np.int32)[order],
                      np.array([ids[a + b] for a, b in merges], dtype=np.int32)[order], at_once, special,
                      np.frombuffer(b"".join(tokens), dtype=np.uint8), np.cumsum([len(t) for t in tokens]))


def pair_places(left: np.ndarray, right: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each pair (NO_RANK if none) and its place among the pair keys."""
    key = (left.astype(np.int64) << ID_BITS) | right
    at = np.minimum(np.searchsorted(vocab.pair_keys, key), len(vocab.pair_keys) - 1)
    return np.where(vocab.pair_keys[at] == key, vocab.pair_ranks[at], NO_RANK), at


def merge_rounds(symbols: np.ndarray, lengths: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of many words in one array, and the number of tokens of each.
    ``symbols``: first tokens of all words, ``lengths`` (1 or more) of each word."""
    word = np.repeat(np.arange(len(lengths)), lengths)
    rank, at = np.full(len(symbols), NO_RANK, dtype=np.int32), np.zeros(len(symbols), dtype=np.int64)
    inner = np.flatnonzero(word[1:] == word[:-1])
    rank[inner], at[inner] = pair_places(symbols[inner], symbols[inner + 1], vocab)
    done = []
    while len(symbols):
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        lowest = np.minimum.reduceat(rank, starts)
        if (lowest == NO_RANK).any():  # finished words leave
            size = np.diff(np.r_[starts, len(symbols)])
            stay = np.repeat(lowest != NO_RANK, size)
            done.append((word[~stay], symbols[~stay]))
            word, symbols, rank, at = word[stay], symbols[stay], rank[stay], at[stay]
            size, lowest = size[lowest != NO_RANK], lowest[lowest != NO_RANK]
            if not len(symbols):
                break
        else:
            size = np.diff(np.r_[starts, len(symbols)])
        pick = np.flatnonzero(rank == np.repeat(lowest, size))
        if vocab.at_once:  # of neighbouring picks, as in a run of one symbol, every second from the left
            run = np.r_[True, (np.diff(pick) != 1) | (word[pick[1:]] != word[pick[:-1]])]
            first = np.flatnonzero(run)
            nth = np.arange(len(pick)) - np.repeat(first, np.diff(np.r_[first, len(pick)]))
            pick = pick[nth % 2 == 0]
        else:
            pick = pick[np.r_[True, word[pick[1:]] != word[pick[:-1]]]]
        symbols[pick] = vocab.pair_ids[at[pick]]
        stay = np.ones(len(symbols), dtype=bool)
        stay[pick + 1] = False
        stale = np.zeros(len(symbols), dtype=bool)
        stale[pick] = True
        word, symbols, rank, at, stale = word[stay], symbols[stay], rank[stay], at[stay], stale[stay]
        stale[:-1] |= stale[1:]  # the pair before a merge changes, too
        ask = np.flatnonzero(stale)
        rank[ask] = NO_RANK
        ask = ask[ask < len(symbols) - 1]
        ask = ask[word[ask] == word[ask + 1]]
        rank[ask], at[ask] = pair_places(symbols[ask], symbols[ask + 1], vocab)
    word, symbols = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (word, symbols)
    return symbols[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(lengths))


def word_lists(text: str, vocab: Vocabulary) -> Iterator[list]:
    """The words of a text in portions; a special token is a tuple."""
    words = regex.compile(WORDS)
    marks = "|".join(regex.escape(s) for s in sorted(vocab.special, key=len, reverse=True))
    sections = regex.split(f"({marks})", text) if marks and any(s in text for s in vocab.special) else [text]
    for nth, section in enumerate(sections):
        if nth % 2:
            yield [(section,)]
        elif in_doubt(section):
            yield library_words(section)
        elif len(section) < PORTION:
            yield words.findall(section)
        else:
            found = words.finditer(section)
            while portion := [m.group() for m in islice(found, PORTION)]:
                yield portion


def encode_words(words: list, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in order, and the number of ids of each word."""
    number: dict = defaultdict()
    number.default_factory = number.__len__
    code = np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words))
    raw = [w.encode("utf-8", "replace") if type(w) is str else b"\0" for w in number]
    lengths = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    symbols = vocab.byte_ids[np.frombuffer(b"".join(raw), dtype=np.uint8)]
    for i, w in enumerate(number):
        if type(w) is tuple:
            symbols[lengths[:i].sum()] = vocab.special[w[0]]
    ids, count = merge_rounds(symbols, lengths, vocab)
    return ids[spans(np.cumsum(count)[code] - count[code], count[code])], count[code]


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of many spans, one after the other."""
    return np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)


def encode_texts(texts: list[str], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in order, and the number of ids of each text."""
    words, owner, ids, sizes, held = [], [], [], np.zeros(len(texts), dtype=np.int64), 0

    def merge():
        got, count = encode_words(words, vocab)
        ids.append(got)
        own = np.repeat([row for row, _ in owner], [n for _, n in owner])
        np.add.at(sizes, own, count)

    for row, text in enumerate(texts):
        for portion in word_lists(text, vocab):
            words += portion
            owner.append((row, len(portion)))
            if len(words) >= PORTION:
                merge()
                words, owner = [], []
    if words:
        merge()
    return np.concatenate(ids) if ids else np.empty(0, dtype=np.int32), sizes


def portions_of(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``limit`` bytes (one row at least)."""
    size = batch.column(column)
    size = np.array(pc.fill_null(pc.binary_length(size), 0))
    cut = np.flatnonzero(np.diff((np.cumsum(size) - size) // limit)) + 1
    for a, b in zip([0, *cut], [*cut, batch.num_rows], strict=True):
        if b > a:
            yield batch.slice(int(a), int(b - a))


def decode_ids(ids: np.ndarray, counts: np.ndarray, vocab: Vocabulary) -> list[str]:
    """Texts of many lists of ids that stand one after the other."""
    start = np.r_[0, vocab.token_ends]
    ids = np.where((ids < 0) | (ids >= len(start) - 1), len(start) - 1, ids)  # no token: no bytes
    size = np.r_[np.diff(start), 0][ids]
    data = vocab.token_bytes[spans(start[ids], size)].tobytes()
    ends = np.r_[0, np.cumsum(size)][np.cumsum(counts)].tolist()
    return [data[a:b].decode("utf-8", "replace") for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """One row per row of ``docs``: identifier and ``ids``, the tokens of its text;
    with ``decode`` also ``decoded``, the text that these tokens give back (a
    round trip in one worker, without handing the ids to a second one)."""
    vocab = read_vocabulary(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions_of(batch, "text", SLAB_CHARS):
                ids, sizes = encode_texts([t or "" for t in part.column("text").to_pylist()], vocab)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(ids, pa.int32()))
                texts = [pa.array(decode_ids(ids, sizes, vocab), pa.string())] if decode else []
                yield pa.RecordBatch.from_arrays([part.column("row_id"), lists, *texts], ["row_id", "ids", "decoded"][:2 + decode])

    rows = docs.select(F.col(f"`{id_col}`").alias("row_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = f"row_id {dict(rows.dtypes)['row_id']}, ids array<int>" + (", decoded string" if decode else "")
    return rows.mapInArrow(run, schema).withColumnRenamed("row_id", id_col)


def bpe_decode(tokens: DataFrame, path: str, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """``tokens`` with a column ``out``, the text of the tokens in ``ids_col``
    (null: no tokens; an id that is no token has no bytes)."""
    vocab = read_vocabulary(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, DECODE_ROWS):
                part = batch.slice(at, DECODE_ROWS)
                lists = part.column(ids_col)
                ids = np.asarray(pc.list_flatten(lists).fill_null(-1))
                counts = np.array(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64)
                texts = pa.array(decode_ids(ids, counts, vocab), pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], [*part.schema.names, out])

    kept = tokens.drop(out)
    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField(out, StringType())]))
