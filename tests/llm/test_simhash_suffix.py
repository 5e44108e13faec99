"""SimHash linking and suffix-array dedup against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sqlscore.llm import simhash as S
from sqlscore.llm import suffix_dedup as X
from sqlscore.llm.components import components


def least_linked(values, linked):
    """Least index of each value's component, by plain search."""
    label = list(range(len(values)))
    changed = True
    while changed:
        changed = False
        for i in range(len(values)):
            for j in linked(i):
                low = min(label[i], label[j])
                changed |= label[i] != low or label[j] != low
                label[i] = label[j] = low
    return label


def naive_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_family(rng, n):
    base, out = [int(x) for x in rng.integers(0, 1 << 63, 12)], []
    for i in range(n):
        x = base[i % 12]
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            x ^= 1 << int(b)
        out.append(x)
    return np.unique(np.array(out, dtype=np.uint64))


@pytest.mark.parametrize("hot", [2048, 3])
def test_links_of_fingerprints(spark, hot):
    fps = near_family(np.random.default_rng(hot), 400)
    want = least_linked(fps, lambda i: np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3).tolist())
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    dealt = S.buckets(df, hot).repartition("tab", "key").sortWithinPartitions("tab", "key", "fp")
    root = {r["node"]: r["root"] for r in components(dealt.mapInArrow(S.compare_buckets, "u bigint, v bigint")).collect()}
    at = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    got = [root.get(int(x), int(x)) for x in fps.view(np.int64)]
    pairs = {(a, b) for a, b in zip(got, want, strict=True)}
    assert len(pairs) == len(set(got)) == len(set(want)) and at


def test_long_buckets_split_over_batches():
    import pyarrow as pa
    fps = np.sort(near_family(np.random.default_rng(9), 600).view(np.int64))
    batch = lambda a, b: pa.RecordBatch.from_arrays(
        [pa.array(np.zeros(b - a, np.int32)), pa.array(np.zeros(b - a, np.int64)), pa.array(fps[a:b])], ["tab", "key", "fp"])
    one = [b.to_pylist() for b in S.compare_buckets(iter([batch(0, len(fps))]))]
    many = [b.to_pylist() for b in S.compare_buckets(iter([batch(i, min(i + 7, len(fps))) for i in range(0, len(fps), 7)]))]
    assert sum(one, []) == sum(many, [])


def test_simhash_dedup_edges(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "One"), (6, "one two"), (7, text), (8, text.upper()), (8, text),
            (9, text.replace("w40", "w41")), (None, text), (10, "x " * 200_000), (11, "a b c d")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {c: F.lit(1) for c in ("fp", "root", "tab", "row_id", "component_id", "text_key")})
    out = S.simhash_dedup(df).collect()
    fp = {t: naive_fingerprint(t) for _, t in rows}
    values = [fp[t] for _, t in rows]
    label = least_linked(values, lambda i: [j for j, v in enumerate(values) if (v ^ values[i]).bit_count() <= 3])
    least = {}
    for (i, _), c in zip(rows, label, strict=True):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    want = Counter((i, f"{fp[t]:016x}", least.get(c)) for (i, t), c in zip(rows, label, strict=True))
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in out) == want
    kept = S.keep_one(df, S.simhash_dedup(df))
    assert kept.columns == df.columns
    assert kept.count() == len(set(label))
    assert S.simhash_dedup(df.limit(0)).count() == 0
    assert S.keep_one(df.limit(0), S.simhash_dedup(df.limit(0))).count() == 0


def test_pieces_of_long_texts(monkeypatch):
    text = " ".join(f"w{i % 37}" for i in range(3000)).encode()
    want = S.fingerprint(text)
    monkeypatch.setattr(S, "PIECE_BYTES", 50)
    monkeypatch.setattr(S, "PIECE_SHINGLES", 16)
    assert S.fingerprint(text) == want == int.from_bytes(naive_fingerprint(text.decode()).to_bytes(8, "big"), "big", signed=True)


def repeated(texts, length):
    count = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - length + 1):
            if count[t[i:i + length]] > 1:
                gone[i:i + length] = True
        left = bytes(np.frombuffer(t, np.uint8)[~gone]) if t else b""
        yield len(t), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(left).hexdigest()


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    words = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passages, rows = [words(60) for _ in range(4)], []
    for i in range(40):
        text = words(rng.randint(0, 50))
        for _ in range(rng.randint(0, 3)):
            p, a = rng.choice(passages), rng.randint(0, 60)
            text += p[a:a + rng.randint(20, 200)] + words(rng.randint(0, 20))
        rows.append((i, text))
    return rows + [(100, None), (101, ""), (102, "a" * 500), (103, rows[0][1]), (103, rows[0][1]), (None, rows[1][1]),
                   (104, "xy" * 300)]


@pytest.mark.parametrize("groups", [512, 1])
def test_suffix_dedup(spark, groups):
    rows = corpus(groups)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {c: F.lit(1) for c in ("text_id", "lo", "n", "found", "spans", "bytes", "anchor")})
    out = X.suffix_dedup(df.repartition(3), length=60, group_contexts=groups)
    got = Counter((r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]),
                   hashlib.sha256(r["kept"]).hexdigest()) for r in out.collect())
    texts = [(t or "").encode() for _, t in rows]
    assert got == Counter((i, *x) for (i, _), x in zip(rows, repeated(texts, 60), strict=True))
    assert X.suffix_dedup(df.limit(0), length=60).count() == 0


def test_pieces_of_long_texts_in_slabs(spark, monkeypatch):
    """Contexts found in pieces hold the same windows as those found at once."""
    import pyarrow as pa
    text = random.Random(5).randbytes(5000)
    batch = pa.RecordBatch.from_arrays([pa.array([text], pa.binary())], ["text"])

    def windows():
        return sorted(int(p + a + k) for data, ends, _, places in X.slabs(batch, 100)
                      for a, n, _ in X.contexts_of(data, ends, 100).T
                      for p in [(places - np.r_[0, ends[:-1]])[np.searchsorted(ends, a, side="right")]] for k in range(n))

    assert windows() == list(range(4901))
    monkeypatch.setattr(X, "SLAB", 700)
    assert windows() == list(range(4901))


def test_suffix_order_and_boundaries():
    rng = random.Random(2)
    symbols = np.array([rng.choice((2, 3, 4)) for _ in range(600)] + [0], dtype=np.int16)
    symbols[300:400] = symbols[100:200]
    order = X.suffix_order(symbols, 20)
    plain = [tuple(symbols[i:i + 20]) for i in order]
    assert plain == sorted(plain)
    assert X.common_prefix_boundaries(symbols, order, 20).tolist() == [True] + [a != b for a, b in zip(plain, plain[1:])]
