"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other: the model of a category reads
the text's features and the probabilities of all categories before it.  In
training, those earlier probabilities come from models that had not seen the
row (out-of-fold), so later models learn from the quality of prediction they
will meet; for use, each category is then fitted on all training rows.

Features are word stems: a word (lower case, a run of ASCII letters and
non-ASCII characters) and its beginnings of 4 to 8 bytes, hashed; a text's value for a feature is a damped density,
log(1 + 200 n / (words + 20)).  Five style values join them (length, shares of
symbols, digits, repeated words and one-letter words).  Per category the ``n_features`` with the
largest chi-square are kept, and the model is logistic regression.

Training rows are about ``per_class`` labelled texts for each combination of
labels (all of a rarer one), drawn by a hash of the identifier and weighted back to the class's
true share; the sample's size is the documented bound on what reaches the
driver (hashed features, not texts); of rows that share an identifier the least text
is learned from.  Scoring reads every whole text.

Defined cases: null and wordless texts have probability 0 in every category;
a row counts once per label row that it joins; null labels are left out; a
category with one value in the sample is constant; with no labelled row every
probability is 0; repeated rows are scored each; an empty table gives an empty
result; columns beyond the named ones are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# every ASCII character but a to z ends a word
SPLIT = bytes(i if 97 <= i <= 122 or i > 127 else 32 for i in range(256))
GAP = re.compile(r"[\x00-\x40\x5b-\x60\x7b-\x7f]")
STEMS = (4, 5, 6, 7, 8)
HASH_BITS = 20
PIECE_CHARS = 1 << 20
CACHED_WORDS = 300_000
FOLDS = 5


def words_of(text: str) -> Counter:
    """Words with their counts; a long text is read in pieces that end between words."""
    found: Counter = Counter()
    at = 0
    while at < len(text):
        end = at + PIECE_CHARS
        if end < len(text):
            gap = GAP.search(text, end)
            end = gap.start() if gap else len(text)
        found.update(text[at:end].lower().encode("utf-8", "replace").translate(SPLIT).split())
        at = end
    return found


def features_of(word: bytes) -> list[int]:
    """Hashed features of a word: its beginnings, and itself."""
    out, crc, done = [], 0, 0
    for n in STEMS:
        if len(word) < n:
            break
        crc, done = zlib.crc32(word[done:n], crc), n
        out.append((crc * 2654435761 & 0xFFFFFFFF) >> (32 - HASH_BITS))
    out.append((zlib.crc32(word[done:] + b"=", crc) * 2654435761 & 0xFFFFFFFF) >> (32 - HASH_BITS))
    return out


def damped(count: np.ndarray, words: int) -> np.ndarray:
    return np.log1p(200.0 * count / (words + 20.0))


def style(text: str, words: Counter) -> np.ndarray:
    """Dense features of a text, 0 to about 1 each."""
    n, letters = sum(words.values()), sum(len(w.decode()) * c for w, c in words.items())
    blanks = sum(map(text.count, " \n\t"))
    digits = sum(map(text.count, "0123456789"))
    return np.array([np.log1p(n) / 10, max(0, len(text) - letters - blanks - digits) / (len(text) + 1),
                     digits / (len(text) + 1), 1 - len(words) / (n + 1),
                     sum(c for w, c in words.items() if len(w) == 1) / (n + 1)], dtype=np.float32)


def sparse_row(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers, in order, their values, and the style of a text."""
    words = words_of(text)
    count: Counter = Counter()
    for word, n in words.items():
        for f in set(features_of(word)):
            count[f] += n
    at = np.array(sorted(count), dtype=np.int32)
    return at, damped(np.array([count[f] for f in at.tolist()], dtype=np.float32), sum(words.values())).astype(np.float32), \
        style(text, words)


def labelled_sample(texts: DataFrame, known: DataFrame, categories: list[str], per_class: int):
    """Feature rows, labels and weights of the training sample; only identifiers
    and labels are shuffled, texts are hashed where they are read."""
    labels = F.concat_ws(",", *(F.col(c).cast("string") for c in categories))
    # an identifier counts once on either side, however many rows share it
    pool = (known.dropna(subset=categories).select("row_id", labels.alias("labels")).distinct()
            .join(texts.filter("text IS NOT NULL").select("row_id").distinct(), "row_id").select("row_id", "labels"))
    shares = {r["labels"]: r["n"] for r in pool.groupBy("labels").agg(F.count("*").alias("n")).collect()}
    rates = [(k, min(1.0, per_class / n)) for k, n in sorted(shares.items())]  # at most 2 ** categories
    classes = known.sparkSession.createDataFrame(rates, "labels string, rate double")
    u = F.shiftrightunsigned(F.xxhash64("row_id", F.lit(3)), 11) / F.lit(float(1 << 53))
    drawn = pool.join(F.broadcast(classes), "labels").filter(u < F.col("rate")).select("row_id", "labels")
    # about per_class rows for each class; of rows that share an identifier the least text
    chosen = (texts.filter("text IS NOT NULL").join(F.broadcast(drawn.distinct()), "row_id")
              .groupBy("row_id", "labels").agg(F.min("text").alias("text")).select("labels", "text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [[v.tobytes() for v in sparse_row(x.as_py())] for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("labels"), *(pa.array([m[i] for m in made], pa.binary()) for i in range(3))],
                ["labels", "at", "value", "style"])

    rows = sorted((r["labels"], bytes(r["at"]), bytes(r["value"]), bytes(r["style"])) for r in
                  chosen.mapInArrow(hashed, "labels string, at binary, value binary, style binary").collect())
    drawn_of = Counter(r[0] for r in rows)
    x = [(np.frombuffer(a, np.int32), np.frombuffer(v, np.float32), np.frombuffer(s, np.float32)) for _, a, v, s in rows]
    y = np.array([[float(c) > 0 for c in r[0].split(",")] for r in rows])
    weight = np.array([shares[r[0]] / drawn_of[r[0]] for r in rows])
    return x, y, weight


def best_features(x: list, y: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` features whose presence has the largest chi-square with ``y``."""
    every, got = np.zeros(1 << HASH_BITS, np.int32), np.zeros(1 << HASH_BITS, np.int32)
    for (at, _, _), label in zip(x, y, strict=True):
        every[at] += 1
        if label:
            got[at] += 1
    some = np.flatnonzero(every >= 2)
    share = y.mean()
    expected = every[some] * share
    chi = (got[some] - expected) ** 2 / np.maximum(expected * (1 - share), 1e-9)
    return np.sort(some[np.argsort(-chi, kind="stable")[:n]])


def dense(x: list, chosen: np.ndarray) -> np.ndarray:
    """Inputs of the chosen features, then style."""
    out = np.zeros((len(x), len(chosen)), dtype=np.float32)
    for i, (at, value, _) in enumerate(x):
        where = np.searchsorted(chosen, at)
        known = where < len(chosen)
        known[known] = chosen[where[known]] == at[known]
        out[i, where[known]] = value[known]
    return np.c_[out, np.stack([row[2] for row in x])]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, steps: int = 100) -> tuple[np.ndarray, float]:
    """Weights and bias: accelerated gradient descent on the ridge-penalised log loss."""
    share = np.average(y, weights=weight)
    if share in (0, 1):
        return np.zeros(x.shape[1], np.float32), 20.0 if share else -20.0
    weight = (weight / weight.sum()).astype(np.float32)
    probe = np.ones(x.shape[1], np.float32)
    for _ in range(20):  # largest curvature, for the step
        probe /= np.linalg.norm(probe)
        probe = x.T @ (weight * (x @ probe))
    rate = 1 / (0.25 * (np.linalg.norm(probe) + 1) * 1.1 + ridge)
    w = np.zeros(x.shape[1] + 1, np.float32)
    w[-1] = np.log(share / (1 - share))
    ahead = w.copy()
    for t in range(steps):
        error = weight * (1 / (1 + np.exp(-np.clip(x @ ahead[:-1] + ahead[-1], -30, 30))) - y)
        new = ahead - rate * np.r_[x.T @ error + ridge * ahead[:-1], error.sum()].astype(np.float32)
        ahead = new + (t / (t + 3)) * (new - w)
        w = new
    return w[:-1], float(w[-1])


def probability(x: np.ndarray, model: tuple[np.ndarray, float]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ model[0] + model[1], -30, 30)))


def fit_chain(x: list, y: np.ndarray, weight: np.ndarray, n_features: int, ridge: float):
    """Per category its features, its model (last inputs: earlier categories) and
    the threshold with the best F1 on out-of-fold predictions."""
    fold = np.arange(len(x)) % FOLDS  # rows are in order of labels: folds are stratified
    earlier = np.zeros((len(x), 0), dtype=np.float32)
    chain = []
    for k in range(y.shape[1]):
        target, out = y[:, k].astype(np.float32), np.zeros(len(x), np.float32)
        for f in range(FOLDS):
            train, test = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            if not len(train) or not len(test):
                continue
            chosen = best_features([x[i] for i in train], y[train, k], n_features)
            inputs = np.c_[dense(x, chosen), earlier]
            out[test] = probability(inputs[test], logistic(inputs[train], target[train], weight[train], ridge))
        chosen = best_features(x, y[:, k], n_features)
        model = logistic(np.c_[dense(x, chosen), earlier], target, weight, ridge)
        order = np.argsort(-out, kind="stable")
        caught = np.cumsum((weight * target)[order])
        f1 = 2 * caught / np.maximum(np.cumsum(weight[order]) + (weight * target).sum(), 1e-9)
        best = int(f1.argmax())
        below = out[order[best + 1]] if best + 1 < len(out) else 0.0
        chain.append((chosen, model, float(np.clip((out[order[best]] + below) / 2, 0.05, 0.95)), float(f1[best])))
        earlier = np.c_[earlier, out]
    return chain


def toxicity_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str = "doc_id",
                   text_col: str = "text", per_class: int = 2000, n_features: int = 1000,
                   ridge: float = 1e-4, carry: bool = False) -> DataFrame:
    """One row per row of ``docs``: identifier, and for each category (in chain
    order; a column over ``labels`` that is 1 or 0) its probability and ``is_<category>``.
    With ``carry`` a struct ``row`` of all columns of ``docs`` stands for the identifier."""
    names = list(categories)
    known = labels.select(F.col(id_col).alias("row_id"), *(c.cast("int").alias(n) for n, c in categories.items()))
    texts = docs.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("text"))
    x, y, weight = labelled_sample(texts, known, names, per_class)
    chain = fit_chain(x, y, weight, n_features, ridge) if x else []
    model = docs.sparkSession.sparkContext.broadcast(chain)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = model.value
        chosen = np.unique(np.concatenate([c[0] for c in chain])) if chain else np.empty(0, np.int64)
        place = {int(f): i for i, f in enumerate(chosen)}
        own = [np.searchsorted(chosen, c[0]) for c in chain]
        cache: dict[bytes, tuple[int, ...]] = {}
        for batch in batches:
            out = np.zeros((len(names), batch.num_rows))
            for i, text in enumerate(batch.column("text")):
                text = text.as_py() or ""
                words = words_of(text)
                if not words or not chain:
                    continue
                if len(cache) > CACHED_WORDS:
                    cache.clear()
                count = np.zeros(len(chosen), np.float32)
                for word, n in words.items():
                    at = cache.get(word)
                    if at is None:
                        at = cache[word] = tuple({place[f] for f in features_of(word) if f in place})
                    for j in at:
                        count[j] += n
                value, look = damped(count, sum(words.values())), style(text, words)
                for k, (_, m, _, _) in enumerate(chain):
                    out[k, i] = probability(np.r_[value[own[k]], look, out[:k, i]].astype(np.float32), m)
            flags = [out[k] >= c[2] for k, c in enumerate(chain)] or [np.zeros(batch.num_rows, bool)] * len(names)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_id"), *map(pa.array, out), *map(pa.array, flags)],
                ["row_id", *names, *("is_" + n for n in names)])

    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns)) if carry else F.col(id_col)
    scored = docs.select(own.alias("row_id"), F.col(text_col).alias("text"))
    schema = T.StructType([scored.schema["row_id"], *(T.StructField(n, T.DoubleType()) for n in names),
                           *(T.StructField("is_" + n, T.BooleanType()) for n in names)])
    return scored.mapInArrow(score, schema).withColumnRenamed("row_id", "row" if carry else id_col)
