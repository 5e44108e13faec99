"""Language identification with string kernels.

Kernel: the blended-spectrum presence kernel counts the different n-grams (n =
1, 2, 3) that two texts share, divided by the root of the product of their own
counts.  Characters fold to 64 symbols: letters a-z, a hash class for every
other letter (upper and lower case alike), and one symbol for all
that is no letter; so a text is a set within 64 + 64**2 + 64**3 grams.

Model: Nystroem landmarks (training texts spread over the languages) span the
feature map K(x, landmarks) K(landmarks, landmarks)**-1/2, and one-versus-rest
ridge regression on it gives the dual weights.  Training takes at most
``per_lang`` texts a language, drawn by a hash of the identifier (of rows that
share one, the least text), and is small linear algebra on the driver; the sample's size is the documented bound.

Scoring: landmark grams and dual weights fold into one matrix (grams x
languages), and a batch of texts is scored by a product of its presence matrix
with that matrix.  Texts are read whole, long ones in pieces.

Defined cases: null texts, and texts without a letter, give ``und`` with score
0; ties go to the language first in order; a language with fewer texts than
``per_lang`` gives all it has; with no training row every text gives ``und``;
repeated rows are scored each; an empty table gives an empty result; columns
beyond the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SYMBOLS = 64
GRAMS = SYMBOLS + SYMBOLS**2 + SYMBOLS**3
PIECE_CHARS = 1 << 19
BATCH_TEXTS = 64
UNKNOWN = "und"


@cache
def symbol_table() -> np.ndarray:
    """Symbol of every code point: 0 for no letter, 1 to 26 for a to z, else a class."""
    table = np.zeros(0x110000, dtype=np.uint8)
    for i in range(0x110000):
        if (c := chr(i)).isalpha():
            low = ord(c.lower()[0])
            table[i] = low - 96 if 97 <= low <= 122 else 27 + (low * 2654435761 >> 7) % (SYMBOLS - 27)
    return table


def mark_grams(text: str, seen: np.ndarray) -> bool:
    """Set ``seen`` (GRAMS flags) for the n-grams of a text; false if it has no letter."""
    seen[:] = False
    for at in range(0, len(text), PIECE_CHARS):
        codes = np.frombuffer(text[max(0, at - 2):at + PIECE_CHARS].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        one = symbol_table()[codes].astype(np.int32)
        two = one[:-1] * SYMBOLS + one[1:]
        seen[one] = True
        seen[SYMBOLS + two] = True
        seen[SYMBOLS + SYMBOLS**2 + two[:-1] * SYMBOLS + one[2:]] = True
    return bool(seen[1:SYMBOLS].any())


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, may_learn: Column,
                    per_lang: int) -> list[tuple[str, np.ndarray]]:
    """Language and gram numbers of at most ``per_lang`` texts a language.  The
    gram sets are made in tasks, so what comes to the driver is bounded by
    languages x per_lang x GRAMS, however long the texts."""
    pool = docs.filter(may_learn & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    order = Window.partitionBy("lang").orderBy("draw", "row_id")
    drawn = (pool.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("row_id"), F.xxhash64(id_col, F.lit(5)).alias("draw"))
             .withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= per_lang).select("row_id").distinct())
    texts = (pool.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
             .join(F.broadcast(drawn), "row_id", "left_semi")  # at most languages x per_lang identifiers
             .groupBy("row_id", "lang").agg(F.min("text").alias("text")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(GRAMS, dtype=bool)
        for batch in batches:
            found = []
            for text in batch.column("text"):
                mark_grams(text.as_py(), seen)
                found.append(np.flatnonzero(seen).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("lang"), pa.array(found, pa.binary())],
                                             ["row_id", "lang", "grams"])

    rows = texts.mapInArrow(sets, f"row_id {dict(texts.dtypes)['row_id']}, lang string, grams binary").collect()
    return sorted(((r["lang"], np.frombuffer(r["grams"], dtype=np.int32)) for r in rows),
                  key=lambda x: (x[0], x[1].tobytes()))


def fit(sample: list[tuple[str, np.ndarray]], landmarks: int, ridge: float):
    """(languages, gram numbers, weights grams x languages, offset) of the folded model."""
    langs = sorted({lang for lang, _ in sample})
    y = np.array([[float(lang == x) for x in langs] for lang, _ in sample])
    grams = np.unique(np.concatenate([g for _, g in sample]))
    at = [np.searchsorted(grams, g) for _, g in sample]
    per_lang = -(-landmarks // len(langs))
    which = np.concatenate([np.flatnonzero(y[:, i])[:per_lang] for i in range(len(langs))])
    z = np.zeros((len(which), len(grams)), dtype=np.float32)  # only landmarks have a row of all grams
    for i, row in enumerate(which):
        z[i, at[row]] = 1 / np.sqrt(len(at[row]))
    kernel = np.stack([z[:, own].sum(axis=1) / np.sqrt(len(own)) for own in at])
    value, vector = np.linalg.eigh((z @ z.T).astype(np.float64))
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])  # K(landmarks, landmarks) ** -1/2, up to a rotation
    phi = kernel @ root
    offset = y.mean(axis=0)
    mean = phi.mean(axis=0)
    balance = 1 / (y.sum(axis=0)[y.argmax(axis=1)] * len(langs))  # languages weigh the same
    phi_c = phi - mean
    dual = np.linalg.solve((phi_c * balance[:, None]).T @ phi_c + ridge * np.eye(phi.shape[1]),
                           (phi_c * balance[:, None]).T @ (y - offset))
    weights = (z.T @ (root @ dual)).astype(np.float32)
    used = np.flatnonzero(np.abs(weights).max(axis=1) > 0)
    return langs, grams[used], weights[used], (offset - mean @ dual).astype(np.float32)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                may_learn: Column | None = None, per_lang: int = 300, landmarks: int = 240,
                ridge: float = 1e-4) -> DataFrame:
    """One row per row of ``docs``: identifier, ``lang_pred`` and ``score`` (the
    winner's part of all languages' positive scores, 0 to 1).  Only rows for
    which ``may_learn`` is true are learned from; a prediction reads the text
    alone."""
    may_learn = F.lit(True) if may_learn is None else may_learn
    sample = training_sample(docs, id_col, text_col, lang_col, may_learn, per_lang)
    model = docs.sparkSession.sparkContext.broadcast(fit(sample, landmarks, ridge) if sample else None)
    rows = docs.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("text"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, grams, weights, offset = model.value or ([], np.empty(0, np.int64), None, None)
        seen, flags = np.zeros(GRAMS, dtype=bool), np.zeros((BATCH_TEXTS, len(grams)), dtype=np.float32)
        for batch in batches:
            pred, score = [], []
            for at in range(0, batch.num_rows, BATCH_TEXTS):
                part = batch.column("text").slice(at, BATCH_TEXTS)
                lettered = np.zeros(len(part), dtype=bool)
                for i, text in enumerate(part):
                    if langs and text.is_valid and (lettered_now := mark_grams(text.as_py(), seen)):
                        lettered[i] = lettered_now
                        flags[i] = seen[grams]
                        flags[i] /= np.sqrt(np.count_nonzero(seen))
                if langs:
                    value = flags[:len(part)] @ weights + offset
                    best = value.argmax(axis=1)
                    positive = np.maximum(value, 0)
                    own = positive.max(axis=1) / np.maximum(positive.sum(axis=1), 1e-9)
                for i, known in enumerate(lettered):
                    pred.append(langs[best[i]] if known else UNKNOWN)
                    score.append(float(min(1.0, own[i])) if known else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                                             ["row_id", "lang_pred", "score"])

    out = rows.mapInArrow(predict, f"row_id {dict(rows.dtypes)['row_id']}, lang_pred string, score double")
    return out.withColumnRenamed("row_id", id_col)
