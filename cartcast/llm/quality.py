"""Quality classifier: hashed word n-gram logistic regression, trained by FTRL.

Features are word unigrams and bigrams, and unigrams and bigrams of word
*shapes* (case, length class, last byte, whether the word repeats the one
before), hashed into ``2**BITS`` slots; the value of a feature is its share of
the text's n-grams of its kind, so a score is a sparse dot product of n-gram
shares and weights. Labelled rows are dealt to a fixed number of shards, each
trained by follow-the-regularised-leader updates; the shards' weights are
averaged by document count (iterative parameter mixing with one round).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartcast.llm.common import crc32_bucket, staged
from cartcast.llm.words import NOT_SPACE, Block, Words, blocks, find_words, mix, ngram_hash

BITS = 18
KINDS = 4  # word and shape unigrams and bigrams
BIAS = 1 << BITS  # the slot after the hashed ones
SCALE = 20.0  # of a share; lets the per-slot learning rates work on values near 1
MAX_ROWS = 20_000  # labelled rows used to fit, the first by a hash of the id
SHARDS = 8
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.05
THRESHOLD = 0.7
HELD_OUT_FOLDS, HELD_OUT = 4, 2

_UPPER = np.zeros(256, np.int32)
_UPPER[0x41:0x5B] = 1
_LOWER = np.zeros(256, np.int32)
_LOWER[0x61:0x7B] = 1


def _shapes(block: Block, words: Words) -> Words:
    """The words of a block with each hash replaced by that of the word's shape."""
    first, last = block.data[words.start], block.data[words.end - 1].astype(np.uint64)
    upper, lower = (np.concatenate([[0], np.cumsum(t[block.data])]) for t in (_UPPER, _LOWER))
    shouted = (upper[words.end] - upper[words.start] > 1) & (lower[words.end] == lower[words.start])
    size = np.minimum(words.end - words.start, 31).astype(np.uint64) >> np.uint64(2)
    repeat = np.zeros(len(words.hash), bool)
    repeat[1:] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
    last[((last >= 0x61) & (last < 0x7B)) | (last >= 0x80)] = 0x61  # which letter does not matter
    code = last | _UPPER[first].astype(np.uint64) << np.uint64(8) | size << np.uint64(9)
    code |= shouted.astype(np.uint64) << np.uint64(12) | repeat.astype(np.uint64) << np.uint64(13)
    return Words(words.start, words.end, words.doc, mix(code + np.uint64(1 << 40)), words.counts)


def features(block: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, slot) of every n-gram, one kind at a time."""
    words = find_words(block, NOT_SPACE)
    shapes = _shapes(block, words)
    for source in (words, shapes):
        for n in (1, 2):
            doc, h = ngram_hash(source, n)
            yield doc, (mix(h + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64)


def score_block(block: Block, weights: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each text of a block."""
    z = np.full(block.n, weights[BIAS])
    for doc, slot in features(block):
        n = np.maximum(np.bincount(doc, minlength=block.n), 1)
        z += SCALE * np.bincount(doc, weights[slot], block.n) / n
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def sparse_rows(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Slots and values of each text."""
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    for block in blocks(texts):
        slots, values, where = [], [], []
        for doc, slot in features(block):
            n = np.bincount(doc, minlength=block.n)
            slots.append(slot)
            where.append(doc)
            values.append((SCALE / n[doc]) if len(doc) else np.zeros(0))
        key, inverse = np.unique(np.concatenate(where) << (BITS + 1) | np.concatenate(slots), return_inverse=True)
        value = np.bincount(inverse, np.concatenate(values), len(key))
        cuts = np.searchsorted(key >> (BITS + 1), np.arange(block.n + 1))
        slot = key & ((1 << (BITS + 1)) - 1)
        for i in range(block.n):
            s = slice(cuts[i], cuts[i + 1])
            rows.append((np.append(slot[s], BIAS), np.append(value[s], 1.0)))
    return rows


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int, seed: int = 7) -> np.ndarray:
    """Weights after ``epochs`` passes of FTRL-proximal updates in a fixed random order."""
    z, n = np.zeros(BIAS + 1), np.zeros(BIAS + 1)

    def weights(zi, ni):
        shrunk = np.sign(zi) * np.maximum(np.abs(zi) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(ni)) / ALPHA + L2)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - labels[i]) * x
            more = ni + g * g
            z[at] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / ALPHA * w
            n[at] = more
    return weights(z, n)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    where: Column | None = None,
    max_rows: int = MAX_ROWS,
    shards: int = SHARDS,
    epochs: int = EPOCHS,
) -> np.ndarray:
    """Weights learned from at most ``max_rows`` labelled rows (``2**BITS + 1`` numbers).

    ``where`` selects label rows. Rows without id or label are not used; with
    no labelled rows at all the weights are zero and every score is 0.5. The
    broadcast of the chosen labels is bounded by ``max_rows``, and so are the
    texts learned from: of an id that has several, the one of smallest hash.
    """
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if where is not None:
        chosen = chosen.where(where)
    chosen = (
        chosen.select(F.col(id_col).cast("long").alias("__q_id"), F.col(label_col).cast("int").alias("__q_y"))
        .orderBy(F.xxhash64("__q_id"), "__q_id", "__q_y")
        .limit(max_rows)
    )
    texts = docs.select(F.col(id_col).cast("long").alias("__q_id"), F.col(text_col).cast("string").alias("__q_text"))
    rows = texts.join(F.broadcast(chosen), "__q_id").groupBy("__q_id", "__q_y")
    rows = rows.agg(F.min(F.struct(F.xxhash64("__q_text").alias("h"), "__q_text")).alias("first"))
    rows = rows.select(
        "__q_id",
        "__q_y",
        F.col("first")["__q_text"].alias("__q_text"),
        F.pmod(F.xxhash64("__q_id", F.lit(1)), F.lit(shards)).alias("__q_shard"),
    )

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__q_id", "__q_y"], kind="stable")
        w = ftrl(sparse_rows(pa.array(pdf["__q_text"], pa.string(), from_pandas=True)), pdf["__q_y"].to_numpy(float), epochs)
        slot = np.flatnonzero(w)
        n = float(len(pdf))
        return pd.DataFrame({"slot": np.append(slot, -1), "w": np.append(w[slot] * n, n)})

    trained = staged(rows.groupBy("__q_shard").applyInPandas(train, "slot long, w double"), "quality-weights")
    model = np.zeros(BIAS + 1)
    found = trained.groupBy("slot").agg(F.sum("w").alias("w")).toPandas()  # at most 2**BITS + 2 rows
    total = found.loc[found["slot"] == -1, "w"].sum()
    found = found[found["slot"] >= 0]
    if total:
        model[found["slot"].to_numpy()] = found["w"].to_numpy() / total
    return model


def score(docs: DataFrame, model: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (probability of label 1) of every document's whole text."""
    small = model.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = small.astype(np.float64)
        for batch in batches:
            parts = [score_block(b, weights) for b in blocks(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(parts or [np.zeros(0)]))], ["__q_id", "__q_score"]
            )

    source = docs.select(F.col(id_col).cast("long").alias("__q_id"), F.col(text_col).cast("string").alias("__q_text"))
    return source.mapInArrow(run, "__q_id long, __q_score double").select(
        F.col("__q_id").alias(id_col), F.col("__q_score").alias("score")
    )


def training_rows(id_col: str = "doc_id") -> Column:
    """Labels that may be learned from: all but the held-out fold."""
    return crc32_bucket(id_col, HELD_OUT_FOLDS) != HELD_OUT


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every document.

    A null text counts as empty and gets the score of no words at all; a null
    doc_id is scored and not held out; repeated rows are scored each. Other
    columns are ignored.
    """
    model = fit(docs, labels, where=training_rows())
    return score(docs, model).select(
        "doc_id",
        F.coalesce(crc32_bucket("doc_id", HELD_OUT_FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(
    docs: DataFrame, labelled_docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text_col: str = "text"
) -> DataFrame:
    """Documents whose text scores at least ``threshold``, all their columns kept.

    ``labelled_docs`` holds the texts that ``labels`` speak of. The score is
    attached where the text lies, so nothing is shuffled.
    """
    model = fit(labelled_docs, labels, where=training_rows()).astype(np.float32)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        weights = model.astype(np.float64)
        parts = [score_block(b, weights) for b in blocks(pa.array(texts, pa.string(), from_pandas=True))]
        return pd.Series(np.concatenate(parts or [np.zeros(0)]))

    return docs.where(scored(F.col(text_col).cast("string")) >= threshold)
