"""Toxicity: class-conditional Kneser-Ney bigram models of toxic and ordinary text.

Every labelled training text is counted, an expression once per text. For class
``c`` (toxic or ordinary)::

    p_c(w | v) = max(n_c(v w) - D, 0) / n_c(v) + back(v) * p_c(w)
    p_c(w)     = max(n_c(w) - D, 0) / N_c     + D * types_c / N_c * p(w)

``p(w)``, the continuation probability of ``w`` (the number of different words
it follows), and the backoff weight ``back(v)`` come from both classes' counts
together. An expression keeps counts of its own only if it is not seen once
only and if its counts differ between the classes beyond chance, whatever the
size of the corpus. All others are left to the backoff the classes share, where
they speak for neither. The expressions kept are a table that grows with the
corpus. Texts are read once: the head of that table, its commonest expressions
up to ``SMALL_ROWS``, is looked up on the way; what may be in the rest, by a
bitmap of fixed size, leaves the pass as a row and is joined. Neither decides
what a text scores. A text's score compares its log-likelihoods per word under
the two models, mapped to a probability by a logistic fit on labelled rows of a
fold that was not counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartcast.llm.common import SMALL_ROWS, attach, crc32_bucket, staged, with_small_side
from cartcast.llm.words import ALNUM, FOLD, Block, blocks, find_words, mix

DISCOUNT = 0.75
LEAST = 2  # an expression seen once is rare in any corpus
Z = 4.0  # standard deviations by which a class's count must be off its share
FOLDS, HELD_OUT, CALIBRATION = 5, 0, 1
CALIBRATION_ROWS = 20_000  # the first of the calibration fold by a hash of the id
THRESHOLD = 0.5
BITMAP = 21  # log2 of the bitmap's 64-bit cells: 16 MB, whatever the model's size

_COUNTS = "v long, w long, n1 long, n0 long"


@dataclass
class Model:
    """Sorted keys and, for each, what it adds to the log-likelihood ratio."""

    words: np.ndarray
    word_llr: np.ndarray  # log p_1(w) / p_0(w)
    pairs: np.ndarray
    pair_llr: np.ndarray  # log p_1(w | v) / p_0(w | v)
    rest: np.ndarray  # bitmap of the keys of expressions that are not among these; empty: there are none


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One key of two words' keys."""
    return _signed(mix(v.view(np.uint64) * np.uint64(0x2545F4914F6CDD1D) + w.view(np.uint64)))


def count_pairs(rows: DataFrame) -> DataFrame:
    """Texts of each class (n1, n0) holding each (word, next word), over rows of (y, text).

    The last word of a text is followed by 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            for block in blocks(batch.column(1), 4 << 20):
                words = find_words(block, ALNUM, FOLD)
                v = _signed(words.hash)
                w = np.zeros_like(v)
                w[:-1] = np.where(words.doc[1:] == words.doc[:-1], v[1:], 0)
                order = np.lexsort((words.doc, w, v))
                v, w, doc = v[order], w[order], words.doc[order]
                new = np.ones(len(v), bool)
                new[1:] = (v[1:] != v[:-1]) | (w[1:] != w[:-1])
                once = new.copy()
                once[1:] |= doc[1:] != doc[:-1]
                v, w, cls, at = v[once], w[once], y[block.first + doc[once]], np.flatnonzero(new[once])
                n1 = np.add.reduceat(cls, at) if len(at) else cls[:0]
                n = np.diff(np.append(at, len(v)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v[at]), pa.array(w[at]), pa.array(n1.astype(np.int64)), pa.array((n - n1).astype(np.int64))],
                    ["v", "w", "n1", "n0"],
                )

    return rows.mapInArrow(run, _COUNTS).groupBy("v", "w").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


@dataclass
class Tables:
    """Written tables of what an expression adds to the log-likelihood ratio."""

    words: DataFrame  # w, llr: log p_1(w) / p_0(w), level
    pairs: DataFrame  # v, w, llr: log p_1(w | v) / p_0(w | v), level
    n_words: int
    n_pairs: int


def learn(rows: DataFrame) -> Tables | None:
    """Model of labelled rows (y, text); None unless both classes have words."""
    pairs = staged(count_pairs(rows), "toxic-pairs")
    types = F.count_if(F.col("w") != 0)
    contexts = pairs.groupBy(F.col("v").alias("k")).agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"), types.alias("types"))
    continued = pairs.where("w != 0").groupBy(F.col("w").alias("k")).agg(F.count(F.lit(1)).alias("cont"))
    words = staged(contexts.join(continued, "k", "left").fillna(0, ["cont"]), "toxic-words")
    total = words.agg(
        F.sum("n1").alias("n1"),
        F.sum("n0").alias("n0"),
        F.count_if(F.col("n1") > 0).alias("u1"),
        F.count_if(F.col("n0") > 0).alias("u0"),
        F.sum("cont").alias("cont"),
        F.count(F.lit(1)).alias("u"),
    ).first()
    if not total["n1"] or not total["n0"]:
        return None
    often = F.greatest("n1", "n0") >= LEAST
    share = total["n1"] / (total["n1"] + total["n0"])
    n = F.col("n1") + F.col("n0")
    differs = F.abs(F.col("n1") - n * share) >= Z * F.sqrt(n * share * (1 - share))

    shared = (F.col("cont") + 0.5) / F.lit(total["cont"] + 0.5 * total["u"] + 0.5)
    p = {}
    for c in "10":
        n_all = total[f"n{c}"]
        mine = F.greatest(F.col(f"n{c}") - DISCOUNT, F.lit(0.0)) / n_all + DISCOUNT * total[f"u{c}"] / n_all * shared
        p[c] = F.when(often & differs, mine).otherwise(shared)
    # How common an expression is, in eighths of a power of two.
    level = F.floor(8 * F.log2(n.cast("double"))).cast("int").alias("level")
    own_words = words.where(often & differs).select(F.col("k").alias("w"), F.log(p["1"] / p["0"]).alias("llr"), level)
    own_words = staged(own_words, "toxic-own-words")

    back = F.least(F.greatest(DISCOUNT * F.col("types") / F.greatest(n, F.lit(1)), F.lit(1e-3)), F.lit(1.0))
    first = words.select(F.col("k").alias("v"), "types", F.col("n1").alias("v1"), F.col("n0").alias("v0"), back.alias("back"))
    second = words.select(F.col("k").alias("w"), "cont", p["1"].alias("p1"), p["0"].alias("p0"))
    # Pairs bring their words' counts along; a word has at most ``types`` and ``cont`` pairs.
    own_pairs = attach(pairs.where("w != 0").where(often & differs), first, ["v"], "types").drop("types")
    own_pairs = attach(staged(own_pairs, "toxic-contexts"), second, ["w"], "cont")
    pc = {
        c: F.greatest(F.col(f"n{c}") - DISCOUNT, F.lit(0.0)) / F.greatest(F.col(f"v{c}"), F.lit(1)) + F.col("back") * F.col(f"p{c}")
        for c in "10"
    }
    own_pairs = staged(own_pairs.select("v", "w", F.log(pc["1"] / pc["0"]).alias("llr"), level), "toxic-own-pairs")
    return Tables(own_words, own_pairs, own_words.count(), own_pairs.count())


def head_level(tables: Tables, most: int) -> int:
    """Least level from which on there are at most ``most`` expressions."""
    levels = tables.words.select("level").unionByName(tables.pairs.select("level")).groupBy("level").count().collect()
    out, n = 8 * 64, 0  # no count reaches 2^64
    for r in sorted(levels, reverse=True):
        n += r["count"]
        if n > most:
            break
        out = r["level"]
    return out


def rest_bitmap(words: DataFrame, pairs: DataFrame) -> np.ndarray:
    """Bitmap of the keys of words and pairs, set by tasks."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, bit = _bit(pair_key(*(c.to_numpy(zero_copy_only=False) for c in batch.columns)))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(_signed(bit))], ["at", "bits"])

    # A word alone has the key of its pair with 0, which no pair is.
    keys = pairs.select("v", "w").unionByName(words.select(F.lit(0).cast("long").alias("v"), "w"))
    cells = keys.mapInArrow(bits, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(1 << BITMAP, np.int64)  # at most so many rows came
    out[cells["at"].to_numpy(np.int64)] = cells["bits"].to_numpy(np.int64)
    return out


def _bit(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell and bit of each key in a bitmap."""
    u = keys.view(np.uint64)
    return (u >> np.uint64(64 - BITMAP)).astype(np.int64), np.uint64(1) << (u & np.uint64(63))


def split_head(tables: Tables, most: int) -> tuple[Model, Tables | None]:
    """The commonest expressions, at most ``most``, as sorted arrays, and the tables of the others."""
    level = head_level(tables, most)
    words = tables.words.where(F.col("level") >= level).toPandas().sort_values("w")
    pairs = tables.pairs.where(F.col("level") >= level).toPandas()
    key = pair_key(pairs["v"].to_numpy(np.int64), pairs["w"].to_numpy(np.int64))
    order = np.argsort(key)
    rest, bitmap = None, np.zeros(0, np.int64)
    if len(words) + len(pairs) < tables.n_words + tables.n_pairs:
        others = [t.where(F.col("level") < level).drop("level") for t in (tables.words, tables.pairs)]
        rest = Tables(*others, tables.n_words - len(words), tables.n_pairs - len(pairs))
        bitmap = rest_bitmap(rest.words, rest.pairs)
    model = Model(
        words["w"].to_numpy(np.int64), words["llr"].to_numpy(float), key[order], pairs["llr"].to_numpy(float)[order], bitmap
    )
    return model, rest


def _look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, otherwise: np.ndarray) -> np.ndarray:
    if not len(keys):
        return otherwise.copy()
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], otherwise)


def _known(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted), bool)
    return keys[np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)] == wanted


@dataclass
class Evidence:
    """Per text, words and what the head adds; the expressions that may be in the rest, with what they were given."""

    n: np.ndarray
    total: np.ndarray
    doc: np.ndarray
    v: np.ndarray  # 0 for a text's first word
    w: np.ndarray
    given: np.ndarray


def evidence(block: Block, model: Model) -> Evidence:
    words = find_words(block, ALNUM, FOLD)
    w = _signed(words.hash)
    v = np.zeros_like(w)
    v[1:] = np.where(words.doc[1:] == words.doc[:-1], w[:-1], 0)
    joint, inner = pair_key(v, w), v != 0
    llr = _look_up(model.words, model.word_llr, w, np.zeros(len(w)))
    llr = np.where(inner, _look_up(model.pairs, model.pair_llr, joint, llr), llr)
    open_ = np.zeros(len(w), bool)
    if len(model.rest):
        bits = model.rest.view(np.uint64)
        maybe = lambda keys: (lambda at, bit: bits[at] & bit != 0)(*_bit(keys))
        own_pair = inner & _known(model.pairs, joint)
        open_ = inner & ~own_pair & maybe(joint)
        open_ |= ~own_pair & ~_known(model.words, w) & maybe(pair_key(np.zeros_like(w), w))
    at = np.flatnonzero(open_)
    return Evidence(words.counts, np.bincount(words.doc, llr, block.n), words.doc[at], v[at], w[at], llr[at])


def text_evidence(rows: DataFrame, model) -> DataFrame:
    """part, row, k, v, w, n, s over rows of (k, text), ``model`` being a broadcast one.

    A text has one row with null v and w, its number of words and the sum of
    what the head adds, and one for each of its distinct (previous word, word)
    that may be in the rest: how often it stands there and what one of it added.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            for block in blocks(batch.column(1), 4 << 20):
                e = evidence(block, model.value)
                order = np.lexsort((e.w, e.v, e.doc))
                v, w, doc, given = e.v[order], e.w[order], e.doc[order], e.given[order]
                new = np.ones(len(v), bool)
                new[1:] = (v[1:] != v[:-1]) | (w[1:] != w[:-1]) | (doc[1:] != doc[:-1])
                at = np.flatnonzero(new)
                of = np.append(np.arange(block.n), doc[at])
                whole = np.arange(len(of)) < block.n
                keys = [np.append(np.zeros(block.n, np.int64), x[at]) for x in (v, w)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(of), part, np.int32)),
                        pa.array(seen + of),
                        batch.column(0).take(pa.array(block.first + of)),
                        *[pa.array(x, mask=whole) for x in keys],
                        pa.array(np.append(e.n, np.diff(np.append(at, len(v)))).astype(np.int64)),
                        pa.array(np.append(e.total, given[at])),
                    ],
                    ["part", "row", "k", "v", "w", "n", "s"],
                )
                seen += block.n

    return rows.mapInArrow(run, "part int, row long, k long, v long, w long, n long, s double")


def scored(rows: DataFrame, model, rest: Tables | None) -> DataFrame:
    """k, a, b over rows of (k, text): log-likelihood ratio per word, and per square root of words.

    Each distinct expression that left the pass gets its ratio once, from its
    pair or else its word; then texts' rows meet it, those of very common ones
    by broadcast.
    """
    every, total = text_evidence(rows, model), F.col("s")
    texts = every
    if rest is not None:
        every = staged(every, "toxic-texts")
        found = every.where("w IS NOT NULL")
        uses = found.groupBy("v", "w").agg(F.count(F.lit(1)).alias("uses"))
        uses = staged(uses.join(rest.pairs, ["v", "w"], "left"), "toxic-uses")
        others = uses.where("llr IS NULL").drop("llr")
        weight = staged(others.groupBy("w").agg(F.count(F.lit(1)).alias("kinds")).join(rest.words, "w"), "toxic-word-uses")
        known = uses.where("llr IS NOT NULL").unionByName(attach(others, weight, ["w"], "kinds").drop("kinds"))
        more = attach(found, staged(known, "toxic-known"), ["v", "w"], "uses").groupBy("part", "row").agg(
            F.sum(F.col("n") * (F.col("llr") - F.col("s"))).alias("more")
        )
        texts = every.where("w IS NULL").join(more, ["part", "row"], "left")
        total = F.col("s") + F.coalesce("more", F.lit(0.0))
    n = F.greatest(F.col("n"), F.lit(1))
    return texts.select("k", (total / n).alias("a"), (total / F.sqrt(n)).alias("b"))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights (constant first) of a logistic fit by Newton's method, on scaled columns."""
    scale = np.maximum(x.std(0), 1e-9)
    a = np.column_stack([np.ones(len(x)), x / scale])
    w, penalty = np.zeros(a.shape[1]), np.diag([1e-9] + [ridge] * x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + penalty @ w
        h = (a * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ a + penalty
        step = np.linalg.solve(h, g)
        w = w - step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[0], w[1:] / scale)


def toxicity_scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """id, held_out, score and predicted for every document.

    Labels of the held-out fold (crc32 of the id modulo 5 is 0) are never
    read. A null text counts as empty and scores as no words do; a null id is
    scored and not held out; repeated rows are scored each; null labels are not
    used. If the labels lack a class, or no word tells the classes apart, every
    score is the share of toxic rows (0.5 without labels). Other columns are
    ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("__tx_id"), F.col(text_col).cast("string").alias("__tx_text"))
    fold = crc32_bucket("__tx_id", FOLDS)
    usable = (
        labels.select(F.col(id_col).cast("long").alias("__tx_id"), F.col(label_col).cast("long").alias("__tx_y"))
        .where(F.col("__tx_y").isin(0, 1) & (fold != HELD_OUT))
    )
    counted = with_small_side(texts, usable.where(fold != CALIBRATION), ["__tx_id"])
    tables = learn(counted.select("__tx_y", "__tx_text"))

    weights = np.zeros(3)
    known = tables is not None and tables.n_words > 0
    if not known:
        seen = usable.agg(F.avg("__tx_y")).first()[0]
        if seen is not None:
            weights[0] = np.log((seen + 0.01) / (1.01 - seen))
        model, rest = Model(*(np.zeros(0, t) for t in (np.int64, float, np.int64, float, np.int64))), None
    else:
        model, rest = split_head(tables, SMALL_ROWS)
    shared = spark.sparkContext.broadcast(model)

    if known:
        chosen = (
            usable.where(fold == CALIBRATION).orderBy(F.xxhash64("__tx_id"), "__tx_id", "__tx_y").limit(CALIBRATION_ROWS)
        )
        rows = texts.join(F.broadcast(chosen), "__tx_id").select("__tx_y", "__tx_text")
        # Ids may have many texts each; the bound is one of rows.
        fitted = scored(rows, shared, rest).orderBy(F.xxhash64("a", "b"), "a", "b", "k").limit(CALIBRATION_ROWS).toPandas()
        if fitted["k"].nunique() == 2:
            weights = logistic(fitted[["a", "b"]].to_numpy(), fitted["k"].to_numpy(float))
        else:
            weights = np.array([0.0, 10.0, 0.0])
    z = F.lit(float(weights[0])) + F.col("a") * float(weights[1]) + F.col("b") * float(weights[2])
    score: Column = 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), z))))
    return scored(texts.select("__tx_id", "__tx_text"), shared, rest).select(
        F.col("k").alias(id_col),
        F.coalesce(crc32_bucket("k", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        score.alias("score"),
        (score >= threshold).cast("int").alias("predicted"),
    )
