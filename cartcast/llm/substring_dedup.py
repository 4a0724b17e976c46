"""Substring deduplication: every passage of enough words that occurs before.

Texts are cut where their content says so: at each byte whose gear hash (a
rolling hash of the last ``WINDOW`` bytes) is the smallest within ``RADIUS``
bytes to both sides. No cut is forced, so an insertion moves no cut beyond its
own surroundings, and equal passages are cut alike but near their ends. The
chunks between cuts are deduplicated by digest, over all documents: a passage
can only occur twice if all chunks that it determines do. What is left are the
windows of ``min_words`` words all of whose chunks are repeated; they are
compared byte for byte by digest, as a chunk may well be repeated elsewhere
than its neighbours. The repeated windows of a document that overlap or touch
are one span, from its first word to its last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartcast.llm.common import Scratch, attach, staged
from cartcast.llm.words import NOT_SPACE, Block, blocks, find_words, span_hash

WINDOW = 16  # bytes the rolling hash sees
RADIUS = 12  # bytes to both sides among which a cut has the smallest hash
BEFORE = RADIUS + WINDOW - 1  # bytes before a cut's own that decide on it
MIN_WORDS = 24  # words of a passage; every repeat of so many words is found

_GEAR = np.random.default_rng(16).integers(0, 1 << 16, 256, dtype=np.uint16)


def gear(data: np.ndarray) -> np.ndarray:
    """Rolling hash at every byte: the sum of its window's gear values, each shifted by its age."""
    h = _GEAR[data]
    age = 1
    while age < WINDOW:
        older = np.zeros_like(h)
        older[age:] = h[:-age] << np.uint16(age) if age < len(h) else 0
        h = h + older
        age *= 2
    return h


def smallest(h: np.ndarray, n: int) -> np.ndarray:
    """The smallest of every ``n`` values in a row."""
    size = 1
    while 2 * size <= n:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (n - size)], h[n - size :]) if size < n else h


def cuts(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(text, byte) after which each text is cut, in order.

    Only bytes with all that decides on them inside their text are cuts, so
    cuts depend on nothing else.
    """
    if len(block.data) <= BEFORE + RADIUS:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = gear(block.data)
    low = smallest(h, RADIUS)
    own = h[RADIUS : len(h) - RADIUS]
    at = np.flatnonzero((own < low[: len(own)]) & (own <= low[RADIUS + 1 :])) + RADIUS
    doc = np.searchsorted(block.offsets, at, "right") - 1
    inside = (at - BEFORE >= block.offsets[doc]) & (at + RADIUS < block.offsets[doc + 1])
    return doc[inside], at[inside]


def chunks(docs: DataFrame) -> DataFrame:
    """doc, at (number of the cut it begins after), digest of every chunk between two cuts of ``docs (doc, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for block in blocks(batch.column(1)):
                doc, cut = cuts(block)
                number = np.arange(len(doc)) - np.searchsorted(doc, doc)
                own = np.flatnonzero(doc[1:] == doc[:-1])
                digest = span_hash(block.data, cut[own] + 1, cut[own + 1] + 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[block.first + doc[own]].astype(np.int64)),
                        pa.array(number[own].astype(np.int32)),
                        pa.array(digest.view(np.int64)),
                    ],
                    ["doc", "at", "digest"],
                )

    return docs.mapInArrow(run, "doc long, at int, digest long")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    return source.where("doc IS NOT NULL AND text IS NOT NULL")


def possible(cut: np.ndarray, repeated: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Which windows hold no chunk that occurs once only.

    ``repeated``: whether the chunk that begins after each cut is. A window
    determines a cut if it holds all the bytes that decide on it, and a chunk
    if it determines both its cuts: then every other place of the window has
    that chunk too. A window that determines none is possible.
    """
    once = np.append(0, np.cumsum(~repeated))
    first = np.searchsorted(cut, start + BEFORE)
    last = np.searchsorted(cut, stop - RADIUS) - 1
    return once[np.maximum(last, first)] == once[first]


def windows(rows: DataFrame, min_words: int) -> DataFrame:
    """The windows of ``min_words`` words of ``rows (doc, text, places)`` that may repeat.

    ``places``: the numbers of the chunks that are repeated. digest, doc, at
    (its first word), start and size (bytes), chunk (cuts before it), more
    (cuts inside), again (it occurs in the text before, not overlapping its
    first place there). Each text of so many words also has a row without
    digest for its whole: ``at`` is then its number of words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for block in blocks(batch.column(1)):
                words = find_words(block, NOT_SPACE)
                first = np.cumsum(words.counts) - words.counts
                doc, cut = cuts(block)
                from_cut, n_cuts = np.searchsorted(doc, np.arange(block.n)), np.bincount(doc, minlength=block.n)
                lists = batch.column(2).slice(block.first, block.n)
                of = np.repeat(np.arange(block.n), lists.value_lengths().fill_null(0).to_numpy())
                place = lists.flatten().to_numpy()
                here = place < n_cuts[of]  # an id may have several texts
                repeated = np.zeros(len(cut), bool)
                repeated[from_cut[of[here]] + place[here]] = True
                begin = np.flatnonzero(np.arange(len(words.start)) - first[words.doc] <= words.counts[words.doc] - min_words)
                begin = begin[possible(cut, repeated, words.start[begin], words.end[begin + min_words - 1])]
                long = np.flatnonzero(words.counts >= min_words)
                doc = np.concatenate([words.doc[begin], long])
                start = words.start[np.concatenate([begin, first[long]])]
                stop = words.end[np.concatenate([begin + min_words - 1, first[long] + words.counts[long] - 1])]
                n = len(begin)
                digest = span_hash(block.data, start[:n], stop[:n])
                before, inside = np.searchsorted(cut, start), np.searchsorted(cut, stop - 1)
                more = np.zeros(len(start), bool)
                more[:n] = again(doc[:n], digest, start[:n], stop[:n])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.append(digest.view(np.int64), np.zeros(len(long), np.int64)), mask=np.arange(len(start)) >= n),
                        pa.array(ids[block.first + doc].astype(np.int64)),
                        pa.array(np.append(begin - first[doc[:n]], words.counts[long]).astype(np.int32)),
                        pa.array((start - block.offsets[doc]).astype(np.int32)),
                        pa.array((stop - start).astype(np.int32)),
                        pa.array((before - from_cut[doc]).astype(np.int32)),
                        pa.array((inside - before).astype(np.int32)),
                        pa.array(more),
                    ],
                    ["digest", "doc", "at", "start", "size", "chunk", "more", "again"],
                )

    fields = "digest long, doc long, at int, start int, size int, chunk int, more int, again boolean"
    return rows.select("doc", "text", "places").mapInArrow(run, fields)


def again(doc: np.ndarray, digest: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Which windows begin at or after the end of the first like them in their text."""
    order = np.lexsort((start, digest, doc))
    new = np.ones(len(order), bool)
    new[1:] = (doc[order][1:] != doc[order][:-1]) | (digest[order][1:] != digest[order][:-1])
    ends = stop[order][new][np.cumsum(new) - 1]
    out = np.zeros(len(order), bool)
    out[order] = start[order] >= ends
    return out


def spans_of(found: DataFrame, min_words: int) -> DataFrame:
    """Spans (doc, start, end, n_words, n_chunks, first_doc_ids, windows) of repeated windows that overlap or touch.

    Rows that repeat (of rows repeating an id and text) count once.
    """
    place = Window.partitionBy("doc").orderBy("at")
    last = F.lag("at").over(place)
    runs = found.withColumns(
        {"new": (F.col("at") > F.coalesce(last, F.lit(-1 - min_words)) + min_words).cast("int"), "other": F.coalesce(F.col("at") != last, F.lit(True))}
    )
    return runs.withColumn("run", F.sum("new").over(place)).groupBy("doc", "run").agg(
        F.min("start").alias("start"),
        F.max(F.col("start") + F.col("size")).alias("end"),
        (F.max("at") - F.min("at") + min_words).cast("long").alias("n_words"),
        (F.max(F.col("chunk") + F.col("more")) - F.min("chunk") + 1).cast("long").alias("n_chunks"),
        F.sort_array(F.collect_set("keep_doc")).alias("first_doc_ids"),
        F.count_if("other").alias("windows"),
    )


def repeated_spans(
    docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Repeated passages: id, start, end (bytes of the text), n_words, n_chunks, first_doc_ids.

    Every run of ``min_words`` or more words, alike in every byte from its first
    word to its last, that occurs before. A passage stays in the document of
    smallest id that has it (in its first place there); every other occurrence
    is a row, ``n_chunks`` the content-defined chunks it touches. Texts wholly
    repeated are one row. Null and empty texts and texts of fewer words have
    none; rows with a null id are not looked at; rows with equal id and text are
    one document. Other columns are ignored, and an empty table gives no rows.

    Texts that are copies of another document's are rows by that document's
    windows; only one text of each kind is compared window by window. Digests
    are counted with partial aggregation and meet their rows by ``attach``, so
    no task gathers a common one.
    """
    tables = Scratch(docs.sparkSession)
    texts = _texts(docs, id_col, text_col)
    sha = F.unhex(F.sha2("text", 256)).alias("sha")

    ids = tables.write(texts.select("doc", sha).distinct(), "text-ids")
    firsts = tables.write(ids.groupBy("sha").agg(F.min("doc").alias("keep_doc"), F.count(F.lit(1)).alias("n")), "first-texts")
    copies = attach(ids, firsts.where("n > 1"), ["sha"], "n").where("doc != keep_doc").select("doc", "keep_doc")
    copies = tables.write(copies, "copies")

    found = tables.write(chunks(texts), "chunks")
    common = tables.write(found.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated-chunks")
    places = attach(found, common, ["digest"], "n").groupBy("doc").agg(F.collect_set("at").alias("places"))
    places = firsts.select(F.col("keep_doc").alias("doc"), "sha").join(places, "doc", "left")
    places = tables.write(places, "chunk-places")
    tables.drop("chunks", "repeated-chunks", "text-ids", "first-texts")

    rows = texts.select("doc", "text", sha).join(places, ["doc", "sha"])
    every = tables.write(windows(rows, min_words), "windows")
    tables.drop("chunk-places")
    seen = every.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc").alias("keep_doc"), F.count(F.lit(1)).alias("n"))
    found = attach(every, tables.write(seen.where("n > 1"), "repeated-windows"), ["digest"], "n")
    # A window that overlaps its own first place is part of what stays.
    found = found.where((F.col("doc") != F.col("keep_doc")) | F.col("again"))
    spans = tables.write(spans_of(found, min_words), "spans")

    # A copy is one span; its passages stay where those of the first text like it do.
    held = spans.groupBy("doc").agg(F.sum("windows").alias("gone"), F.array_distinct(F.flatten(F.collect_list("first_doc_ids"))).alias("ids"))
    whole = every.where("digest IS NULL").select("doc", "at", "start", "size", "more").distinct()
    whole = copies.groupBy(F.col("keep_doc").alias("doc")).agg(F.count(F.lit(1)).alias("n")).join(whole, "doc").join(held, "doc", "left")
    stays = F.when(F.coalesce("gone", F.lit(0)) < F.col("at") - min_words + 1, F.array("doc")).otherwise(F.array().cast("array<long>"))
    whole = whole.select(
        F.col("doc").alias("keep_doc"),
        "n",
        "start",
        (F.col("start") + F.col("size")).alias("end"),
        F.col("at").cast("long").alias("n_words"),
        (F.col("more") + 1).cast("long").alias("n_chunks"),
        F.sort_array(F.array_union(F.coalesce("ids", F.array().cast("array<long>")), stays)).alias("first_doc_ids"),
    )
    whole = attach(copies, tables.write(whole, "whole-texts"), ["keep_doc"], "n")
    tables.drop("windows", "repeated-windows")
    fields = [F.col("doc").alias(id_col), "start", "end", "n_words", "n_chunks", "first_doc_ids"]
    return spans.select(*fields).unionByName(whole.select(*fields))


def remove_repeats(
    docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The documents with their repeated passages cut out of the text, all columns kept.

    Spans are attached by id; a document without any keeps its text as it is.
    """
    spans = repeated_spans(docs, min_words, id_col, text_col)
    cut = spans.groupBy(F.col(id_col).alias("__sd_id")).agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__sd_spans")
    )
    rows = docs.join(staged(cut, "spans"), F.col(id_col) == F.col("__sd_id"), "left")

    @F.pandas_udf("string")
    def without(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(text, spans):
            if t is None or s is None:
                out.append(t)
                continue
            data, at, kept = t.encode(), 0, []
            for span in s:
                kept.append(data[at : span["start"]])
                at = span["end"]
            out.append((b"".join(kept) + data[at:]).decode(errors="ignore"))
        return pd.Series(out, dtype=object)

    return rows.withColumn(text_col, without(F.col(text_col), F.col("__sd_spans"))).select(*docs.columns)
