"""Best-fit packing of tokenised documents by minimum bin slack.

A sequence holds at most ``capacity`` tokens, so packing only depends on how
many pieces there are of each length: a histogram of at most ``capacity``
counts, whatever the corpus size. Minimum bin slack runs on that histogram:
each step takes the longest length left, finds by a bitset subset-sum over the
lengths available the combination that fills a sequence best, and removes it as
often as the counts allow (until then it would be found again). The steps say
which ranks of each length go to which sequence and offset; Spark numbers the
pieces of each length and places them.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartcast.llm.common import staged

CAPACITY = 2048
END_ID = 0  # closes each document
LONG_SPACE = 100_000

# Fixed value: the splitting pattern of byte-level BPE tokenizers of this family.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_SPACES = re.compile(r"\s+")

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, seq long"


class Encoder:
    """Token ids of a text as little-endian unsigned 32-bit bytes.

    A byte-level BPE whose merges come in the order of their ids is the same
    as merging by rank, which ``tiktoken`` does several times faster, so ids
    come from there. Texts with a special token's string, texts with a run of
    ``LONG_SPACE`` white-space characters (``tiktoken`` backtracks over them and
    panics at about a million), and tokenizers of another kind, go through
    ``tokenizers``.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.ranks = self._ranks(spec)

    @staticmethod
    def _ranks(spec: dict):
        """An encoder by rank, or None if the tokenizer is not one of that kind."""
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = (
            spec.get("normalizer") is None
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space")
            and model.get("type", "BPE") == "BPE"
            and not any(model.get(k) for k in ("dropout", "unk_token", "byte_fallback", "ignore_merges"))
            and not (model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"))
        )
        if not plain:
            return None
        import tiktoken

        vocab = model["vocab"]
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        letters = _byte_letters()
        own = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in own}
        single = [ranks.get(bytes([b])) for b in range(256)]
        if merged != sorted(merged) or None in single or len(merged) + 256 != len(ranks) or (merged and max(single) > merged[0]):
            return None
        return tiktoken.Encoding("by-rank", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if self.ranks is None or (self.special and self.special.search(text)) or long_space(text):
            return self.whole(text)
        return np.array(self.ranks.encode_ordinary(text), "<u4").tobytes()


def long_space(text: str) -> bool:
    """Whether ``text`` has ``LONG_SPACE`` white-space characters in a row."""
    if len(text) < LONG_SPACE:
        return False
    return any(m.end() - m.start() >= LONG_SPACE for m in _SPACES.finditer(text))


def _byte_letters() -> dict[str, int]:
    """The printable letter by which byte-level vocabularies write each byte."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut(n_ids: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all but the first are full."""
    first = n_ids - (-(-n_ids // capacity) - 1) * capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n_ids, capacity)]


def pieces(docs: DataFrame, tokenizer: str, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """Pieces of every document, numbered within (task, length); a written table."""
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "") + end
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    out.append((doc, k, start, length, crc, part, int(seen[length])))
                    seen[length] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            cols = [pa.array(c, t) for c, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in PIECES.split(", ")])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return staged(source.mapInArrow(run, PIECES), "pieces")


def fullest(room: int, counts: np.ndarray) -> list[tuple[int, int]]:
    """Lengths and how often, of largest sum within ``room``, by bitset subset-sum.

    Longer lengths are tried first, so among equally full combinations the
    short ones, which fill gaps easily, are left for later.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in range(min(room, len(counts) - 1), 0, -1):
        left = min(int(counts[length]), room // length)
        take = 1
        while left:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            take *= 2
        if reach >> room:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            chosen[length] = chosen.get(length, 0) + take
    return sorted(chosen.items(), reverse=True)


def minimum_bin_slack(counts: np.ndarray) -> tuple[np.ndarray, int]:
    """Slots (length, first rank, copies per sequence, offset, first sequence) and the number of sequences."""
    counts, used = counts.astype(np.int64).copy(), np.zeros(len(counts), np.int64)
    slots, sequences = [], 0
    while counts.any():
        longest = int(np.flatnonzero(counts)[-1])
        counts[longest] -= 1
        combination = dict(fullest(len(counts) - 1 - longest, counts))
        counts[longest] += 1
        combination[longest] = combination.get(longest, 0) + 1
        times = min(int(counts[length]) // k for length, k in combination.items())
        offset = 0
        for length, k in sorted(combination.items(), reverse=True):
            slots.append((length, used[length], k, offset, sequences))
            used[length] += k * times
            counts[length] -= k * times
            offset += length * k
        sequences += times
    return np.array(sorted(slots), np.int64).reshape(-1, 5), sequences


def best_fit_packing(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and a closing id; a null or empty text is the
    closing id alone. Rows with equal or null ids are packed each for itself.
    Other columns are ignored, and an empty table gives no rows. The driver
    only sees the histogram of lengths, at most ``capacity`` rows.
    """
    rows = pieces(docs, tokenizer, capacity, id_col, text_col)
    per_part = staged(rows.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    counts = np.zeros(capacity + 1, np.int64)
    for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r["length"]] = r["n"]
    slots, _ = minimum_bin_slack(counts)
    # At most one row per task before a length's pieces: a running sum over tasks.
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # One row per task and length: it grows with the tasks, so it is shuffled, not broadcast.
    ranked = rows.hint("merge").join(base, ["length", "part"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("seq")).alias("rank")
    )
    most = int(counts.max(initial=0)) + 1
    starts = slots[:, 0] * most + slots[:, 1]
    fields = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            slot = slots[np.searchsorted(starts, length * most + rank, "right") - 1]
            nth = rank - slot[:, 1]
            cols = [*batch.columns[:5], pa.array(slot[:, 4] + nth // slot[:, 2]), pa.array(slot[:, 3] + nth % slot[:, 2] * length)]
            yield pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in fields.split(", ")])

    return ranked.mapInArrow(place, fields)
