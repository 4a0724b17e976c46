"""Filter interaction audit by the Hart-Mas-Colell potential.

Five filters are the players of the *removal game*: a coalition S is worth the
documents that S removes, those failing at least one of its filters. All that
the game needs of a part of the corpus is how many documents fail exactly each
set of filters: 32 counts, so documents are aggregated to them before anything
else is done, and one row per part is left.

The potential of a coalition is ``P(S) = (v(S) + sum of P(S - i)) / |S|``,
computed from small coalitions to large ones, and a filter's Shapley value is
``P(all) - P(all - i)``. Potentials are kept as 120 times their value, which
makes every division exact: P(S) sums the dividends of the subsets T of S, each
divided by |T|, and 120 is a multiple of 1 to 5. 120 times the Shapley value is
what the filter removes summed over all 120 orders. What a filter removes at a
step of one order is the difference between two coalitions: those before it
with and without it.

Filters (a document fails if): A has under 200 words; B fewer than half of its
words are distinct; C more than 3 % of its code points are A-Z; D it holds any
of ``#$%&*|``; E its text equals that of a row of smaller doc_id anywhere in the
table. Words are maximal runs of other than ASCII white space.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartcast.llm.common import let, word_array

FILTERS = "ABCDE"
N = len(FILTERS)
ALL = (1 << N) - 1
ORDERS = factorial(N)
NULL_SPLIT = 1 << 10  # rows of null id would share one key

_PART, _DIGEST, _MASK = "__fa_part", "__fa_digest", "__fa_mask"


def text_mask(text: Column) -> Column:
    """Bits 0 to 3: whether a text (not null) fails A, B, C, D."""

    def bits(w: Column) -> Column:
        a = F.size(w) < 200
        b = 100 * F.size(F.array_distinct(w)).cast("long") < 50 * F.size(w).cast("long")
        return a.cast("int") + b.cast("int") * 2

    ab = let(word_array(text), bits)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    c = 100 * capitals.cast("long") > 3 * F.length(text).cast("long")
    d = text.rlike(r"[#$%&*|]")
    return ab + c.cast("int") * 4 + d.cast("int") * 8


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part and set of failed filters (``mask``, bit k for filter k): n, good, toxic.

    Equal texts are found by SHA-256. Rows are first counted per text, part and
    labels, with the least id and how many rows hold it, so a group of copies
    is a few rows before the least id of the whole group is looked up.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias(_PART),
        F.unhex(F.sha2(text, 256)).alias(_DIGEST),
        text_mask(text).alias(_MASK),
    )
    judged = labels.groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"),
        F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic"),
    )
    # Rows of null id meet no label; they are spread by their text.
    spread = F.when(F.col("id").isNull(), 1 + F.pmod(F.xxhash64(_DIGEST), F.lit(NULL_SPLIT))).otherwise(0)
    judged = judged.where("label_id IS NOT NULL").withColumn("label_spread", F.lit(0).cast("long"))
    key = F.coalesce(F.col("id"), F.lit(0)) == F.col("label_id")
    rows = rows.withColumn("spread", spread.cast("long"))
    rows = rows.join(judged, key & (F.col("spread") == F.col("label_spread")), "left").na.fill(0, ["good", "toxic"])
    # The least id of a group of copies may repeat; rows holding it do not fail E.
    per_id = rows.groupBy(_DIGEST, _PART, _MASK, "good", "toxic", "id").agg(F.count(F.lit(1)).alias("n"))
    copies = per_id.groupBy(_DIGEST, _PART, _MASK, "good", "toxic").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "n")).alias("least"),
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("no_id"),
    )
    first = F.min(F.col("least.id")).over(Window.partitionBy(_DIGEST))
    copies = copies.withColumn("stays", F.when(F.col("least.id") == first, F.col("least.n")).otherwise(0) + F.col("no_id"))
    both = F.explode(
        F.array(
            F.struct(F.col(_MASK).alias("mask"), F.col("stays").alias("n")),
            F.struct((F.col(_MASK) + 16).alias("mask"), (F.col("n") - F.col("stays")).alias("n")),
        )
    )
    failed = copies.select(_PART, "good", "toxic", both.alias("f")).where("f.n > 0")
    return failed.groupBy(F.col(_PART).alias("part"), F.col("f.mask").alias("mask")).agg(
        F.sum("f.n").alias("n"),
        F.sum(F.when(F.col("good") == 1, F.col("f.n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic") == 1, F.col("f.n")).otherwise(0)).alias("toxic"),
    )


def coalition_values(counts: DataFrame, columns: tuple[str, ...] = ("n", "good", "toxic")) -> DataFrame:
    """One row per part: ``total`` and, for each column, an array of what each coalition removes of it."""
    removed = [
        F.array(*[F.sum(F.when(F.col("mask").bitwiseAND(F.lit(s)) != 0, F.col(c)).otherwise(0)) for s in range(ALL + 1)]).alias(c)
        for c in columns
    ]
    return counts.groupBy("part").agg(F.sum("n").alias("total"), *removed)


def with_shapley(values: DataFrame) -> DataFrame:
    """Add ``potential`` (of each coalition, times ORDERS) and ``shapley`` (of each filter, times ORDERS).

    The recursion is one step per coalition size: the potentials known so far
    are an array indexed by coalition, extended by those of the next size.
    """
    by_size = [[s for s in range(ALL + 1) if s.bit_count() == k] for k in range(N + 1)]
    out = values.withColumn("potential", F.array_repeat(F.lit(0).cast("long"), ALL + 1))
    for size in range(1, N + 1):
        new = []
        for s in range(ALL + 1):
            if s not in by_size[size]:
                new.append(F.col("potential")[s])
                continue
            below = [F.col("potential")[s & ~(1 << i)] for i in range(N) if s >> i & 1]
            new.append(F.expr(f"n[{s}] * {ORDERS}L") + sum(below[1:], below[0]))
            new[-1] = F.call_function("div", new[-1], F.lit(size))
        out = out.withColumn("potential", F.array(*new))
    own = [F.col("potential")[ALL] - F.col("potential")[ALL & ~(1 << i)] for i in range(N)]
    return out.withColumn("shapley", F.array(*own))


def steps(audit: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, zeros included."""
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    rows = audit.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(N))))
    player = F.instr(F.lit(FILTERS), F.substr("filter_order", "step", F.lit(1))) - 1
    before = F.lit(0)
    for i, name in enumerate(FILTERS):
        before = before + F.when(F.instr(F.col("filter_order"), name) < F.col("step"), F.lit(1 << i)).otherwise(0)
    rows = rows.withColumns({"player": player, "before": before})
    rows = rows.withColumn("bit", F.expr("shiftleft(1, player)"))
    rows = rows.withColumn("after", F.expr("before + bit"))
    return rows.selectExpr(
        "part",
        "filter_order",
        "step",
        "total - n[after] AS kept",
        "n[after] - n[before] AS removed",
        "n[bit] - (n[after] - n[before]) AS redundant",
        f"n[{ALL}] - n[{ALL} - bit] AS unique_fails",
        "good[after] - good[before] AS good_lost",
        "toxic[after] - toxic[before] AS toxic_lost",
        "shapley[player] AS shapley",
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter removes, per part (language), order of the filters and step.

    Null texts count as empty, null languages as the part of the empty string.
    A row of null id never fails E and is no smaller id of any other; rows that
    repeat the least id of their text all stay. A document is good (toxic) if
    any row of ``labels`` with its id says so; labels without a document and
    labels of null id count nowhere. An empty table gives no rows; columns of
    other names are ignored.
    """
    return steps(with_shapley(coalition_values(failure_counts(docs, labels))))
