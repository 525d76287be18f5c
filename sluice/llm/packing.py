"""Optimal length buckets and token-budget batches.

Every sequence of a bucket is padded to the bucket's boundary. The boundaries that pad least are found by dynamic programming
over the histogram of all lengths: with the lengths in order, the last bucket of the best split of the first j lengths into
k buckets starts nowhere before that of the first j - 1, so each layer is solved by divide and conquer. Inside a bucket
sequences are batched so that boundary * batch size stays within the token budget.

Lengths are in whatever unit n_tokens has. report() counts words between white space, not ids of a tokenizer, so its
histogram, boundaries and budget are all in words.

Scale. The histogram is a partial aggregation with one row a distinct length; only it comes to the driver (d distinct lengths
take d * d / 2 tokens of input at least). A sequence's batch follows from its rank in its bucket: sequences are dealt to
groups by a hash of doc_id and of the row's own place, so rows that share a doc_id (or have none) don't meet in one group,
the groups' sizes are summed up in order, and a window ranks the sequences inside each group, so
no bucket is sorted in one task, and a bucket has one batch at most that isn't full.
"""

from __future__ import annotations

import bisect

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import written

BUCKETS = 16
#: In the unit of n_tokens: words in report().
TOKEN_BUDGET = 65_536
#: Sequences in a group that a window sorts, about.
GROUP = 20_000


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """The upper bounds, ascending, of at most ``buckets`` buckets that need the least padding.

    ``lengths`` ascend without repeats. With no more lengths than buckets each length has its own.
    """
    n = len(lengths)
    if n <= buckets:
        return [int(x) for x in lengths]
    rows = np.concatenate(([0], np.cumsum(counts, dtype=np.float64)))
    tokens = np.concatenate(([0], np.cumsum(counts * lengths, dtype=np.float64)))
    top = np.concatenate(([0], lengths)).astype(np.float64)

    def cost(i, j):
        """Padding of lengths i to j - 1 at the boundary lengths[j - 1]."""
        return top[j] * (rows[j] - rows[i]) - (tokens[j] - tokens[i])

    best = cost(0, np.arange(n + 1))
    best[0] = 0
    choices = []
    for _ in range(buckets - 1):
        layer, choice = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        layer[0] = 0
        todo = [(1, n, 0, n - 1)]
        while todo:
            low, high, first, last = todo.pop()
            j = (low + high) // 2
            i = np.arange(first, min(last, j - 1) + 1)
            value = best[i] + cost(i, j)
            k = int(value.argmin())
            layer[j], choice[j] = value[k], i[k]
            if low < j:
                todo.append((low, j - 1, first, int(i[k])))
            if j < high:
                todo.append((j + 1, high, int(i[k]), last))
        best = layer
        choices.append(choice)
    bounds, j = [], n
    for choice in reversed(choices):
        bounds.append(int(lengths[j - 1]))
        j = int(choice[j])
        if j == 0:
            break
    else:
        bounds.append(int(lengths[j - 1]))
    return bounds[::-1]


def padding(lengths: np.ndarray, counts: np.ndarray, bounds: list[int]) -> int:
    return int(sum((bounds[bisect.bisect_left(bounds, x)] - x) * c for x, c in zip(lengths.tolist(), counts.tolist(), strict=True)))


def words(text: Column) -> Column:
    """Length of a text in words between ASCII white space, counted as places where a word begins."""
    flat = F.translate(F.concat(F.lit(" "), F.coalesce(text, F.lit(""))), "\t\n\x0b\x0c\r", "     ")
    return F.regexp_count(flat, F.lit(" [^ ]")).cast("long")


def pack(rows: DataFrame, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET) -> DataFrame:
    """``rows`` (doc_id, n_tokens; other columns are ignored) and, for every row, its bucket, the bucket's boundary, its batch
    in the bucket and its place in the batch, all counted from 0.

    A length that is null counts as 0, and empty sequences are packed like any other (bucket boundary 0 at the least; such a
    batch holds ``token_budget`` rows). A sequence longer than the budget is a batch of its own. Repeated rows are ranked
    apart. No rows give no rows.
    """
    # The place is drawn once, when the table is written.
    own = F.xxhash64(F.col("doc_id"), F.col("n_tokens"), F.monotonically_increasing_id())
    sized = written(rows.select("doc_id", F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long").alias("n_tokens"), own.alias("own")), "lengths")
    histogram = sized.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).orderBy("n_tokens").collect()
    lengths, counts = np.array([x.n_tokens for x in histogram], np.int64), np.array([x.n for x in histogram], np.int64)
    bounds = boundaries(lengths, counts, buckets)
    total = int(counts.sum())
    table = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<bigint>")
    bucket = F.lit(0)
    for b in bounds[:-1]:
        bucket = bucket + (F.col("n_tokens") > b).cast("int")
    groups = max(1, -(-total // GROUP))
    dealt = sized.withColumn("bucket", bucket).withColumn("group", F.pmod("own", F.lit(groups)).cast("int"))
    # One row for each bucket and group: far fewer than sequences, and summed up by ranges of their own bucket.
    before = Window.partitionBy("bucket").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("bucket", "group").agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select("bucket", "group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("bucket", "group").orderBy("doc_id", "n_tokens", "own")
    ranked = dealt.withColumn("rank", F.row_number().over(within) - 1).join(offsets, ["bucket", "group"])
    bound = F.get(table, F.col("bucket"))
    size = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.greatest(F.lit(1), F.col("boundary")))).cast("long")
    placed = ranked.withColumn("boundary", bound).withColumn("size", size).withColumn("rank", F.col("rank") + F.col("before"))
    return placed.select("doc_id", "n_tokens", "bucket", "boundary", F.floor(F.col("rank") / F.col("size")).alias("batch"), (F.col("rank") % F.col("size")).alias("place"))


def report(docs: DataFrame, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET) -> DataFrame:
    """pack() of ``docs`` (doc_id, text) by words: n_tokens, boundary and ``token_budget`` are all numbers of words."""
    return pack(docs.select("doc_id", words(F.col("text")).alias("n_tokens")), buckets, token_budget)
