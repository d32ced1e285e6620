"""Token counts: an exact histogram of encoded lengths, and suffix sums over it.

Every whole text is encoded and only its length kept; documents are counted by length (partial sums
before the shuffle), and suffix sums over the histogram answer, for every context limit: how many
documents and tokens reach it, the total when longer documents are cut to it, and which share of the
documents fits. The sums run in two levels, inside ranges of `RANGE` lengths and over the ranges, so no
task holds more than the ranges.

Defined results: null and empty texts have the length of an empty text (the end id, if one is added);
an empty table gives no rows; repeated rows count each.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches

RANGE = 1024


def lengths(docs: DataFrame, encoder: Callable[[], object], add_end: bool = True, text_col: str = "text") -> DataFrame:
    """n_tokens of every row; encoder() makes, in each worker, something with count(text)."""

    def run(batches):
        codec = encoder()
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([codec.count(t or "") + add_end for t in b.column(0).to_pylist()], pa.int64())], ["n_tokens"])

    return map_batches(docs.select(F.col(text_col).alias("text")), run, "n_tokens long")


def histogram(counted: DataFrame) -> DataFrame:
    return counted.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For every length that occurs, as a limit: docs and tokens at or over it, docs up to it and their share, and the total of lengths cut to it."""
    h = hist.withColumn("range", F.floor(F.col("n_tokens") / RANGE)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    ranges = h.groupBy("range").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    over = Window.orderBy(F.col("range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    after = ranges.select("range", F.coalesce(F.sum("d").over(over), zero).alias("docs_after"), F.coalesce(F.sum("t").over(over), zero).alias("tokens_after"))
    total = ranges.agg(F.sum("d").alias("all_docs"), F.sum("t").alias("all_tokens"))
    inside = Window.partitionBy("range").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at_least = h.join(after, "range").select(
        "n_tokens", "n_docs", (F.sum("n_docs").over(inside) + F.col("docs_after")).alias("docs_at_least"), (F.sum("tokens").over(inside) + F.col("tokens_after")).alias("tokens_at_least"),
    )
    # total is one row
    s = at_least.join(F.broadcast(total))
    below = F.col("all_tokens") - F.col("tokens_at_least")
    return s.select(
        "n_tokens", "n_docs", "docs_at_least", "tokens_at_least", (F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")).alias("docs_up_to"),
        ((F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("all_docs")).alias("share_up_to"),
        (below + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_total"),
    )


def quantile(sums: DataFrame, share: float) -> int | None:
    """The least length that at least this share of the documents does not exceed."""
    return sums.where(F.col("share_up_to") >= share).agg(F.min("n_tokens")).first()[0]


def truncated_total(sums: DataFrame, limit: int) -> int:
    """Tokens that are left when every document is cut to `limit`, for any limit."""
    up, row = sums.where(F.col("n_tokens") >= limit).orderBy("n_tokens").first(), sums.orderBy(F.col("n_tokens").desc()).first()
    if row is None:
        return 0
    if up is None:
        return row.truncated_total
    # between two lengths the total is linear in the limit
    return up.truncated_total - (up.n_tokens - limit) * up.docs_at_least
