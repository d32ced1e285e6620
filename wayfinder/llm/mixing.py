"""Mixing sources to target weights, by a multivariate-hypergeometric splitting tree.

Every row has a place by a hash of its key columns; a source's rows fall into blocks by the hash's leading
bits, so many that a block holds about `WORDS_A_BLOCK` words at most. A source's target is met by whole
passes over its blocks, then by the first blocks of a seeded permutation, then by part of one more block, up
to a hash bound found by counting words in ever finer ranges of that block only: no row order, no sort, no
window over a source.

The block draws (block, pass) of all sources are exact quotas. They are split among the output shards by a
binary tree: at each node the left half's quotas are a multivariate hypergeometric draw from the node's,
so the sums stay exact. Each shard then takes its quota from the source's permuted draws, disjoint from all
others, and its rows are ordered by hash. The plan has a row a block drawn, so it stays small against the
rows (24 bytes for up to `WORDS_A_BLOCK` words), and the rows meet it in a join on (source, block), by
broadcast only up to `BROADCAST_DRAWS` rows. The driver holds the plan and a name, a size and a target of each source.
Columns of any names and types pass: rows travel as one value beside what the plan needs.

Defined results: a null text has size 0; a null source is a source of its own, the last; sources without
words have target 0 and are not taken; rows that are equal in all key columns go together; an empty table
gives no rows; reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_hash, stored

#: A source has 2^BLOCK_BITS blocks, more where they would hold over WORDS_A_BLOCK words, fewer below LEAST_WORDS each.
BLOCK_BITS = 8
WORDS_A_BLOCK, LEAST_WORDS = 1 << 24, 1 << 10
#: The words of an output shard decide how many there are, LEAST_SHARDS at least.
WORDS_A_SHARD = 1 << 26
LEAST_SHARDS = 64
FINE_BITS = 12
HASH_BITS = 56
WEIGHTS = (5, 2, 1)
#: A table of so many sources at most goes out by broadcast; a longer one is joined.
BROADCAST_SOURCES = 100_000
#: A plan of at most so many draws, of 24 bytes each, goes out by broadcast; a longer one meets the rows in a shuffle.
BROADCAST_DRAWS = 200_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: list[tuple[str | None, int]], weights: Iterable[int] = WEIGHTS, share: Fraction = Fraction(3, 2), most: int = 2) -> dict[str | None, Fraction]:
    """The words to take of each source: `share` of all words by weight, no source above `most` times its size, the excess shared anew."""
    weights = list(weights)
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size, out = dict(order), {}
    left, active = share * sum(size.values()), list(size)
    while active:
        each = Fraction(left, sum(weight[s] for s in active))
        over = [s for s in active if weight[s] * each > most * size[s]]
        if not over:
            out.update((s, weight[s] * each) for s in active)
            break
        for s in over:
            out[s] = Fraction(most * size[s])
            left -= out[s]
        active = [s for s in active if s not in set(over)]
    return out


def split_quotas(quotas: np.ndarray, shards: int, rng: np.random.Generator, first: int = 0, of: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, sources, quotas) of each shard, only sources with a quota; every shard's total is its even share."""
    of = np.arange(len(quotas)) if of is None else of
    of, quotas = of[quotas > 0], quotas[quotas > 0]
    if shards == 1 or not len(of):
        if len(of):
            yield first, of, quotas
        return
    left = shards // 2
    take = int(quotas.sum()) * left // shards
    # the draws of a plan are far fewer than the 10^9 that this method allows
    mine = rng.multivariate_hypergeometric(quotas, take, method="marginals") if take else np.zeros_like(quotas)
    yield from split_quotas(mine, left, rng, first, of)
    yield from split_quotas(quotas - mine, shards - left, rng, first + left, of)


@dataclass
class Source:
    name: str | None
    size: int
    target: Fraction
    bits: int  # of the hash that tell the source's blocks


@dataclass
class Plan:
    sources: list[Source]
    draws: pa.Table  # __k (place in sources), __block, __bound (rows with a hash below it), __shard
    shards: int

    def draws_for(self, spark: SparkSession) -> DataFrame:
        draws = spark.createDataFrame(self.draws, "__k int, __block int, __bound long, __shard int")
        return F.broadcast(draws) if self.draws.num_rows <= BROADCAST_DRAWS else draws


def placed(docs: DataFrame, keys: list[str], row: Column, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """`row` of every row with __source, __size, and its place: __h, of HASH_BITS bits."""
    h = F.shiftrightunsigned(row_hash(docs, keys, 0), 64 - HASH_BITS)
    return docs.select(row, F.col(source_col).cast("string").alias("__source"), n_words(F.col(text_col)).alias("__size"), h.alias("__h"))


def blocked(rows: DataFrame, sources: list[Source]) -> DataFrame:
    """The placed rows with __k and __block."""
    # a null name has a mark of its own, as a join on plain equality can be spread where the table of sources is long
    known = rows.sparkSession.createDataFrame([(s.name or "", s.name is None, k, s.bits) for k, s in enumerate(sources)], "__name string, __none boolean, __k int, __bits int")
    block = F.expr(f"cast(shiftrightunsigned(__h, {HASH_BITS} - __bits) as int)")
    same = (F.coalesce(F.col("__source"), F.lit("")) == F.col("__name")) & (F.col("__source").isNull() == F.col("__none"))
    return rows.join(F.broadcast(known) if len(sources) <= BROADCAST_SOURCES else known, same).withColumn("__block", block).drop("__name", "__none", "__bits")


def block_bits(size: int) -> int:
    """How many bits of the hash tell a source's blocks."""
    enough = (-(-size // WORDS_A_BLOCK) - 1).bit_length() if size else 0
    return max(enough, min(BLOCK_BITS, (size // LEAST_WORDS).bit_length()))


def sources_of(rows: DataFrame) -> list[Source]:
    got = [(r["__source"], r.n) for r in rows.groupBy("__source").agg(F.sum("__size").alias("n")).toLocalIterator()]
    target = source_targets(got)
    got.sort(key=lambda s: (s[0] is None, s[0] or ""))
    return [Source(name, n, target[name], block_bits(n)) for name, n in got]


def plan(rows: DataFrame, shards: int | None = None, seed: int = 17) -> Plan:
    """From rows with __source, __size, __h: what is drawn, and into which shard."""
    sources = sources_of(rows)
    shards = shards or max(LEAST_SHARDS, -(-int(sum(s.target for s in sources)) // WORDS_A_SHARD))
    words = [np.zeros(1 << s.bits, np.int64) for s in sources]
    numbered = blocked(rows, sources)
    # at most 2^BLOCK_BITS rows a source, one for every LEAST_WORDS / 2 words, and two for every WORDS_A_BLOCK
    for r in numbered.groupBy("__k", "__block").agg(F.sum("__size").alias("n")).toLocalIterator():
        words[r["__k"]][r["__block"]] = r.n
    whole = 1 << HASH_BITS
    draws: list[list[tuple[int, int]]] = []
    part: dict[int, tuple[int, Fraction]] = {}
    for k, s in enumerate(sources):
        rng = np.random.default_rng([seed, k])
        passes, rest = divmod(s.target, s.size) if s.size else (0, Fraction(0))
        full = np.flatnonzero(words[k])
        draws.append([(int(b), whole) for _ in range(int(passes)) for b in rng.permutation(full)])
        for b in rng.permutation(full) if rest else []:
            if words[k][b] > rest:
                part[k] = (int(b), rest)
                break
            draws[k].append((int(b), whole))
            rest -= int(words[k][b])
    start = {k: b << (HASH_BITS - sources[k].bits) for k, (b, _) in part.items()}
    for k, bound in bounds(numbered, part, [s.bits for s in sources]).items():
        if bound > start[k]:
            draws[k].append((part[k][0], bound))
    order = [np.random.default_rng([seed, k, 1]).permutation(len(d)) for k, d in enumerate(draws)]
    used, out = [0] * len(sources), []
    for shard, of, quotas in split_quotas(np.array([len(d) for d in draws], np.int64), shards, np.random.default_rng([seed, 1 << 20])):
        for k, q in zip(of.tolist(), quotas.tolist()):
            out += [(k, *draws[k][i], shard) for i in order[k][used[k] : used[k] + q]]
            used[k] += q
    types = (pa.int32(), pa.int32(), pa.int64(), pa.int32())
    table = pa.table({n: pa.array([x[i] for x in out], t) for i, (n, t) in enumerate(zip(("__k", "__block", "__bound", "__shard"), types))})
    return Plan(sources, table, shards)


def bounds(rows: DataFrame, part: dict[int, tuple[int, Fraction]], bits: list[int]) -> dict[int, int]:
    """For each source, the hash below which its part-taken block holds nearest to the words wanted, in counts by ever finer ranges."""
    spark = rows.sparkSession
    left = {k: HASH_BITS - bits[k] for k in part}  # bits of the range that still holds the bound
    low = {k: b << left[k] for k, (b, _) in part.items()}
    rest = {k: w for k, (_, w) in part.items()}
    while open_ := [k for k in part if left[k] > 0]:
        step = {k: max(0, left[k] - FINE_BITS) for k in open_}
        at = spark.createDataFrame([(k, low[k], low[k] + (1 << left[k]), step[k]) for k in open_], "k int, low long, high long, step int")
        # at most one row a source
        inside = rows.join(F.broadcast(at), (F.col("__k") == F.col("k")) & (F.col("__h") >= F.col("low")) & (F.col("__h") < F.col("high")))
        counts: dict[int, list[tuple[int, int]]] = {k: [] for k in open_}
        for r in inside.groupBy("k", F.expr("shiftrightunsigned(__h - low, step)").alias("f")).agg(F.sum("__size").alias("n")).toLocalIterator():
            counts[r.k].append((r.f, r.n))
        for k in open_:
            for f, n in sorted(counts[k]):
                if n > rest[k]:
                    low[k] += f << step[k]
                    # at the last bits a range is rows of one hash: take it if that comes nearer
                    if not step[k] and 2 * rest[k] >= n:
                        low[k] += 1
                    break
                rest[k] -= n
            else:
                low[k] += 1 << left[k]
            left[k] = step[k]
    return low


def mix(docs: DataFrame, keys: list[str] | None = None, shards: int | None = None, seed: int = 17, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mixed rows, with their columns, as often as the mix takes them: a partition a shard, shuffled by hash inside."""
    keys = keys or [c for c in docs.columns if c != source_col]
    rows = placed(docs, keys, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), source_col, text_col)
    planned = plan(stored(rows.select("__source", "__size", "__h"), "places"), shards, seed)
    r, d = blocked(rows, planned.sources), planned.draws_for(docs.sparkSession)
    taken = r.join(d, (r["__k"] == d["__k"]) & (r["__block"] == d["__block"]) & (r["__h"] < d["__bound"])).select("row", "__h", "__shard")
    return taken.repartitionById(planned.shards, F.col("__shard")).sortWithinPartitions(F.xxhash64("__h", "__shard")).select("row.*")


def summary(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", keys: list[str] | None = None, shards: int | None = None, seed: int = 17) -> DataFrame:
    """What the mix takes of each row: doc_id, size, source_size, target, taken."""
    spark = docs.sparkSession
    keys = keys or [c for c in docs.columns if c != source_col]
    rows = stored(placed(docs, keys, F.col(id_col).alias("doc_id"), source_col, text_col), "places")
    planned = plan(rows, shards, seed)
    totals = spark.createDataFrame([(k, s.size, float(s.target)) for k, s in enumerate(planned.sources)], "__k int, source_size long, target double")
    # what is drawn of a block: whole passes, and rows below a bound
    bounds_of = planned.draws_for(spark).groupBy("__k", "__block").agg(F.collect_list("__bound").alias("bounds"))
    small = planned.draws.num_rows <= BROADCAST_DRAWS
    few = len(planned.sources) <= BROADCAST_SOURCES
    r = blocked(rows, planned.sources).join(F.broadcast(totals) if few else totals, "__k").join(F.broadcast(bounds_of) if small else bounds_of, ["__k", "__block"], "left")
    times = F.when(F.col("bounds").isNull(), F.lit(0)).otherwise(F.size(F.filter("bounds", lambda b: b > F.col("__h"))))
    return r.select("doc_id", F.col("__size").alias("size"), "source_size", "target", (F.col("__size") * times).cast("long").alias("taken"))
