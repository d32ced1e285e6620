"""SimHash near-duplicates: tiled exact comparison of fingerprints.

A fingerprint has a bit set where over half of the text's shingle hashes (XXH64, repeats included) have
it. Comparison is exact and all-against-all over the distinct fingerprints, by tiles: numpy exclusive-or
and bit counts, tile pairs skipped where population counts differ by more than the radius. Fingerprints
are ordered by their whole population count and the counts of their four quarters (at most 17^4 cells,
whatever the input), runs of cells form groups, large groups are dealt into chunks by hash; every two
fingerprints within the radius differ by at most the radius in the sum over the quarters, so group pairs
whose boxes are further apart than that are skipped.

A tile pair emits a spanning forest of its links, not the links, so a large group of near copies costs
no more rows than it has members. Components of the whole are found by alternating large-star and
small-star steps over those edges; every round is written to the shared folder.

Defined results: texts without words (null, empty) have the fingerprint zero and are linked like any
other; fewer words than a shingle make one shingle; repeated rows and equal ids share a component; the
component id is the smallest id reachable, null only where no member has an id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fields_of, forget, map_batches, row_hash, stored, texts_of, unused, with_text

CHUNK = 1 << 20
#: Groups of cells; so at most the square of it pairs of groups, a row each, go out by broadcast (some 20 MB).
MOST_GROUPS = 1024
#: Fingerprints of a tile: more where there are more fingerprints, so that tiles travel to fewer partners.
TILE, LARGEST_TILE = 4096, 32768
#: About the comparisons that one task makes, and the most tasks.
TASK_PAIRS, MOST_TASKS = 1 << 28, 20_000
#: So many row keys of 16 bytes at most go out by broadcast.
BROADCAST_KEYS = 1 << 20
#: A fingerprint that a larger share of the rows has meets them by broadcast: fewer than 1 / HOT_SHARE have.
HOT_SHARE = 1 / 1024
_LANES = np.uint64(0x0101010101010101)


class BitCounter:
    """How often each of 64 bits is set in a stream of hashes."""

    def __init__(self):
        self.n, self.ones = 0, np.zeros((8, 8), np.int64)  # [shift, byte]

    def add(self, hashes: np.ndarray) -> None:
        self.n += len(hashes)
        # eight one-bit lanes a word; a lane cannot overflow within 255 hashes
        for at in range(0, len(hashes), 255 * 64):
            part = hashes[at : at + 255 * 64]
            blocks = np.arange(0, len(part), 255)
            for shift in range(8):
                sums = np.add.reduceat((part >> np.uint64(shift)) & _LANES, blocks)
                self.ones[shift] += sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)

    def fingerprint(self) -> int:
        out = 0
        for shift in range(8):
            for byte in range(8):
                if 2 * self.ones[shift, byte] > self.n:
                    out |= 1 << (8 * byte + shift)
        return out


def _word_chunks(data: bytes) -> Iterator[list[bytes]]:
    at = 0
    while at < len(data):
        to = at + CHUNK
        while to < len(data) and data[to] not in b" \t\n\x0b\x0c\r":
            to += 1
        yield data[at:to].split()
        at = to


def fingerprint(data: bytes, width: int = 3, seed: int = 42) -> int:
    digest = xxhash.xxh64_intdigest
    bits, tail, shingles = BitCounter(), [], 0
    for words in _word_chunks(data.lower()):
        words = tail + words
        if len(words) >= width:
            made = map(b" ".join, zip(*(words[i:] for i in range(width))))
            hashes = np.fromiter((digest(s, seed) for s in made), np.uint64, len(words) - width + 1)
            bits.add(hashes)
            shingles += len(hashes)
            words = words[len(words) - width + 1 :]
        tail = words
    if not shingles and tail:
        bits.add(np.array([digest(b" ".join(tail), seed)], np.uint64))
    return bits.fingerprint()


def fingerprints(docs: DataFrame, cols: list[Column], width: int = 3, text_col: str = "text") -> DataFrame:
    """The given columns and fp (the 64 bits as a long) of every row; one map over the scan."""
    fields = fields_of(docs, cols)

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, width) for t in texts_of(b)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp)], [*b.schema.names[:-1], "fp"])

    return map_batches(with_text(docs, cols, text_col), run, f"{fields}, fp long")


def _quarters() -> list[Column]:
    return [F.bit_count(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))).cast("int") for i in range(4)]


def plan_tiles(cells: np.ndarray, counts: np.ndarray, tile: int, most_groups: int = MOST_GROUPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group of each cell (rows of quarter counts), chunks of each group, and all pairs of groups (a <= b) that may hold links."""
    order = np.lexsort((*cells.T[::-1], cells.sum(axis=1)))
    size = max(tile, -(-int(counts.sum()) // most_groups))
    group = np.zeros(len(cells), np.int64)
    at, filled = 0, 0
    for i in order:
        if filled and filled + counts[i] > size:
            at, filled = at + 1, 0
        group[i] = at
        filled += counts[i]
    n = at + 1 if len(cells) else 0
    total = np.bincount(group, weights=counts, minlength=n).astype(np.int64)
    chunks = np.maximum(1, -(-total // tile))
    stats = np.column_stack([cells, cells.sum(axis=1)])
    low, high = np.full((n, 5), 99), np.full((n, 5), -1)
    np.minimum.at(low, group, stats)
    np.maximum.at(high, group, stats)
    return group, chunks, np.column_stack([low, high])


def near_groups(boxes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of groups (a <= b) whose boxes allow a distance within the radius."""
    low, high = boxes[:, :5], boxes[:, 5:]
    first, second = [], []
    for a in range(len(boxes)):
        gap = np.maximum(0, np.maximum(low[a] - high[a:], low[a:] - high[a]))
        b = a + np.flatnonzero((gap[:, :4].sum(axis=1) <= radius) & (gap[:, 4] <= radius))
        first.append(np.full(len(b), a))
        second.append(b)
    return np.concatenate(first), np.concatenate(second)


def _forest(x: np.ndarray, y: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Each linked fingerprint with the smallest one of its component among x and y."""
    both = x if y is None else np.concatenate([x, y])
    other, base = (x, 0) if y is None else (y, len(x))
    label = np.arange(len(both))
    linked = np.zeros(len(both), bool)

    def root(of: np.ndarray) -> np.ndarray:
        while (up := label[of]).tolist() != of.tolist():
            label[of] = label[up]
            of = label[of]
        return of

    # both sides are in order of their population counts: a run of x meets only the run of y that these allow
    low, high = (np.searchsorted(np.bitwise_count(other), np.bitwise_count(x).astype(np.int16) + d, side) for d, side in ((-radius, "left"), (radius, "right")))
    for at in range(0, len(x), 256):
        start, end = int(low[at : at + 256].min()), int(high[at : at + 256].max())
        near = np.bitwise_count(x[at : at + 256, None] ^ other[None, start:end]) <= radius
        i, j = np.nonzero(near)
        i, j = i + at, j + base + start
        keep = i < j if y is None else slice(None)
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        linked[i] = linked[j] = True
        while len(i):
            a, b = root(i), root(j)
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
    at = np.flatnonzero(linked)
    top = root(at)
    least = both.copy()
    np.minimum.at(least, top, both[at])
    mine, to = both[at], least[top]
    return mine[mine != to], to[mine != to]


def _compare(radius: int):
    def run(table: pa.Table) -> pa.Table:
        tiles, side = table.column("tile").to_pylist(), table.column("side").to_pylist()
        x, y = (np.array([fp for t, s in zip(tiles, side) if s == k for fp in t], np.int64).view(np.uint64) for k in (0, 1))
        # the order does not depend on how the tiles arrived
        x, y = (v[np.lexsort((v, np.bitwise_count(v)))] for v in (x, y))
        a, b = _forest(x, y if len(y) else None, radius) if len(x) else (x, x)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return run


def links(distinct: DataFrame, radius: int = 3, tile: int | None = None) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) whose components are those of all links within the radius."""
    spark = distinct.sparkSession
    f = distinct.select("fp", *[q.alias(f"q{i}") for i, q in enumerate(_quarters())])
    # at most 17^4 rows
    got = f.groupBy("q0", "q1", "q2", "q3").agg(F.count("*").alias("n")).orderBy("q0", "q1", "q2", "q3").collect()
    if not got:
        return spark.createDataFrame([], "a long, b long")
    cells, counts = np.array([[r.q0, r.q1, r.q2, r.q3] for r in got]), np.array([r.n for r in got])
    tile = tile or int(np.clip(counts.sum() // 64, TILE, LARGEST_TILE))
    group, chunks, boxes = plan_tiles(cells, counts, tile)
    a, b = near_groups(boxes, radius)
    apart = a != b
    # a row for each group and partner: MOST_GROUPS^2 at most, but where one cell is a group of its own
    sides = pa.table({
        "g": np.concatenate([a, b[apart]]), "partner": np.concatenate([b, a[apart]]), "side": np.concatenate([np.zeros(len(a), np.int64), np.ones(int(apart.sum()), np.int64)]),
        "others": np.concatenate([chunks[b], chunks[a[apart]]]), "same": np.concatenate([~apart, np.zeros(int(apart.sum()), bool)]),
    })
    of_cell = pa.table({**{f"q{i}": cells[:, i].astype(np.int32) for i in range(4)}, "g": group, "chunks": chunks[group]})
    tile_pairs = int(np.where(apart, chunks[a] * chunks[b], chunks[a] * (chunks[a] + 1) // 2).sum())
    tasks = int(np.clip(tile_pairs * tile * tile // TASK_PAIRS, 1, MOST_TASKS))
    t = f.join(F.broadcast(spark.createDataFrame(of_cell)), ["q0", "q1", "q2", "q3"]).select("fp", "g", F.pmod(F.xxhash64("fp"), F.col("chunks")).alias("c"))
    # one row a tile, of about `tile` fingerprints: tiles travel whole to their pairs
    t = t.groupBy("g", "c").agg(F.collect_list("fp").alias("tile"))
    t = t.join(F.broadcast(spark.createDataFrame(sides)), "g").withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1)))
    first = F.when(F.col("same"), F.least("c", "o")).when(F.col("side") == 0, F.col("c")).otherwise(F.col("o"))
    second = F.when(F.col("same"), F.greatest("c", "o")).when(F.col("side") == 0, F.col("o")).otherwise(F.col("c"))
    side = F.when(F.col("same"), (F.col("c") > F.col("o")).cast("long")).otherwise(F.col("side"))
    t = t.select(F.least("g", "partner").alias("ga"), F.greatest("g", "partner").alias("gb"), first.alias("ca"), second.alias("cb"), side.alias("side"), "tile")
    # the work is in the comparisons, so their number decides how many tasks there are, not the bytes
    pair = ["ga", "gb", "ca", "cb"]
    return t.repartition(tasks, *pair).groupBy(*pair).applyInArrow(_compare(radius), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """fp and root (the smallest member) of every node of the edges, by alternating star steps until nothing moves.

    Every step leaves fewer or smaller edges, so it ends; the number of rounds grows with the logarithm of the largest component.
    """
    e = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    while True:
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x")).select(F.col("x.b").alias("a"), F.col("x.m").alias("b")).where("a != b").distinct()
        new = stored(small, "edges")
        forget(e)
        e = new
        # a set of edges is a forest of stars when no node has two targets and no target has one itself
        if new.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").isEmpty() and new.select("b").distinct().join(new.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            break
    return e.select(F.col("a").alias("fp"), F.col("b").alias("root")).unionAll(e.select(F.col("b").alias("fp"), F.col("b").alias("root")).distinct())


def classes(prints: DataFrame, radius: int = 3) -> DataFrame:
    """fp and root of every row of `prints`, a table of distinct fingerprints: equal roots mean one class."""
    found = components(links(prints.select("fp"), radius))
    return prints.select("fp").join(found, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def with_class(printed: DataFrame, counted: DataFrame, of_fp: DataFrame) -> DataFrame:
    """The printed rows with what of_fp says of their fingerprint; counted: fp and n, its rows.

    A fingerprint that many rows share does not bring them together: the few of that kind go to the rows.
    """
    total = counted.agg(F.sum("n")).first()[0] or 0
    hot = counted.where(F.col("n") > max(1000, int(total * HOT_SHARE))).select("fp")
    names = [r.fp for r in hot.collect()]  # fewer than 1 / HOT_SHARE
    if not names:
        return printed.join(of_fp, "fp")
    is_hot = F.col("fp").isin(*names)
    return printed.where(~is_hot).join(of_fp.where(~is_hot), "fp").unionByName(printed.where(is_hot).join(F.broadcast(of_fp.where(is_hot)), "fp"))


def near_duplicates(docs: DataFrame, radius: int = 3, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (hexadecimal) and component_id of every row."""
    printed = stored(fingerprints(docs, [F.col(id_col).alias("doc_id")], width, text_col), "printed")
    of_fp = stored(printed.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "prints")
    rooted = classes(of_fp, radius).join(of_fp, "fp")
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    component = rooted.join(ids, "root").select("fp", "component_id")
    return with_class(printed, of_fp, component).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = 3, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, with all its columns: that of the smallest id (null ids last; then by a hash of the row).

    Rows are told by 128 bits of their values, as 64 would make different rows meet by chance in a table of 10^10 rows. Only
    the keys of rows that go are looked for in the table, so while these are few no document is shuffled. Rows that are equal in
    every column have one key; where the one to keep has such copies, the copies are dropped after that.
    """
    k1, k2 = unused("key", docs.columns), unused("key2", docs.columns)
    keys = [row_hash(docs, docs.columns, seed).alias(k) for seed, k in ((1, k1), (2, k2))]
    printed = stored(fingerprints(docs, [F.col(id_col).alias("id"), keys[0].alias("k1"), keys[1].alias("k2")], width, text_col), "printed")
    order = F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("k1"), F.col("k2"))
    of_fp = stored(printed.groupBy("fp").agg(F.min(order).alias("first"), F.count("*").alias("n")), "prints")
    rooted = stored(classes(of_fp, radius).join(of_fp, "fp").select("root", "first", "fp", "n"), "classes")
    best = rooted.groupBy("root").agg(F.min("first").alias("best"))
    class_best = rooted.join(best, "root").select("fp", F.col("best.k1").alias("b1"), F.col("best.k2").alias("b2"))
    judged = with_class(printed.select("fp", "k1", "k2"), of_fp, class_best).select("k1", "k2", ((F.col("k1") == F.col("b1")) & (F.col("k2") == F.col("b2"))).alias("stays"))
    judged = stored(judged.groupBy("k1", "k2", "stays").agg(F.count("*").alias("n")), "judged")
    figures = judged.agg(F.count(F.when(~F.col("stays"), 1)).alias("gone"), F.count(F.when(F.col("stays") & (F.col("n") > 1), 1)).alias("copied")).first()

    def listed(where: Column, n: int) -> DataFrame:
        out = judged.where(where).select(F.col("k1").alias(k1), F.col("k2").alias(k2))
        return F.broadcast(out) if n <= BROADCAST_KEYS else out

    marked = docs.select("*", *keys)
    kept = marked.join(listed(~F.col("stays"), figures.gone), [k1, k2], "left_anti") if figures.gone else marked
    if figures.copied:
        copied = F.col("stays") & (F.col("n") > 1)
        twins = kept.join(listed(copied, figures.copied), [k1, k2], "left_semi").dropDuplicates([k1, k2])
        kept = kept.join(listed(copied, figures.copied), [k1, k2], "left_anti").unionByName(twins)
    return kept.select(*[f"`{c}`" for c in docs.columns])
