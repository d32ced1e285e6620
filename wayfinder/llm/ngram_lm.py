"""Language-model scoring by deleted interpolation of word bigrams.

The probability of a word after its history is a mix of maximum-likelihood estimates: bigram, unigram
and uniform. The weights depend on the bucket of the history's frequency and are learned by expectation-
maximisation on held-out counts: every training token is held out in turn (its own occurrence deleted
from the counts it is judged by).

How counts reach the texts without a table of the whole vocabulary anywhere: documents are dealt into
blocks by hash (about `block_bytes` of text each). A block's distinct n-grams, with their training counts, are
cut into slices of the hash space, one compressed row a block and slice. `fan` blocks' rows of a slice meet in a task,
which adds them up; with more blocks than that, the sums stand for a block of the next level, cut into `fan` finer
slices, and so on until one task has all that there is of a slice. The totals then go down the same way: each task
answers its rows in their own order. So a level has blocks * `fan` rows, there are log(blocks) / log(`fan`) levels
(one up to some 1 GB of text, two up to 256 GB, four at 100 TB), and a frequent word costs one entry a block.
N-grams are told by 64-bit hashes. Sums of counts cover all training documents; the weights come from a
histogram of fixed size over all training tokens (ratios of estimates in fine logarithmic steps). A task holds one
block (some 15 bytes a byte of its text), or as many n-grams as a block has (some 85 bytes each).

Defined results: null and empty texts are the end token alone; repeated rows count and are scored each;
with nothing to learn from, counts are zero and every token has the uniform probability.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_sums, joined, mix, slices, small_batches, span_hashes, stored, word_spans

END = mix(np.array([0x5851F42D4C957F2D], np.uint64))[0]
#: Histories are bucketed by the binary logarithm of their count.
BUCKETS = 24
#: Steps a natural logarithm in the histogram of estimate ratios, and its half-width in steps.
STEP, HALF = 4, 48


_SQUEEZE: list[zstandard.ZstdCompressor] = []


def pack(a: np.ndarray) -> bytes:
    """Integers by byte planes, compressed; sorted or small ones become short."""
    if not _SQUEEZE:
        _SQUEEZE.append(zstandard.ZstdCompressor(level=1))
    wide = np.ascontiguousarray(a)
    return _SQUEEZE[0].compress(wide.view(np.uint8).reshape(-1, wide.itemsize).T.tobytes())


def unpack(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens (each text's words, A-Z lower-cased, then an end), and the number of tokens of each text."""
    parts, counts = [], []
    for a, b in slices(texts):
        buf, offsets = joined(texts[a:b])
        starts, ends = word_spans(buf)
        h = span_hashes(hash_sums(buf, lower=True), starts, ends)
        upto = np.searchsorted(starts, offsets[1:])
        n = np.diff(np.concatenate([[0], upto]))
        # an end after each text's words
        parts.append(np.insert(h, upto, END))
        counts.append(n + 1)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(parts), np.concatenate(counts)


def histories(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each token's history: the token before it in its text, or the end at the start."""
    out = np.empty_like(h)
    out[1:] = h[:-1]
    starts = np.cumsum(counts) - counts
    out[starts] = END
    return out


def bigrams(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + mix(h ^ np.uint64(0xA0761D6478BD642F)))


def _ordered(table: pa.Table) -> tuple[pa.Table, list[bytes], np.ndarray]:
    """The block's documents in an order that does not depend on how they arrived, their texts and which ones train."""
    texts = [t or b"" for t in table.column("text").cast(pa.binary()).to_pylist()]
    ids, held = table.column("doc_id").to_pylist(), table.column("held_out").to_pylist()
    order = sorted(range(len(texts)), key=lambda i: (ids[i] is None, 0 if ids[i] is None else ids[i], texts[i]))
    return table.take(pa.array(order, pa.int64())), [texts[i] for i in order], ~np.array([held[i] for i in order], bool)


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Token counts by text, histories' and tokens' places: distinct unigrams and bigrams, each with the place of every token."""
    h, counts = tokens(texts)
    one, at_one = np.unique(h, return_inverse=True)
    two, at_two = np.unique(bigrams(histories(h, counts), h), return_inverse=True)
    return counts, h, (one, at_one), (two, at_two)


def _cuts(keys: np.ndarray, at: int, of: int, parts: int) -> np.ndarray:
    """Where each of the parts begins in the sorted keys, of the slice `at` of the `of` slices of the hash space."""
    edges = [((at * parts + i) << 64) // (of * parts) for i in range(1, parts)]
    return np.concatenate([[0], np.searchsorted(keys, np.array(edges, np.uint64)), [len(keys)]])


REQUEST = "node long, slice long, ones binary, one_counts binary, twos binary, two_counts binary"
ANSWER = "node long, slice long, one_counts binary, two_counts binary, distinct long, total long"
SCORED = "doc_id {id}, held_out boolean, n_tokens long, n_known long, base_score double, before binary, ones binary, twos binary"
ORDERS = (("ones", "one_counts"), ("twos", "two_counts"))


def _sliced(node: int, grams: list[tuple[np.ndarray, np.ndarray]], at: int, of: int, parts: int) -> pa.Table:
    """Requests of a node: its sorted keys and counts (of unigrams and of bigrams), a row a slice."""
    out: dict[str, pa.Array] = {"node": pa.array([node] * parts, pa.int64()), "slice": pa.array(range(at * parts, (at + 1) * parts), pa.int64())}
    for (key_name, count_name), (keys, counts) in zip(ORDERS, grams):
        cut = _cuts(keys, at, of, parts).tolist()
        out[key_name] = pa.array([pack(keys[a:b]) for a, b in zip(cut, cut[1:])], pa.binary())
        out[count_name] = pa.array([pack(counts[a:b].astype(np.int64)) for a, b in zip(cut, cut[1:])], pa.binary())
    return pa.table(out)


def _request(parts: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        _, texts, train = _ordered(table)
        counts, _, (one, at_one), (two, at_two) = _grams(texts)
        learn = np.repeat(train, counts)
        grams = [(k, np.bincount(at[learn], minlength=len(k))) for k, at in ((one, at_one), (two, at_two))]
        return _sliced(table.column("block")[0].as_py(), grams, 0, 1, parts)

    return run


def _unpacked(table: pa.Table, name: str, kind: type) -> list[np.ndarray]:
    return [unpack(x, kind) for x in table.column(name).to_pylist()]


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All distinct keys, sorted, and the sums of their counts."""
    whole = np.concatenate(keys)
    order = np.argsort(whole, kind="stable")
    ranked = whole[order]
    starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)
    return ranked[starts], np.add.reduceat(np.concatenate(counts)[order], starts) if len(ranked) else np.zeros(0, np.int64)


def _merge(of: int, parts: int):
    """Many nodes' requests for a slice as those of the node above them, for its parts."""

    def run(table: pa.Table) -> pa.Table:
        grams = [_added(_unpacked(table, k, np.uint64), _unpacked(table, n, np.int64)) for k, n in ORDERS]
        return _sliced(table.column("parent")[0].as_py(), grams, table.column("slice")[0].as_py(), of, parts)

    return run


def _replies(table: pa.Table, totals: list[tuple[np.ndarray, np.ndarray]]) -> dict[str, pa.Array]:
    """For each request the totals, in the order of its keys."""
    out: dict[str, pa.Array] = {"node": table.column("node").cast(pa.int64()), "slice": table.column("slice").cast(pa.int64())}
    for (key_name, count_name), (keys, sums) in zip(ORDERS, totals):
        out[count_name] = pa.array([pack(sums[np.searchsorted(keys, k)]) for k in _unpacked(table, key_name, np.uint64)], pa.binary())
    return out


def _answer(table: pa.Table) -> pa.Table:
    """Where all nodes' requests for a slice have met: the totals, and once how many unigrams there are and their sum."""
    totals = [_added(_unpacked(table, k, np.uint64), _unpacked(table, n, np.int64)) for k, n in ORDERS]
    ones, n = totals[0][1], table.num_rows
    return pa.table(_replies(table, totals) | {"distinct": pa.array([int((ones > 0).sum())] + [0] * (n - 1), pa.int64()), "total": pa.array([int(ones.sum())] + [0] * (n - 1), pa.int64())})


def _descend(table: pa.Table, above: pa.Table) -> pa.Table:
    """The answers to the node above, passed on to the requests that it stood for."""
    order = np.argsort(above.column("fine").to_numpy())
    totals = []
    for key_name, count_name in ORDERS:
        keys = np.unique(np.concatenate(_unpacked(table, key_name, np.uint64)))
        totals.append((keys, np.concatenate([unpack(above.column(count_name)[int(i)].as_py(), np.int64) for i in order])))
        if len(keys) != len(totals[-1][1]):
            raise RuntimeError("the counts do not match their requests")
    zero = pa.array([0] * table.num_rows, pa.int64())
    return pa.table(_replies(table, totals) | {"distinct": zero, "total": zero})


def _resolved(requests: DataFrame, nodes: int, slices: int, fan: int) -> tuple[DataFrame, DataFrame]:
    """Answers to the requests of so many nodes, and those of the last level, which carry the totals."""
    if nodes <= fan:
        top = stored(requests.groupBy("slice").applyInArrow(_answer, ANSWER), "counts")
        return top, top
    asked = stored(requests.withColumn("parent", F.floor(F.col("node") / fan)), "requests")
    merged = asked.groupBy("parent", "slice").applyInArrow(_merge(slices, fan), REQUEST)
    answers, top = _resolved(merged, -(-nodes // fan), slices * fan, fan)
    above = answers.select(F.col("node").alias("parent"), F.floor(F.col("slice") / fan).alias("slice"), F.col("slice").alias("fine"), "one_counts", "two_counts")
    down = asked.groupBy("parent", "slice").cogroup(above.groupBy("parent", "slice")).applyInArrow(_descend, ANSWER)
    return stored(down, "counts"), top


def _meet(total: int, distinct: int, delta: float):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        kept, texts, _ = _ordered(docs)
        counts, h, (one, at_one), (two, at_two) = _grams(texts)
        order = np.argsort(answers.column("slice").to_numpy())
        c1, c2 = (np.concatenate([unpack(answers.column(n)[int(i)].as_py(), np.int64) for i in order] or [np.zeros(0, np.int64)]) for n in ("one_counts", "two_counts"))
        if len(c1) != len(one) or len(c2) != len(two):
            raise RuntimeError("the counts do not match their block")
        ones, twos = c1[at_one], c2[at_two]
        end = int(c1[np.searchsorted(one, END)])
        ends = np.cumsum(counts)
        starts = ends - counts
        before = np.empty_like(ones)
        before[1:] = ones[:-1]
        before[starts] = end  # a text starts after an end, as often as there are training texts
        base = np.add.reduceat(np.log10((ones + delta) / (total + delta * (distinct + 1))), starts)
        known = np.add.reduceat((ones > 0).astype(np.int64), starts)

        def by_text(a: np.ndarray) -> pa.Array:
            return pa.array([pack(a[s:e].astype(np.uint32 if total < 1 << 32 else np.uint64)) for s, e in zip(starts, ends)], pa.binary())

        return pa.table({"doc_id": kept.column("doc_id"), "held_out": kept.column("held_out"), "n_tokens": pa.array(counts), "n_known": pa.array(known), "base_score": pa.array(base), "before": by_text(before), "ones": by_text(ones), "twos": by_text(twos)})

    return run


def _bucket(before: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(np.maximum(before, 0).astype(np.float64))[1], BUCKETS - 1)


def _estimates(before: np.ndarray, ones: np.ndarray, twos: np.ndarray, total: int, distinct: int, deleted: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Bigram, unigram and uniform estimates; deleted: occurrences of the token itself to leave out (0 or 1)."""
    b, o, t = (np.maximum(x.astype(np.float64) - deleted, 0) for x in (before, ones, twos))
    two = np.divide(t, b, out=np.zeros_like(t), where=b > 0)
    return two, o / max(total - deleted, 1), 1.0 / (distinct + 1)


def _steps(p: np.ndarray, uniform: float) -> np.ndarray:
    """0 for probability 0, else 1 + the ratio to uniform in logarithmic steps."""
    with np.errstate(divide="ignore"):
        at = np.clip(np.rint(np.log(p / uniform) * STEP), -HALF, 3 * HALF)
    return np.where(p > 0, np.where(np.isfinite(at), at, 0) + HALF + 1, 0).astype(np.int64)


SIDE = 4 * HALF + 2


def _histogram(scored: DataFrame, total: int, distinct: int) -> list[tuple[int, int]]:
    """(cell, tokens) over all training tokens; a cell is bucket, bigram step and unigram step."""

    def run(batches):
        cells = np.zeros(BUCKETS * SIDE * SIDE, np.int64)
        kind = np.uint32 if total < 1 << 32 else np.uint64
        for b in batches:
            for x in zip(*(b.column(i).to_pylist() for i in range(3))):
                before, ones, twos = (unpack(v, kind) for v in x)
                two, one, uniform = _estimates(before, ones, twos, total, distinct, 1)
                cell = (_bucket(before.astype(np.int64) - 1) * SIDE + _steps(two, uniform)) * SIDE + _steps(one, uniform)
                cells += np.bincount(cell, minlength=len(cells)) if len(cell) > 100_000 else 0
                if len(cell) <= 100_000:
                    np.add.at(cells, cell, 1)
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(cells[at])], ["cell", "n"])

    got = scored.where("not held_out").select("before", "ones", "twos").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    return sorted((r.cell, r.n) for r in got.collect())  # at most BUCKETS * SIDE^2 cells


def learn_weights(cells: list[tuple[int, int]], rounds: int = 40) -> np.ndarray:
    """Mixture weights (bigram, unigram, uniform) of each bucket by expectation-maximisation over the histogram."""
    weights = np.tile([0.4, 0.4, 0.2], (BUCKETS, 1))
    if not cells:
        return weights
    cell, n = np.array(cells).T
    bucket = cell // (SIDE * SIDE)

    def ratio(step: np.ndarray) -> np.ndarray:
        return np.where(step > 0, np.exp((step - HALF - 1) / STEP), 0.0)

    p = np.column_stack([ratio(cell // SIDE % SIDE), ratio(cell % SIDE), np.ones(len(cell))])
    for _ in range(rounds):
        share = weights[bucket] * p
        share *= (n / share.sum(axis=1))[:, None]
        got = np.column_stack([np.bincount(bucket, share[:, k], BUCKETS) for k in range(3)]) + [0.5, 0.5, 0.5]
        weights = got / got.sum(axis=1, keepdims=True)
    return weights


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", delta: float = 0.1, block_bytes: int = 4 << 20, least_blocks: int = 24, fan: int = 256) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every row; rows with held_out train nothing."""
    spark = docs.sparkSession
    small_batches(spark)
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    size = d.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()[0]
    blocks = max(least_blocks, -(-size // block_bytes))
    parts = min(blocks, fan)
    id_type = d.schema["doc_id"].dataType.simpleString()
    d = d.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("long"))
    answers, top = _resolved(d.groupBy("block").applyInArrow(_request(parts), REQUEST), blocks, parts, fan)
    sums = top.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n"), F.coalesce(F.sum("distinct"), F.lit(0)).alias("v")).first()
    met = d.groupBy("block").cogroup(answers.groupBy("node")).applyInArrow(_meet(sums.n, sums.v, delta), SCORED.format(id=id_type))
    scored = stored(met, "scored")
    weights = learn_weights(_histogram(scored, sums.n, sums.v))
    n, v = sums.n, sums.v

    def finish(batches):
        kind = np.uint32 if n < 1 << 32 else np.uint64
        for b in batches:
            out = []
            for x in zip(*(b.column(i).to_pylist() for i in (5, 6, 7))):
                before, ones, twos = (unpack(y, kind) for y in x)
                two, one, uniform = _estimates(before, ones, twos, n, v, 0)
                w = weights[_bucket(before)]
                out.append(float(np.log10(w[:, 0] * two + w[:, 1] * one + w[:, 2] * uniform).sum()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), b.column(3), pa.array([n] * b.num_rows, pa.int64()), b.column(4), pa.array(out, pa.float64())],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return scored.mapInArrow(finish, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
