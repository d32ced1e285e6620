"""Toxicity: class-conditional Kneser-Ney models over characters.

Each class (toxic, ordinary) has its own counts of character 5-grams; both models back off to one
shared distribution, interpolated Kneser-Ney over the continuation counts of all classes together. So an
expression that neither class has seen costs both models the same and says nothing, and a rare one
counts only as far as its class count exceeds the discount. A text's score compares the two
log-likelihoods: over the whole text, divided by its length, and over its two most toxic expressions (a
few in a long text must not drown in it); a logistic curve fitted on cross-validated values of labelled
rows turns these into 0..1.

The counts come from a bounded sample of labelled rows (`max_train_rows`, toxic rows first up to a
half, `MAX_TRAIN_BYTES` of text together); scoring covers every whole text in slices, with two tables that hold
their keys, so an n-gram that was never seen finds nothing. Characters beyond the 4094 most frequent ones of the
sample share one symbol.

Defined results: null and empty texts have log-likelihood ratio 0 and get the score of that. With only
one class to learn from, every score is 0.0. Repeated rows get equal scores; only named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, bounded, fields_of, log_sigmoid_fit, map_batches, mix, with_text

ORDER = 5
SYMBOL_BITS = 12
OTHER = (1 << SYMBOL_BITS) - 1
MAX_TRAIN_BYTES = 64 << 20
FOLDS = 3
CHUNK = 1 << 18
DISCOUNT = 0.75
_EMPTY = np.uint64((1 << 64) - 1)  # no n-gram has this code


def points(text: str) -> np.ndarray:
    """Lower-cased code points."""
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def alphabet(texts: list[str]) -> np.ndarray:
    """The symbol of every code point: numbers from 1 by falling frequency, OTHER for the rest; white space is always known."""
    n = np.zeros(0x110000, np.int64)
    for t in texts:
        n += np.bincount(points(t), minlength=len(n)) if len(t) > 100_000 else 0
        if len(t) <= 100_000:
            np.add.at(n, points(t), 1)
    n[32] += 1
    known = np.flatnonzero(n)
    known = known[np.argsort(-n[known], kind="stable")][: OTHER - 1]
    out = np.full(len(n), OTHER, np.uint16)
    out[known] = np.arange(1, len(known) + 1)
    return out


def grams(sym: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Codes of all n-grams; the first symbol is in the highest bits."""
    n = len(sym) - order + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    code = np.zeros(n, np.uint64)
    for i in range(order):
        code = (code << np.uint64(SYMBOL_BITS)) | sym[i : i + n]
    return code


def padded(text: str, symbols: np.ndarray) -> np.ndarray:
    return symbols[points(" " * (ORDER - 1) + text + " ")].astype(np.uint64)


class CodeTable:
    """Values by code, in open addressing: a code is found where it hashes to or in the next places."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        bits = max(4, int(4 * len(codes)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.codes, self.values = np.full(1 << bits, _EMPTY), np.zeros(1 << bits, np.float32)
        left, at = np.arange(len(codes)), self._home(codes)
        while len(left):
            owner = np.full(1 << bits, -1)
            free = self.codes[at[left]] == _EMPTY
            owner[at[left][free]] = left[free]
            got = owner[owner >= 0]
            self.codes[at[got]], self.values[at[got]] = codes[got], values[got]
            left = left[owner[at[left]] != left]
            at[left] = (at[left] + 1) & self.last

    def _home(self, codes: np.ndarray) -> np.ndarray:
        return (mix(codes) >> self.shift).astype(np.int64)

    def find(self, codes: np.ndarray, missing: float) -> np.ndarray:
        out = np.full(len(codes), missing, np.float32)
        left, at = np.arange(len(codes)), self._home(codes)
        while len(left):
            there = self.codes[at]
            hit = there == codes[left]
            out[left[hit]] = self.values[at[hit]]
            on = ~hit & (there != _EMPTY)
            left, at = left[on], (at[on] + 1) & self.last
        return out


def _lookup(keys: np.ndarray, values: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Values at the sorted keys; 0 where there is none."""
    if not len(keys):
        return np.zeros(len(want), values.dtype)
    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    return np.where(keys[at] == want, values[at], 0)


def shared_backoff(all_grams: np.ndarray) -> np.ndarray:
    """Interpolated Kneser-Ney probability of each 5-gram's last symbol after its last three context symbols, from continuation counts."""
    prob = np.full(len(all_grams), 1.0 / (1 << SYMBOL_BITS))
    for order in range(1, ORDER):
        # distinct (order+1)-grams give the continuation counts of their order-symbol endings
        longer = np.unique(all_grams & np.uint64((1 << SYMBOL_BITS * (order + 1)) - 1))
        ends, n = np.unique(longer & np.uint64((1 << SYMBOL_BITS * order) - 1), return_counts=True)
        ctx, which = np.unique(ends >> np.uint64(SYMBOL_BITS), return_inverse=True)
        total, kinds = np.bincount(which, weights=n), np.bincount(which)
        mine = all_grams & np.uint64((1 << SYMBOL_BITS * order) - 1)
        at = np.searchsorted(ctx, mine >> np.uint64(SYMBOL_BITS))
        c = _lookup(ends, n, mine)
        prob = np.maximum(c - DISCOUNT, 0) / total[at] + DISCOUNT * kinds[at] / total[at] * prob
    return prob


@dataclass
class ToxicityModel:
    symbols: np.ndarray
    seen: CodeTable  # log ratio of each n-gram that either class has
    unseen: CodeTable  # by context: log ratio of the weights that the classes give to the shared backoff
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    ready: bool = True

    def ratios(self, sym: np.ndarray) -> np.ndarray:
        code = grams(sym)
        out = self.seen.find(code, np.nan)
        gaps = np.flatnonzero(np.isnan(out))
        out[gaps] = self.unseen.find(code[gaps] >> np.uint64(SYMBOL_BITS), 0.0)
        return out

    def features(self, text: str | None) -> tuple[float, float, float]:
        """The log-likelihood ratio a character of the whole text, and the ratios of its two most toxic expressions (runs between white space)."""
        if not text:
            return 0.0, 0.0, 0.0
        total, count, carry, best = 0.0, 0, 0.0, np.zeros(2)
        for at in range(0, len(text), CHUNK):
            last = at + CHUNK >= len(text)
            cp = points((" " * (ORDER - 1) + text[max(0, at - ORDER + 1) : at])[-(ORDER - 1) :] + text[at : at + CHUNK] + " " * last)
            r = self.ratios(self.symbols[cp].astype(np.uint64)).astype(np.float64)
            total, count = total + r.sum(), count + len(r)
            # an expression ends with the white space after it
            space = IS_SPACE[np.minimum(cp[ORDER - 1 :], 255)]
            sums = np.add.reduceat(r, np.concatenate([[0], np.flatnonzero(space[:-1]) + 1]))
            sums[0] += carry
            if not space[-1]:
                carry, sums = sums[-1], sums[:-1]
            else:
                carry = 0.0
            best = np.sort(np.concatenate([best, sums]))[-2:]
        return total / count, float(best[1]), float(best[0])

    def score(self, text: str | None) -> float:
        if not self.ready:
            return 0.0
        z = (np.array(self.features(text)) - self.mean) / self.scale
        return float(1 / (1 + np.exp(-np.clip(z @ self.weights[:-1] + self.weights[-1], -35, 35))))


def count_tables(toxic: list[str], ordinary: list[str], symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All distinct 5-grams, sorted, and their counts in the two classes."""
    parts = [np.unique(np.concatenate([grams(padded(t, symbols)) for t in texts] or [np.zeros(0, np.uint64)]), return_counts=True) for texts in (toxic, ordinary)]
    keys = np.union1d(parts[0][0], parts[1][0])
    return keys, _lookup(*parts[0], keys), _lookup(*parts[1], keys)


def class_ratios(keys: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The log ratio of each 5-gram, all contexts, and the log ratio of their backoff weights."""
    shared = shared_backoff(keys)
    ctx, which = np.unique(keys >> np.uint64(SYMBOL_BITS), return_inverse=True)
    logs, backs = [], []
    for c in (toxic, ordinary):
        total, kinds = np.bincount(which, weights=c), np.bincount(which, weights=c > 0)
        back = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
        p = np.where(total[which] > 0, np.maximum(c - DISCOUNT, 0) / np.maximum(total[which], 1), 0) + back[which] * shared
        logs.append(np.log(p))
        backs.append(np.log(back))
    return logs[0] - logs[1], ctx, backs[0] - backs[1]


def tables(rows: list[tuple[str, int]], chosen: np.ndarray, symbols: np.ndarray) -> ToxicityModel:
    """A model of the chosen rows' counts, without its curve."""
    keys, toxic, ordinary = count_tables([rows[i][0] for i in chosen if rows[i][1] == 1], [rows[i][0] for i in chosen if rows[i][1] != 1], symbols)
    ratio, ctx, back = class_ratios(keys, toxic, ordinary)
    return ToxicityModel(symbols, CodeTable(keys, ratio), CodeTable(ctx, back), np.zeros(3), np.ones(3), np.zeros(4))


def fit(rows: list[tuple[str, int]], natural: float | None = None) -> ToxicityModel:
    """rows: texts and labels in a fixed order; natural: the share of label 1 that the scores are to reflect."""
    y = np.array([int(label == 1) for _, label in rows], int)
    if not len(y) or y.min() == y.max():
        nothing = CodeTable(np.zeros(0, np.uint64), np.zeros(0))
        return ToxicityModel(np.zeros(0, np.uint16), nothing, nothing, np.zeros(3), np.ones(3), np.zeros(4), False)
    symbols = alphabet([t for t, _ in rows])
    fold = np.zeros(len(y), int)
    for label in (0, 1):
        mine = np.flatnonzero(y == label)
        fold[mine] = np.arange(len(mine)) % FOLDS
    x = np.zeros((len(y), 3))
    for k in range(FOLDS):
        # a row's features for the curve come from counts without its fold
        part = tables(rows, np.flatnonzero(fold != k), symbols)
        for i in np.flatnonzero(fold == k):
            x[i] = part.features(rows[i][0])
    model = tables(rows, np.arange(len(y)), symbols)
    share = y.mean()
    natural = share if natural is None else natural
    model.mean, model.scale, model.weights = log_sigmoid_fit(x, y, np.where(y == 1, natural / share, (1 - natural) / (1 - share)))
    return model


def train(texts: DataFrame, labels: DataFrame, where: Column, max_train_rows: int = 6000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Fit on labelled rows for which `where` (over the id column) holds. An id with both labels counts with each."""
    known = labels.where(where).where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).distinct()
    n = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return fit([])
    half = max_train_rows // 2
    quota = {1: min(n[1], max(half, max_train_rows - n[0])), 0: 0}
    quota[0] = min(n[0], max_train_rows - quota[1])
    order = F.xxhash64("id", "label")
    # ids of the sample: bounded by max_train_rows, so they go out by broadcast
    chosen = None
    for label in (0, 1):
        part = known.where(F.col("label") == label).orderBy(order, "id").limit(quota[label])
        chosen = part if chosen is None else chosen.unionAll(part)
    rows = texts.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "id").orderBy(order, "text").limit(2 * max_train_rows)
    rows = bounded(rows, [order, "text"], MAX_TRAIN_BYTES).orderBy(order, "text")
    return fit([(r.text, r.label) for r in rows.select("text", "label").collect()], natural=n[1] / (n[0] + n[1]))


def score(docs: DataFrame, model: ToxicityModel, id_cols: list[Column], text_col: str = "text") -> DataFrame:
    """The id columns and the score of every row; one map over the scan, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            got = [m.score(t) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(got, pa.float64())], [*b.schema.names[:-1], "score"])

    schema = fields_of(docs, id_cols) + ", score double"
    return map_batches(with_text(docs, id_cols, text_col), run, schema)
