"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed character 1- to 3-grams of the lower-cased text with everything ASCII that is no
letter turned into a space; sublinear term frequencies times smoothed inverse document frequencies,
scaled to length one. The weights are trained with follow-the-regularised-leader under an elastic-net
penalty (the L1 part keeps them sparse), then a softmax temperature is fitted on labelled rows that
the weights have not seen.

Document frequencies are counted over all labelled training rows, in one pass of fixed-size partial sums. The
classifier's fit uses a bounded sample of their different texts (`max_train_rows`, `MAX_TRAIN_BYTES`); prediction covers every whole text,
in slices of `CHUNK` code points, so memory does not depend on a text's length.

Defined results: a null text or one without a letter gets `und` with score 0.0; with nothing to learn
from every text gets `und`. Repeated rows get equal predictions. Only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, fields_of, map_batches, with_text

UNDETERMINED = "und"
BITS = 15
DIM = 1 << BITS
ORDERS = (1, 2, 3)
CHUNK = 1 << 18
MAX_TRAIN_BYTES = 128 << 20
LETTER = regex.compile(r"\p{L}")
_ASCII = np.full(128, 32, np.uint32)
_ASCII[97:123] = np.arange(97, 123)
_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def term_counts(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of the whole text, padded with a space at either end."""
    total = np.zeros(DIM, np.int64)
    reach = max(ORDERS) - 1
    for at in range(0, max(len(text), 1), CHUNK):
        part = " " * (at == 0) + text[max(0, at - reach) : at + CHUNK].lower() + " " * (at + CHUNK >= len(text))
        cp = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        cp = np.where(cp < 128, _ASCII[np.minimum(cp, 127)], cp)
        h = np.zeros(len(cp), np.uint32)
        for n in ORDERS:
            if len(cp) < n:
                break
            h = h[: len(cp) - n + 1] + (cp[n - 1 :] + np.uint32(n)) * _MULT[n - 1]
            # the n-grams that lie wholly in what the last chunk has seen are counted already
            known = max(0, min(at, reach) - n + 1) if at else 0
            idx = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)
            total += np.bincount(idx[known:], minlength=DIM)
    return total


def sparse(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    idx = np.flatnonzero(counts).astype(np.int32)
    return idx, counts[idx].astype(np.float32)


@dataclass
class LanguageModel:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # DIM x langs
    bias: np.ndarray
    temperature: float

    def features(self, idx: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        val = (1 + np.log(n)) * self.idf[idx]
        return idx, val / (np.sqrt(val @ val) or 1.0)

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.langs or not LETTER.search(text):
            return UNDETERMINED, 0.0
        idx, val = self.features(*sparse(term_counts(text)))
        z = (val @ self.weights[idx] + self.bias) / self.temperature
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return self.langs[best], float(p[best] / p.sum())


def labelled(docs: DataFrame, label: Column, text_col: str = "text") -> DataFrame:
    return docs.select(F.col(text_col).alias("text"), label.cast("string").alias("label")).where("text is not null and label is not null")


def training_sample(docs: DataFrame, label: Column, max_rows: int, text_col: str = "text", max_bytes: int = MAX_TRAIN_BYTES) -> list[tuple[str, str]]:
    """About max_rows different labelled texts, shared out evenly between the labels: those with the smallest hashes.

    Copies count once, so a text that many rows hold takes one place; the limit holds for each label by itself. No more
    than max_bytes of text come, in order of their hashes.
    """
    rows = labelled(docs, label, text_col)
    hashed = F.xxhash64("text", "label")
    # an estimate of the different texts will do for the rate
    counts = {r.label: max(r.n, 1) for r in rows.groupBy("label").agg(F.approx_count_distinct(hashed).alias("n")).collect()}
    if not counts:
        return []
    each = max(1, max_rows // len(counts))
    rate = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, each / n)))])
    share = F.shiftrightunsigned(hashed, 11) / F.lit(float(1 << 53))
    few = rows.withColumn("share", share).where(F.col("share") < rate[F.col("label")]).distinct()
    place = F.row_number().over(Window.partitionBy("label").orderBy("share", "text"))
    got = bounded(few.withColumn("place", place).where(F.col("place") <= 2 * each), ["share", "label", "text"], max_bytes).orderBy("share", "label", "text")
    return [(r.text, r.label) for r in got.select("text", "label").collect()]


def document_frequencies(docs: DataFrame, label: Column, text_col: str = "text") -> tuple[int, np.ndarray]:
    """How many labelled texts have a letter, and how many of them have each hashed n-gram: all rows, summed by task and then by n-gram."""

    def run(batches):
        total, seen = 0, np.zeros(DIM, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                if LETTER.search(t):
                    total += 1
                    seen += term_counts(t) > 0
        if total:
            idx = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(idx, DIM), pa.int32()), pa.array(np.append(seen[idx], total), pa.int64())], ["idx", "n"])

    rows = map_batches(labelled(docs, label, text_col).select("text"), run, "idx int, n long")
    # the last place holds the number of texts
    out = np.zeros(DIM + 1, np.int64)
    for r in rows.groupBy("idx").agg(F.sum("n").alias("n")).collect():
        out[r.idx] = r.n
    return int(out[DIM]), out[:DIM]


def fit(sample: list[tuple[str, str]], total: int, seen: np.ndarray, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.001, seed: int = 7) -> LanguageModel:
    sample = [(t, y) for t, y in sample if LETTER.search(t)]
    langs = sorted({y for _, y in sample})
    k = len(langs)
    model = LanguageModel(langs, np.ones(DIM), np.zeros((DIM, k)), np.zeros(k), 1.0)
    if k < 2:
        return model
    counts = [sparse(term_counts(t)) for t, _ in sample]
    model.idf = np.log((1 + total) / (1 + seen)) + 1
    rows = [model.features(*c) for c in counts]
    target = np.eye(k)[[langs.index(y) for _, y in sample]]
    order = np.random.default_rng(seed).permutation(len(rows))
    held = order[: max(1, len(order) // 5)] if len(order) >= 5 * k else order[:0]
    train = order[len(held) :]
    # coordinates of follow-the-regularised-leader; the last row is the constant, free of penalties
    z, n = np.zeros((DIM + 1, k)), np.zeros((DIM + 1, k))

    def leader(idx: np.ndarray) -> np.ndarray:
        zi, penalty = z[idx], np.where(idx[:, None] == DIM, 0.0, l1)
        w = -(zi - np.sign(zi) * penalty) / ((beta + np.sqrt(n[idx])) / alpha + l2)
        return np.where(np.abs(zi) <= penalty, 0.0, w)

    for _ in range(epochs):
        for i in train:
            idx, val = np.append(rows[i][0], np.int32(DIM)), np.append(rows[i][1], 1.0)
            w = leader(idx)
            s = val @ w
            p = np.exp(s - s.max())
            g = np.outer(val, p / p.sum() - target[i])
            sigma = (np.sqrt(n[idx] + g * g) - np.sqrt(n[idx])) / alpha
            z[idx] += g - sigma * w
            n[idx] += g * g
    full = leader(np.arange(DIM + 1))
    model.weights, model.bias = full[:DIM], full[DIM]
    if len(held):
        logits = np.array([rows[i][1] @ model.weights[rows[i][0]] + model.bias for i in held])
        model.temperature = fit_temperature(logits, target[held].argmax(axis=1))
    return model


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search on its logarithm."""

    def loss(log_t: float) -> float:
        s = logits / np.exp(log_t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    lo, hi, g = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(50):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def train(docs: DataFrame, where: Column | None = None, text_col: str = "text", lang_col: str = "lang", max_train_rows: int = 4000) -> LanguageModel:
    rows = docs if where is None else docs.where(where)
    return fit(training_sample(rows, F.col(lang_col), max_train_rows, text_col), *document_frequencies(rows, F.col(lang_col), text_col))


def predict(docs: DataFrame, model: LanguageModel, id_cols: list[Column], text_col: str = "text") -> DataFrame:
    """The id columns, lang_pred and score of every row; one map over the scan, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            got = [m.predict(t) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                [*b.schema.names[:-1], "lang_pred", "score"],
            )

    schema = fields_of(docs, id_cols) + ", lang_pred string, score double"
    return map_batches(with_text(docs, id_cols, text_col), run, schema)


def keep_identified(docs: DataFrame, model: LanguageModel, min_score: float, text_col: str = "text") -> DataFrame:
    """The rows whose text gets a language with at least min_score, with all their columns."""
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            got = (m.predict(t) for t in b.column(at).to_pylist())
            yield b.filter(pa.array([lang != UNDETERMINED and score >= min_score for lang, score in got], pa.bool_()))

    return map_batches(docs, run, docs.schema)
