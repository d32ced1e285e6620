"""Quality rules by line sequence labelling: a linear-chain conditional random field over a text's lines.

Each line has a vector of features; Viterbi decoding marks it as content or boilerplate (junk, repeats,
shouting, tables); the share of words in content lines decides whether the text is kept. The field is
trained here, by gradient steps (Adam) on the exact log-likelihood (forward-backward), on the whole line
sequences of a bounded sample of labelled documents (`max_train_rows` of them, `MAX_TRAIN_LINES` lines each,
`MAX_TRAIN_BYTES` together): lines of documents of quality 1 as content, of quality 0 as boilerplate, unless they
read like ordinary lines. Any line may come first; the chain has no weights for its start.

Base figures (words, symbols, repeated lines and windows) are exact over the whole text; equal words and
windows are told by 64-bit hashes within one text.

Defined results: null and empty texts have no words and fail the base rules; a text without lines that
hold a word has content share 0. Without labels to learn from, every text that passes the base is kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, fields_of, hash_sums, map_batches, mix, span_hashes, texts_of, with_text, word_spans

SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MOST_REPEATED = 50, 50  # words; per cent of words in repeated windows
BASE_FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
N_FEATURES = 14
MAX_TRAIN_LINES, MAX_TRAIN_BYTES = 512, 64 << 20
#: Lines, padding included, of one batch in training.
BATCH_LINES = 1 << 16

_LETTER, _UPPER, _DIGIT, _SYMBOL, _START, _STOP = (np.zeros(256, bool) for _ in range(6))
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[0xC3:] = True  # lead bytes of non-ASCII characters
_DIGIT[48:58] = True
_SYMBOL[list(SYMBOLS)] = True
_START[:] = True
_START[0x80:0xC0] = False  # continuation bytes start no character
_STOP[list(b".?!:;")] = True


def _sums(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[ends] - total[starts]


@dataclass
class Lines:
    """The lines of one text that hold a word."""

    features: np.ndarray
    words: np.ndarray


def analyse(data: bytes, with_features: bool = True) -> tuple[tuple[int, ...], Lines]:
    """The base figures of a whole text, and its lines."""
    if not data:
        return (0, 0, 0, 0, 0), Lines(np.zeros((0, N_FEATURES)), np.zeros(0, np.int64))
    buf = np.frombuffer(data, np.uint8)
    starts, ends = word_spans(buf)
    n = len(starts)
    symbols = np.flatnonzero(_SYMBOL[buf])
    # white space is one byte a character
    word_chars = int(np.count_nonzero(_START[buf])) - (len(buf) - int((ends - starts).sum()))
    breaks = np.concatenate([[-1], np.flatnonzero(buf == 10), [len(buf)]])
    low, high = breaks[:-1] + 1, breaks[1:]
    first = np.searchsorted(starts, low)
    words = np.searchsorted(starts, high) - first
    full = words > 0
    low, high, words, first = low[full], high[full], words[full], first[full]
    if not n:
        return (0, 0, len(symbols), 0, 0), Lines(np.zeros((0, N_FEATURES)), words)
    sums = hash_sums(buf)
    h = span_hashes(sums, starts, ends)
    lines = span_hashes(sums, low, high)
    _, where, inverse = np.unique(lines, return_index=True, return_inverse=True)
    repeated_line = where[inverse] != np.arange(len(lines))
    covered = np.zeros(n, bool)
    if n >= 3:
        window = mix(mix(h[:-2]) + h[1:-1]) + h[2:]
        _, back, times = np.unique(window, return_inverse=True, return_counts=True)
        again = times[back] > 1
        covered[:-2] |= again
        covered[1:-1] |= again
        covered[2:] |= again
    base = (n, word_chars, len(symbols), int(repeated_line.sum()), int(covered.sum()))
    if not with_features:
        return base, Lines(np.zeros((len(words), N_FEATURES)), words)

    def within(places: np.ndarray) -> np.ndarray:
        return np.searchsorted(places, high) - np.searchsorted(places, low)

    size = high - low
    lead, tail = buf[starts], buf[ends - 1]
    f = np.empty((len(words), N_FEATURES))
    f[:, 0] = 1
    f[:, 1] = np.minimum(np.log1p(words), 6) / 3
    f[:, 2] = np.minimum(20 * within(symbols) / size, 2)
    f[:, 3] = np.minimum(20 * within(np.flatnonzero(buf == 33)) / size, 2)
    f[:, 4] = within(np.flatnonzero(_UPPER[buf])) / size
    f[:, 5] = within(np.flatnonzero(_DIGIT[buf])) / size
    f[:, 6] = _sums(~_LETTER[lead], first, first + words) / words
    f[:, 7] = _sums(_SYMBOL[tail] | (tail == 33), first, first + words) / words
    f[:, 8] = repeated_line
    f[:, 9] = _sums(covered, first, first + words) / words
    f[:, 10] = _STOP[tail[first + words - 1]]
    f[:, 11] = words < 4
    f[:, 12] = np.minimum(size / words, 20) / 10
    same = np.zeros(n, bool)
    same[1:] = h[1:] == h[:-1]
    f[:, 13] = _sums(same, first, first + words) / words
    return base, Lines(f, words)


@dataclass
class LineField:
    """Weights of the chain's two labels (0 boilerplate, 1 content): emissions for label 1 against 0, and transitions."""

    emit: np.ndarray
    move: np.ndarray  # 2 x 2
    threshold: float = 0.5
    ready: bool = True

    def decode(self, features: np.ndarray) -> np.ndarray:
        """The best label sequence (Viterbi)."""
        score = (features @ self.emit).tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        back, a, b = [], 0.0, score[0]
        for s in score[1:]:
            from0, from1 = (a + m00, b + m10), (a + m01, b + m11)
            back.append((from0[1] > from0[0], from1[1] > from1[0]))
            a, b = max(from0), max(from1) + s
        out = [int(b > a)]
        for step in reversed(back):
            out.append(int(step[out[-1]]))
        return np.array(out[::-1])

    def content_share(self, lines: Lines) -> float:
        if not len(lines.words):
            return 0.0
        if not self.ready:
            return 1.0
        return float((self.decode(lines.features) * lines.words).sum() / lines.words.sum())

    def judge(self, data: bytes) -> tuple[int, int, int, int, int, bool, float, bool]:
        base, lines = analyse(data, self.ready)
        failed = base[0] < MIN_WORDS or 100 * base[4] > MOST_REPEATED * base[0]
        share = self.content_share(lines)
        return *base, failed, share, not failed and share >= self.threshold


def log_likelihood(emit: np.ndarray, move: np.ndarray, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Of padded sequences (rows x time x features; labels; mask): its value and gradients, by forward-backward."""
    n, t = y.shape
    unary = np.zeros((n, t, 2))
    unary[:, :, 1] = x @ emit
    alpha, beta = np.zeros((n, t, 2)), np.zeros((n, t, 2))

    def lse(v: np.ndarray, axis: int) -> np.ndarray:
        top = v.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(v - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    alpha[:, 0] = unary[:, 0]
    for i in range(1, t):
        step = lse(alpha[:, i - 1, :, None] + move, 1) + unary[:, i]
        alpha[:, i] = np.where(mask[:, i, None], step, alpha[:, i - 1])
    for i in range(t - 2, -1, -1):
        step = lse(move + (unary[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
        beta[:, i] = np.where(mask[:, i + 1, None], step, beta[:, i + 1])
    z = lse(alpha[:, -1], 1)
    p1 = np.exp(alpha[:, :, 1] + beta[:, :, 1] - z[:, None]) * mask
    pair_mask = mask[:, 1:]
    pair = np.exp(np.minimum(alpha[:, :-1, :, None] + move + (unary[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None], 0)) * pair_mask[:, :, None, None]
    g_emit = np.einsum("nt,ntf->f", (y - p1) * mask, x)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:, :-1][pair_mask], y[:, 1:][pair_mask]), 1)
    value = float((unary[:, :, 1] * y * mask).sum() + (seen * move).sum() - z.sum())
    return value, g_emit, seen - pair.sum(axis=(0, 1))


def padded_batches(runs: list[tuple[np.ndarray, int]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Whole sequences, those of like length together: features, labels and mask."""
    runs = sorted(runs, key=lambda r: len(r[0]))
    batches, at = [], 0
    while at < len(runs):
        to = at + 1
        while to < len(runs) and (to + 1 - at) * len(runs[to][0]) <= BATCH_LINES:
            to += 1
        part, t = runs[at:to], len(runs[to - 1][0])
        x, y, mask = np.zeros((len(part), t, N_FEATURES)), np.zeros((len(part), t), int), np.zeros((len(part), t), bool)
        for i, (f, q) in enumerate(part):
            x[i, : len(f)], y[i, : len(f)], mask[i, : len(f)] = f, q, True
        batches.append((x, y, mask))
        at = to
    return batches


def fit(sample: list[tuple[bytes, int]], steps: int = 60, rate: float = 0.15, ridge: float = 1e-3) -> LineField:
    """sample: texts and quality labels in a fixed order; texts of over MAX_TRAIN_LINES lines take no part."""
    runs = []
    for data, q in sample:
        lines = analyse(data)[1].features
        if 0 < len(lines) <= MAX_TRAIN_LINES:
            runs.append((lines, int(q == 1)))
    field = LineField(np.zeros(N_FEATURES), np.zeros((2, 2)), ready=len({q for _, q in runs}) == 2)
    if not field.ready:
        return field
    batches = padded_batches(runs)
    w = np.zeros(N_FEATURES + 4)
    m, v = np.zeros_like(w), np.zeros_like(w)
    scale = sum(b[2].sum() for b in batches)
    for k in range(1, steps + 1):
        g = -ridge * w
        for x, y, mask in batches:
            _, ge, gm = log_likelihood(w[:N_FEATURES], w[N_FEATURES:].reshape(2, 2), x, y, mask)
            g = g + np.concatenate([ge, gm.ravel()]) / scale
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
        if k == steps // 2:  # lines of rejected documents that read like content do not count against it
            for x, y, mask in batches:
                p = x @ w[:N_FEATURES]
                y[(p > 2.0) & mask] = 1
    field.emit, field.move = w[:N_FEATURES], w[N_FEATURES:].reshape(2, 2)
    return field


def train(docs: DataFrame, labels: DataFrame, max_train_rows: int = 2000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> LineField:
    """Fit on a bounded sample of labelled documents, half of each label as far as there are any."""
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null").distinct()
    order = F.xxhash64("id", "label")
    parts = [known.where(F.col("label") == q).orderBy(order, "id").limit(max_train_rows // 2) for q in (0, 1)]
    # bounded by max_train_rows
    chosen = F.broadcast(parts[0].unionAll(parts[1]))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").join(chosen, "id").orderBy(order, "text").limit(2 * max_train_rows)
    rows = bounded(rows, [order, "text"], MAX_TRAIN_BYTES).orderBy(order, "text")
    return fit([(r.text.encode(), r.label) for r in rows.select("text", "label").collect()])


def figures(docs: DataFrame, field: LineField, id_cols: list[Column], text_col: str = "text") -> DataFrame:
    """The id columns, the base figures, base_failed, kept and content_share of every row; one map over the scan."""
    names = [*BASE_FIELDS, "base_failed", "content_share", "kept"]
    types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
    fields = fields_of(docs, id_cols)
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        model = shared.value
        for b in batches:
            got = list(zip(*map(model.judge, texts_of(b)))) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(g, t) for g, t in zip(got, types))], [*b.schema.names[:-1], *names])

    return map_batches(with_text(docs, id_cols, text_col), run, f"{fields}, {', '.join(f'{n} long' for n in BASE_FIELDS)}, base_failed boolean, content_share double, kept boolean")


def keep_good(docs: DataFrame, field: LineField, text_col: str = "text") -> DataFrame:
    """The rows that the rules keep, with all their columns."""
    shared, at = docs.sparkSession.sparkContext.broadcast(field), docs.columns.index(text_col)

    def run(batches):
        model = shared.value
        for b in batches:
            yield b.filter(pa.array([model.judge(t)[-1] for t in texts_of(b, at)], pa.bool_()))

    return map_batches(docs, run, docs.schema)
