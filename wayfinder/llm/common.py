"""Shared parts: Arrow batch mapping, vectorised word splitting and hashing, stable storage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType, VariantType

#: Rows and bytes of an Arrow batch, where the session sets neither: they bound what a Python worker holds besides one text.
BATCH_ROWS, BATCH_BYTES = 256, 4 << 20
#: Texts are put together up to this many bytes for one vectorised pass.
SLICE_BYTES = 1 << 18

WORD_SEPARATORS = b" \t\n\x0b\x0c\r"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(WORD_SEPARATORS)] = True

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small where the session has not said how large they may be; the setting holds for the whole session."""
    given = spark.conf.getAll
    for key, value in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        if (key := f"spark.sql.execution.arrow.{key}") not in given:
            spark.conf.set(key, str(value))


def map_batches(df: DataFrame, fn: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    small_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def with_text(docs: DataFrame, id_cols: list[Column], text_col: str) -> DataFrame:
    """The id columns and last the text, under a name that none of them has."""
    ids = docs.select(*id_cols).columns
    return docs.select(*id_cols, F.col(text_col).alias(unused("text", ids)))


def fields_of(docs: DataFrame, id_cols: list[Column]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*id_cols).schema)


def unused(name: str, taken: Iterable[str]) -> str:
    """The name, with underscores until no column has it (in any case of letters)."""
    have = {t.lower() for t in taken}
    while name.lower() in have:
        name += "_"
    return name


def row_hash(df: DataFrame, columns: list[str], seed: int) -> Column:
    """64 bits of the columns' values, of any types; nulls count. Different seeds give independent bits."""
    parts: list[Column] = []
    for c in columns:
        col, kind = F.col(f"`{c}`"), df.schema[c].dataType
        # within nested values a hash would pass over nulls, and maps have none
        col = F.to_json(F.struct(col.alias("v")), {"ignoreNullFields": "false"}) if isinstance(kind, (ArrayType, MapType, StructType, VariantType)) else col
        parts += [col, col.isNull()]
    return F.xxhash64(F.lit(seed), *parts)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; in local mode a temporary one where the session names none."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = getattr(spark.sparkContext, "_llm_shared_dir", None)
        if at is None:
            folder = tempfile.mkdtemp(prefix="llm-shared-")
            atexit.register(shutil.rmtree, folder, True)
            at = spark.sparkContext._llm_shared_dir = f"file://{folder}"
    return at.rstrip("/")


_MADE: list[list[DataFrame]] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: later jobs neither recompute it nor lose it with an executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    for made in _MADE:
        made.append(out)
    return out


def forget(df: DataFrame) -> None:
    """Delete what stored() wrote for df, if it did, once nothing will read it again."""
    if hasattr(df, "_stored_at"):
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def last_one_stays() -> Iterator[None]:
    """Of what is stored inside, only the last outlives it: a result, written, and what led to it."""
    made: list[DataFrame] = []
    _MADE.append(made)
    try:
        yield
    finally:
        _MADE.remove(made)
    for df in made[:-1]:
        forget(df)


def bounded(sample: DataFrame, order: list[Column | str], max_bytes: int, text_col: str = "text") -> DataFrame:
    """The first rows of a sample of bounded length, up to max_bytes of text."""
    upto = F.sum(F.octet_length(text_col)).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return sample.withColumn("upto", upto).where(F.col("upto") <= max_bytes).drop("upto")


def id_fold(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as an empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def texts_of(batch: pa.RecordBatch, at: int = -1) -> list[bytes]:
    """The texts of the column at that place, the last as a rule, as UTF-8; nulls as empty."""
    col = batch.column(at if at >= 0 else batch.num_columns + at)
    return [x or b"" for x in col.cast(pa.binary() if pa.types.is_string(col.type) else pa.large_binary()).to_pylist()]


def slices(texts: list[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` bytes together; one longer text stands alone."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that are no ASCII white space."""
    space = np.ones(len(buf) + 2, bool)
    space[1:-1] = IS_SPACE[buf]
    edges = np.flatnonzero(space[1:] != space[:-1])
    return edges[0::2], edges[1::2]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    have, step = 1, base
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(step)
        have += more
        step = step * step & _MASK
    return out


_POWERS: dict[int, np.ndarray] = {}


def _kept_powers(base: int, n: int) -> np.ndarray:
    if n > SLICE_BYTES + 1:
        return _powers(base, n)
    if base not in _POWERS:
        _POWERS[base] = _powers(base, SLICE_BYTES + 1)
    return _POWERS[base][:n]


def _byte_values(lower: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    if lower:
        values[65:91] = values[97:123]
    return values


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit (the splitmix64 finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


VALUES = _byte_values(False)
LOWER_VALUES = _byte_values(True)


def hash_sums(buf: np.ndarray, lower: bool = False) -> np.ndarray:
    """Running sums from which span_hashes takes the hash of any span (A-Z as a-z if lower)."""
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((LOWER_VALUES if lower else VALUES)[buf] * _kept_powers(_BASE, len(buf)), out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, wherever in the buffer the span is."""
    back = _kept_powers(_BASE_INVERSE, len(sums))
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer with a line feed after each text, and the offsets of the texts (and of the end)."""
    buf = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    return buf, np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts]))).astype(np.int64)


def log_sigmoid_fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by damped Newton steps on standardised columns: mean, scale, weights (the last is the constant)."""
    mean, scale = np.average(x, axis=0, weights=weight), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    eye = np.eye(len(w)) * ridge * weight.sum()
    eye[-1, -1] = 1e-9 * weight.sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        grad = z.T @ (weight * (p - y)) + eye @ w
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + eye
        step = np.linalg.solve(hess + 1e-9 * np.eye(len(w)), grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w
