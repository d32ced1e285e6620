"""Encoding of a table of texts with a SentencePiece model, and decoding: one map over the scan, no shuffle.

The model file is read in each worker from its path (a parameter; every machine has it).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from .common import fields_of, map_batches, with_text
from .piece_codec import PieceCodec

_CODECS: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def encode(docs: DataFrame, path: str, id_cols: list[Column], add_end: bool = True, text_col: str = "text", decoded: bool = False) -> DataFrame:
    """The id columns, ids (int32), and the byte span of every piece in the source (the end id has an empty one).

    With decoded, the ids are decoded again and decoded_sha256 is the digest of the text they give.
    """

    def run(batches):
        c = codec(path)
        for b in batches:
            parts, digests = [], []
            for t in b.column(b.num_columns - 1).to_pylist():
                i, s, e = (x.astype(np.int32, copy=False) for x in c.encode_parts(t or ""))
                if add_end:
                    last = e[-1:] if len(e) else np.zeros(1, np.int32)
                    i, s, e = np.append(i, np.int32(c.end)), np.append(s, last), np.append(e, last)
                parts.append((i, s, e))
                if decoded:
                    digests.append(hashlib.sha256(c.decode_bytes(i)).hexdigest())
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(i) for i, _, _ in parts])]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([p[k] for p in parts] or [np.zeros(0, np.int32)]))) for k in range(3)]
            more = [pa.array(digests, pa.string())] if decoded else []
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *lists, *more], [*b.schema.names[:-1], "ids", "begins", "ends", *["decoded_sha256"] * decoded])

    fields = f"{fields_of(docs, id_cols)}, ids array<int>, begins array<int>, ends array<int>" + ", decoded_sha256 string" * decoded
    return map_batches(with_text(docs, id_cols, text_col), run, fields)


def decode(encoded: DataFrame, path: str, id_cols: list[Column], ids_col: str = "ids") -> DataFrame:
    """The id columns and the text of every row of ids."""

    def run(batches):
        c = codec(path)
        for b in batches:
            texts = [c.decode(i or []) for i in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], [*b.schema.names[:-1], "text"])

    return map_batches(with_text(encoded, id_cols, ids_col), run, f"{fields_of(encoded, id_cols)}, text string")


def digest(docs: DataFrame, path: str, id_cols: list[Column], text_col: str = "text") -> DataFrame:
    """Encoded with the end id and decoded again, as digests: n_tokens, ids_sha256, decoded_sha256, and covered_bytes, the source bytes that spans cover."""

    def run(batches):
        c = codec(path)
        for b in batches:
            out: list[list] = [[], [], [], []]
            for t in b.column(b.num_columns - 1).to_pylist():
                ids, starts, ends = c.encode_parts(t or "")
                whole = np.append(ids, c.end)
                out[0].append(len(whole))
                out[1].append(hashlib.sha256(c.decimals(whole)).hexdigest())
                out[2].append(hashlib.sha256(c.decode_bytes(whole)).hexdigest())
                out[3].append(int((ends - starts).sum()))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string()), pa.array(out[3], pa.int64())],
                [*b.schema.names[:-1], "n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes"],
            )

    return map_batches(with_text(docs, id_cols, text_col), run, f"{fields_of(docs, id_cols)}, n_tokens long, ids_sha256 string, decoded_sha256 string, covered_bytes long")
