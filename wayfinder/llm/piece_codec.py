"""SentencePiece BPE encoding that keeps source offsets, and decoding.

Encoding has three steps. Normalisation takes, at each byte, the longest prefix that the model's
compiled character map (a double-array trie) has, or else one character, and notes for every byte of
the result where in the source it came from; then white space is escaped. The result is cut before each
run of U+2581 that follows another character: where no piece spans such a place (checked against the
vocabulary) merges cannot either, so the cut is exact, and equal segments are encoded once. Last, every
piece is projected through the noted positions to its byte span in the source.

Merges of a segment come from the sentencepiece library where the model's character map is empty (a
segment's normal form is then itself), and else from `merge`, which does the same in Python.

Memory: a worker keeps segments of about `CACHE_BYTES` together, and starts anew when they are full; texts are cut into chunks of about `CHUNK` characters at
segment borders. Defined results: null and empty texts have no pieces, only the end id where asked for;
characters without a piece become byte pieces, or the unknown id without byte fallback.
"""

from __future__ import annotations

import heapq
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

SPACE = "▁"
CACHE_BYTES = 8 << 20
#: What an entry takes besides the characters and ids that it holds: two objects and a place in the table.
ENTRY_BYTES = 200
CHUNK = 1 << 20
BPE = 2
_SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def wire(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = varint() if kind == 2 else 8 if kind == 1 else 4
            yield key >> 3, data[at : at + n]
            at += n


@dataclass
class CharMap:
    """The compiled character map: a double-array trie over UTF-8 bytes whose values point at replacements."""

    units: tuple[int, ...] = ()
    texts: bytes = b""

    @classmethod
    def parse(cls, blob: bytes) -> CharMap:
        if not blob:
            return cls()
        (size,) = struct.unpack_from("<I", blob)
        return cls(struct.unpack_from(f"<{size // 4}I", blob, 4), blob[4 + size :])

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest prefix of data[at:] in the map."""
        if not self.units:
            return None
        found, node = None, self._offset(self.units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(self.units) or self.units[node] & 0x800000FF != data[i]:
                break
            unit = self.units[node]
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = i + 1 - at, self.units[node] & 0x7FFFFFFF
        return found and (found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])])

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 512) >> 6)


@dataclass
class PieceModel:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    char_map: CharMap = field(default_factory=CharMap)
    model_type: int = 1
    byte_fallback: bool = False
    dummy_prefix: bool = True
    strip_spaces: bool = True
    escape: bool = True
    suffix_space: bool = False

    @classmethod
    def load(cls, path: str) -> PieceModel:
        m = cls()
        with open(path, "rb") as f:
            data = f.read()
        for number, value in wire(data):
            if number == 1:
                piece = dict(wire(value))
                m.pieces.append(piece.get(1, b"").decode())
                m.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                m.kinds.append(piece.get(3, 1))
            elif number == 2:
                spec = dict(wire(value))
                m.model_type, m.byte_fallback, m.suffix_space = spec.get(3, 1), bool(spec.get(35, 0)), bool(spec.get(24, 0))
            elif number == 3:
                spec = dict(wire(value))
                m.char_map = CharMap.parse(spec.get(2, b""))
                m.dummy_prefix, m.strip_spaces, m.escape = (bool(spec.get(i, 1)) for i in (3, 4, 5))
        if m.model_type != BPE:
            raise ValueError("only BPE models are supported")
        if m.suffix_space or not m.escape or any(k in (4, 5) for k in m.kinds):
            raise ValueError("models with user-defined or unused pieces, suffixed or unescaped spaces are not supported")
        return m


def normalise(data: bytes, model: PieceModel) -> tuple[bytes, np.ndarray]:
    """The normal form and, for each of its bytes and its end, the source position it came from."""
    mark = SPACE.encode()
    out, origin, at = bytearray(), [], 0
    if not model.char_map.units and not model.strip_spaces:
        if not data:
            return b"", np.zeros(1, np.int64)
        src = np.frombuffer(data, np.uint8)
        origin = np.repeat(np.arange(len(src)), np.where(src == 32, 3, 1))
        lead = mark if model.dummy_prefix else b""
        return lead + data.replace(b" ", mark), np.concatenate([np.zeros(len(lead), np.int64), origin, [len(src)]])

    def step(at: int) -> tuple[int, bytes]:
        hit = model.char_map.longest(data, at)
        if hit:
            return hit
        first = data[at]
        return (n := 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4), data[at : at + n]

    if model.strip_spaces:
        while at < len(data):
            n, text = step(at)
            if text != b" ":
                break
            at += n
    if at == len(data):
        return b"", np.full(1, at, np.int64)
    if model.dummy_prefix:
        out += mark
        origin += [at] * 3
    after_space = model.strip_spaces
    while at < len(data):
        n, text = step(at)
        if after_space:
            text = text.lstrip(b" ")
        for c in text:
            new = mark if c == 32 else bytes([c])
            out += new
            origin += [at] * len(new)
        if text:
            after_space = model.strip_spaces and text.endswith(b" ")
        at += n
    if model.strip_spaces:
        while out.endswith(mark):
            del out[-3:]
            at = origin[-3]
            del origin[-3:]
    return bytes(out), np.array([*origin, at], np.int64)


def merge(segment: str, rank: dict[str, float]) -> list[str]:
    """Join the neighbouring pair of the best score, leftmost first, until none is a piece."""
    text, n = list(segment), len(segment)
    prev, nxt = list(range(-1, n - 1)), [*range(1, n), -1]
    queue: list[tuple[float, int, int, str]] = []

    def offer(a: int, b: int) -> None:
        if a >= 0 and b >= 0 and (s := rank.get(text[a] + text[b])) is not None:
            heapq.heappush(queue, (-s, a, b, text[a] + text[b]))

    for i in range(n - 1):
        offer(i, i + 1)
    while queue:
        _, a, b, made = heapq.heappop(queue)
        if not text[a] or not text[b] or text[a] + text[b] != made or nxt[a] != b:
            continue
        text[a], text[b] = made, ""
        nxt[a] = nxt[b]
        if nxt[b] >= 0:
            prev[nxt[b]] = a
        offer(prev[a], a)
        offer(a, nxt[a])
    return [t for t in text if t]


class PieceCodec:
    """Encoder and decoder of one model file; made in each worker."""

    def __init__(self, path: str, library: bool = True):
        import sentencepiece

        self.model = m = PieceModel.load(path)
        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids = {p: i for i, (p, k) in enumerate(zip(m.pieces, m.kinds)) if k == 1}
        self.rank = {p: m.scores[i] for p, i in self.ids.items()}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(m.pieces, m.kinds)) if k == 6}
        self.unknown, self.end = m.kinds.index(2), self.processor.eos_id()
        self.sizes = np.array([1 if k == 6 else len(p.encode()) for p, k in zip(m.pieces, m.kinds)], np.int32)
        self.splits = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.library = library and not m.char_map.units and m.dummy_prefix and not m.strip_spaces and m.byte_fallback and self.splits and SPACE in self.ids
        self.fixed_sizes = m.byte_fallback
        self.leads = np.array([p.startswith(SPACE) for p in m.pieces])
        self.source_sizes = (self.sizes - 2 * np.array([p.count(SPACE) for p in m.pieces])).astype(np.int32)
        self.names = table([b"%d " % i for i in range(len(m.pieces))])
        self.silent = np.array([k == 3 for k in m.kinds])
        raw = [b"" if k == 3 else bytes([int(p[3:5], 16)]) if k == 6 else p.replace(SPACE, " ").encode() for i, (p, k) in enumerate(zip(m.pieces, m.kinds))]
        raw[self.unknown] = b"\xff"  # never valid: left to the library
        self.outputs = table(raw)
        self.cache: dict[str, bytes] = {}
        self.cached = 0

    def _pieces(self, segment: str) -> tuple[list[int], list[int]]:
        """Ids and byte lengths in the normal form."""
        ids, sizes = [], []
        for piece in merge(segment, self.rank):
            raw = piece.encode()
            if piece in self.ids:
                ids.append(self.ids[piece])
                sizes.append(len(raw))
            elif self.model.byte_fallback:
                ids += [self.bytes[b] for b in raw]
                sizes += [1] * len(raw)
            elif ids and ids[-1] == self.unknown:
                sizes[-1] += len(raw)
            else:
                ids.append(self.unknown)
                sizes.append(len(raw))
        return ids, sizes

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids (int32 bytes) of words that each follow one mark, from the kept ones or from the library."""
        found = list(map(self.cache.get, words))
        if None not in found:
            return found
        new = list({w: None for w, f in zip(words, found) if f is None})
        made: dict[str, bytes] = {}
        for at in range(0, len(new), 256):
            part = new[at : at + 256]
            ids = np.array(self.processor.encode(" ".join(part)), np.int32)
            # a word's first piece, and no other, starts with the mark
            cuts = [*np.flatnonzero(self.leads[ids]).tolist(), len(ids)]
            made.update((w, ids[a:b].tobytes()) for w, a, b in zip(part, cuts, cuts[1:]))
        for w, i in made.items():
            self._keep(w, i)
        return [made[w] if f is None else f for w, f in zip(words, found)]

    def _segment(self, segment: str) -> bytes:
        got = self.cache.get("\0" + segment)
        if got is None:
            got = array("i", self.processor.encode(segment[1:]) if self.library and len(segment) > 1 else self._pieces(segment)[0]).tobytes()
            self._keep("\0" + segment, got)
        return got

    def _keep(self, segment: str, ids: bytes) -> None:
        if len(segment) > 32:
            return
        self.cached += ENTRY_BYTES + len(segment) + len(ids)
        if self.cached > CACHE_BYTES:
            self.cache, self.cached = {}, ENTRY_BYTES + len(segment) + len(ids)
        self.cache[segment] = ids

    def _ids(self, text: str) -> np.ndarray:
        """Ids of a normal form."""
        if not self.splits:
            return np.array(self._pieces(text)[0], np.int32)
        parts, at = [], 0
        while at < len(text):
            to = min(len(text), at + CHUNK)
            if to < len(text):
                cut = text.rfind(SPACE, at + 1, to)
                while cut > at and text[cut - 1] == SPACE:
                    cut -= 1
                if cut <= at:  # no border in the chunk: take the next one
                    cut = to
                    while cut < len(text) and (text[cut] != SPACE or text[cut - 1] == SPACE):
                        cut += 1
                to = cut
            words = text[at + 1 : to].split(SPACE) if self.library and text[at] == SPACE else [""]
            if "" in words:  # runs of the mark, or none at the start
                parts += map(self._segment, _SEGMENT.findall(text, at, to))
            else:
                parts += self._words(words)
            at = to
        return np.frombuffer(b"".join(parts), np.int32)

    def encode_parts(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and the starts and ends of their spans in the source's UTF-8 bytes (a text has below 2^31 of them)."""
        if self.library and text and SPACE not in text:
            # the map is empty: a mark is one source byte, but the first is none
            ids = self._ids(SPACE + text.replace(" ", SPACE))
            ends = np.cumsum(self.source_sizes[ids], dtype=np.int64) - 1
            return ids, np.concatenate([[0], ends[:-1]]), ends
        normal, origin = normalise(text.encode(), self.model)
        form = normal.decode()
        if self.fixed_sizes:
            ids = self._ids(form)
            sizes = self.sizes[ids]
        else:  # an unknown id stands for any number of bytes
            got = [self._pieces(s) for s in (_SEGMENT.findall(form) if self.splits else [form] if form else [])]
            ids, sizes = (np.array([x for g in got for x in g[k]], np.int32) for k in (0, 1))
        ends = np.cumsum(sizes, dtype=np.int64)
        return ids, origin[ends - sizes], origin[ends]

    def decimals(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by one space."""
        return gather(*self.names, ids)[:-1]

    def encode(self, text: str, add_end: bool = False) -> list[int]:
        ids = self.encode_parts(text)[0].tolist()
        return [*ids, self.end] if add_end else ids

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        ids, starts, ends = self.encode_parts(text)
        return list(zip(ids.tolist(), starts.tolist(), ends.tolist()))

    def count(self, text: str) -> int:
        normal = normalise(text.encode(), self.model)[0] if self.model.char_map.units or self.model.strip_spaces else None
        normal = (SPACE * self.model.dummy_prefix + text.replace(" ", SPACE) if text else "") if normal is None else normal.decode()
        return len(self._ids(normal)) if normal and self.fixed_sizes else len(self.encode_parts(text)[0])

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The decoded text in UTF-8, as the library's decode gives it."""
        plain = gather(*self.outputs, ids)
        simple = len(ids) and self.leads[ids[0]] and not self.silent[ids[:-1]].any()
        if simple and self.model.dummy_prefix and not self.model.strip_spaces:
            try:
                plain.decode()
                return plain[1:]
            except UnicodeDecodeError:
                pass
        return self.processor.decode(ids.tolist()).encode()

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(np.array(ids, np.int64)).decode()


def table(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte strings as one buffer with their starts and lengths."""
    sizes = np.array([len(t) for t in texts], np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes) - sizes, sizes


def gather(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> bytes:
    """The chosen byte strings of a table, put together."""
    out = []
    for at in range(0, len(which), CHUNK):
        part = which[at : at + CHUNK]
        n = sizes[part]
        ends = np.cumsum(n)
        out.append(buf[np.arange(ends[-1]) + np.repeat(starts[part] - (ends - n), n)].tobytes())
    return b"".join(out)
