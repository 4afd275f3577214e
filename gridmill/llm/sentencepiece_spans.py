"""Offset-preserving SentencePiece encoding and decoding.

The model file is read as data: its compiled character map (a double-array trie
with the replacement strings behind it) drives a longest-prefix normalisation
that records, for every normalised byte, where it came from; byte-pair merges
then run on the normalised text, and each piece is projected through that
record to the byte span of the original text that it stands for.

Long texts need no long merges.  Where the model lets it (no map entry reaches
across a space, no piece has a space after another character), a text falls
apart at its spaces into chunks that encode on their own; a worker remembers the
(id, source length) pairs of recent chunks, and spans are running sums.
"""

from __future__ import annotations

import heapq
import re
from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The visible space of normalised text.
MARK = "▁"
_MARK = MARK.encode()
# Fixed values of the model format: kinds of pieces.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_REPLACEMENT = "�".encode()


def _fields(data: bytes):
    """(number, value) of each field of a protocol buffer message."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < end:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            size = varint()
            yield tag >> 3, data[at : at + size]
            at += size
        else:
            size = {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at : at + size]
            at += size


class CharacterMap:
    """The compiled map: ``longest(data, at)`` -> (bytes consumed, replacement) or None."""

    def __init__(self, blob: bytes) -> None:
        self.units, self.strings = [], b""
        if blob:
            size = int.from_bytes(blob[:4], "little")
            self.units = np.frombuffer(blob[4 : 4 + size], dtype="<u4").tolist()
            self.strings = blob[4 + size :]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        if not self.units:
            return None
        node, best = self._offset(self.units[0]), None
        for i in range(at, len(data)):
            node ^= data[i]
            unit = self.units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                best = (i + 1 - at, self.units[node] & 0x7FFFFFFF)
        if best is None:
            return None
        start = best[1]
        return best[0], self.strings[start : self.strings.index(b"\0", start)]

    def keys(self) -> list[bytes]:
        """Every key of the map."""
        if not self.units:
            return []
        found, todo = [], [(self._offset(self.units[0]), b"")]
        while todo:
            node, key = todo.pop()
            for c in range(1, 256):
                below = node ^ c
                if below < len(self.units) and (unit := self.units[below]) & 0x800000FF == c:
                    if unit >> 8 & 1:
                        found.append(key + bytes([c]))
                    todo.append((below ^ self._offset(unit), key + bytes([c])))
        return found


def _character(data: bytes, at: int) -> int:
    """Bytes of the well-formed character at ``at``, or 0."""
    first = data[at]
    size = 1 if first < 0x80 else 2 if 0xC2 <= first < 0xE0 else 3 if 0xE0 <= first < 0xF0 else 4 if 0xF0 <= first < 0xF5 else 0
    if size < 2:
        return size
    try:
        data[at : at + size].decode()
    except UnicodeDecodeError:
        return 0
    return size if at + size <= len(data) else 0


@dataclass
class Model:
    """A SentencePiece BPE model, read from its file's bytes."""

    data: bytes
    pieces: list[bytes] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        blob, kind, self.unk_surface = b"", 1, " ⁇ ".encode()
        self.dummy_prefix = self.squeeze = self.escape = True
        self.suffix = self.byte_fallback = False
        for number, value in _fields(self.data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b""))
                self.scores.append(float(np.frombuffer(piece.get(2, b"\0" * 4), dtype="<f4")[0]))
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
                kind = trainer.get(3, 1)
                self.suffix, self.byte_fallback = bool(trainer.get(24, 0)), bool(trainer.get(35, 0))
                self.unk_surface = trainer.get(44, self.unk_surface)
            elif number == 3:
                normal = dict(_fields(value))
                blob = normal.get(2, b"")
                self.dummy_prefix, self.squeeze, self.escape = (bool(normal.get(k, 1)) for k in (3, 4, 5))
        if kind != 2:
            raise ValueError("only BPE models are supported")
        if USER_DEFINED in self.kinds or UNUSED in self.kinds or self.suffix:
            raise ValueError("user-defined or unused pieces and suffix spaces are not supported")
        self.map = CharacterMap(blob)
        self.unk = self.kinds.index(UNKNOWN)
        self.lookup = {p.decode(): i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        order = {x: r for r, x in enumerate(sorted({self.scores[i] for i in self.lookup.values()}, reverse=True))}
        self.rank, self.no_rank = {p: order[self.scores[i]] for p, i in self.lookup.items()}, len(order)
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        chars = {c for p in self.lookup for c in p}
        self.alone = "".join(c for c in "\n\t\r" if c not in chars)
        across = any(b" " in k[1:] or _MARK in k[1:] or k[:1] == b" " for k in self.map.keys()) or any(c.encode() in k for k in self.map.keys() for c in self.alone)
        self.splits = self.dummy_prefix and not self.squeeze and self.escape and not across and not any(MARK in p.lstrip(MARK) for p in self.lookup)
        inner = f"[^ {MARK}{self.alone}]"
        self.chunks = re.compile((f"[{self.alone}]|" if self.alone else "") + f"[ {MARK}]+{inner}*|{inner}+")
        surface = [p.replace(_MARK, b" ") for p in self.pieces]
        for i, k in enumerate(self.kinds):
            if k in (CONTROL, UNKNOWN):
                surface[i] = self.unk_surface if k == UNKNOWN else b""
        for byte, i in self.byte_ids.items():
            surface[i] = bytes([byte])
        self.surface = surface

    # -- normalisation -----------------------------------------------------

    def _prefix(self, data: bytes, at: int) -> tuple[bytes, int]:
        if hit := self.map.longest(data, at):
            return hit[1], hit[0]
        size = _character(data, at)
        return (data[at : at + size], size) if size else (_REPLACEMENT, 1)

    def normalise(self, data: bytes, prefix: bool = True) -> tuple[bytes, list[int]]:
        """Normalised bytes and, for each of them and the end, its place in ``data``."""
        space = _MARK if self.escape else b" "
        if not self.map.units and not self.squeeze and data:
            try:
                data.decode()
                return self._identity(data, space, prefix)
            except UnicodeDecodeError:
                pass  # stray bytes are replaced below
        out, source, at = bytearray(), [], 0
        if self.squeeze:
            while at < len(data):
                text, size = self._prefix(data, at)
                if text != b" ":
                    break
                at += size
        if at >= len(data):
            return b"", [at]
        if prefix and self.dummy_prefix:
            out += space
            source += [at] * len(space)
        after_space = self.squeeze
        while at < len(data):
            text, size = self._prefix(data, at)
            while after_space and text[:1] == b" ":
                text = text[1:]
            if text:
                for c in text:
                    new = space if c == 32 else bytes([c])
                    out += new
                    source += [at] * len(new)
                after_space = text[-1:] == b" "
            at += size
            after_space = after_space and self.squeeze
        if self.squeeze:
            while out.endswith(space):
                del out[-len(space) :]
                at = source[len(out)]
                del source[len(out) :]
        return bytes(out), [*source, at]

    def _identity(self, data: bytes, space: bytes, prefix: bool) -> tuple[bytes, list[int]]:
        """``normalise`` where the map is empty: every character stands for itself, only spaces are written otherwise."""
        before = space if prefix and self.dummy_prefix else b""
        source, at, wide = [0] * len(before), 0, len(space)
        for n, word in enumerate(data.split(b" ")):
            if n:
                source += [at] * wide
                at += 1
            source += range(at, at + len(word))
            at += len(word)
        source.append(at)
        return before + data.replace(b" ", space), source

    # -- merges ------------------------------------------------------------

    def merge(self, text: str) -> list[str]:
        """Byte-pair merges: always the best-scored adjacent pair, the leftmost of equals."""
        parts, n = list(text), len(text)
        if n > 128:
            return self._merge_long(parts)
        rank, none = self.rank.get, self.no_rank
        ranks = [rank(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            parts[i] += parts.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] + parts[i], none)
            if i < len(ranks):
                ranks[i] = rank(parts[i] + parts[i + 1], none)
        return parts

    def _merge_long(self, parts: list[str]) -> list[str]:
        """The same with a heap of pairs, for long runs without a space."""
        n = len(parts)
        lookup, scores = self.lookup, self.scores
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(left: int, right: int) -> None:
            both = parts[left] + parts[right]
            if (i := lookup.get(both)) is not None:
                heap.append((-scores[i], left, right, len(both)))

        for i in range(n - 1):
            offer(i, i + 1)
        heapq.heapify(heap)
        while heap:
            _, left, right, size = heapq.heappop(heap)
            if not parts[left] or not parts[right] or len(parts[left]) + len(parts[right]) != size:
                continue
            parts[left] += parts[right]
            parts[right] = ""
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
            for a, b in ((before[left], left), (left, after[left])):
                if a >= 0 and b < n:
                    both = parts[a] + parts[b]
                    if (i := lookup.get(both)) is not None:
                        heapq.heappush(heap, (-scores[i], a, b, len(both)))
        return [p for p in parts if p]

    def _ids(self, piece: str) -> list[int]:
        i = self.lookup.get(piece)
        if i is not None:
            return [i]
        return [self.byte_ids[b] for b in piece.encode()] if self.byte_fallback else [self.unk]

    def encode_spans(self, data: bytes, prefix: bool = True) -> list[tuple[int, int, int]]:
        """(id, begin, end) of each piece; of an unknown character's bytes the last has its span."""
        normal, source = self.normalise(data, prefix)
        out, at, begin, lookup = [], 0, source[0], self.lookup
        for piece in self.merge(normal.decode()):
            at += len(piece) if piece.isascii() else len(piece.encode())
            end = source[at]
            last = lookup.get(piece)
            if last is None:
                *spelt, last = self._ids(piece)
                out += [(i, begin, begin) for i in spelt]
                if not spelt and last == self.unk and out and out[-1][0] == self.unk:
                    begin = out.pop()[1]
            out.append((last, begin, end))
            begin = end
        return out

    def decode_bytes(self, ids) -> bytes:
        """Surface bytes of ``ids``: spaces shown, the dummy prefix dropped."""
        table = self.surface
        raw = b"".join([table[i] for i in ids])
        if self.dummy_prefix or self.squeeze:
            first = next((i for i in ids if self.kinds[i] != CONTROL), None)
            if first is not None and self.kinds[first] == NORMAL and raw[:1] == b" ":
                raw = raw.lstrip(b" ") if self.squeeze else raw[1:]
        return raw

    def decode(self, ids) -> str:
        raw = self.decode_bytes(ids)
        try:
            return raw.decode()
        except UnicodeDecodeError:  # ids that no text encodes to: each stray byte on its own
            out, at = [], 0
            while at < len(raw):
                size = _character(raw, at)
                out.append(raw[at : at + size].decode() if size else "�")
                at += size or 1
            return "".join(out)


class Encoder:
    """Encodes texts with one model, remembering at most ``remember`` chunks."""

    def __init__(self, data: bytes, remember: int = 800_000) -> None:
        self.model = Model(data)
        self.memory = _Memory(self.model, remember)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, begins and ends (bytes of the text in UTF-8)."""
        if not text:
            none = np.zeros(0, dtype=np.int32)
            return none, none, none
        if not self.model.splits:
            rows = np.array(self.model.encode_spans(text.encode()), dtype=np.int32).reshape(-1, 3)
            return rows[:, 0], rows[:, 1], rows[:, 2]
        chunks = self.model.chunks.findall(" " + text)
        rows = np.frombuffer(b"".join(map(self.memory.__getitem__, chunks)), dtype=np.int32).reshape(-1, 2)
        ends = np.cumsum(rows[:, 1], dtype=np.int64) - 1  # the added space is no byte of the text
        begins = ends - rows[:, 1]
        begins[0] = max(0, int(begins[0]))
        return rows[:, 0], np.maximum(begins, 0).astype(np.int32), ends.astype(np.int32)


class _Memory(dict):
    """Recent chunks in two generations: a full one becomes the old one, and what is met there again moves up."""

    def __init__(self, model: Model, limit: int) -> None:
        self.model, self.limit, self.old = model, max(1, limit // 2), {}

    def __missing__(self, chunk: str) -> bytes:
        value = self.old.pop(chunk, None)
        if value is None:
            value = self._encoded(chunk)
        if len(chunk) <= 64:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[chunk] = value
        return value

    def _encoded(self, chunk: str) -> bytes:
        flat = array("i")
        for i, begin, end in self.model.encode_spans(chunk.encode(), prefix=False):
            flat.extend((i, end - begin))
        return flat.tobytes()


#: One encoder for each model in a Python worker, which serves many tasks.
_encoders: dict[int, Encoder] = {}


def encoder_of(data: bytes) -> Encoder:
    key = hash(data)
    if key not in _encoders:
        _encoders[key] = Encoder(data)
    return _encoders[key]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    values = np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32, copy=False)))


#: Characters of text that one outgoing batch stands for.
_BATCH_CHARS = 2_000_000


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", decode: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """``id, ids, begins, ends`` (and ``decoded``, from the ids alone) of every row, then the columns ``carry``.

    ``model`` is the content of a SentencePiece BPE model file (a fixed file, so
    it may be sent to every executor).  A null text counts as empty and has no
    pieces; other columns than ``carry`` are not carried; rows come out as often as they come
    in.  ``begins`` and ``ends`` are byte offsets into the text in UTF-8: the
    dummy prefix has an empty span, and of the pieces that spell one unknown
    character in bytes the last has the character's span.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def build(keys, found, carried):
        columns = [pa.array(keys, pa.int64()), *(_lists([f[k] for f in found]) for k in range(3))]
        if decode:
            held = encoder_of(sent.value).model
            columns.append(pa.array([held.decode(f[0].tolist()) for f in found], pa.string()))
        return pa.RecordBatch.from_arrays([*columns, *carried], names=["id", "ids", "begins", "ends", *["decoded"] * decode, *carry])

    def run(batches):
        encoder = encoder_of(sent.value)
        for batch in batches:
            keys, found, chars, at = [], [], 0, 0
            others = [batch.column(2 + i) for i in range(len(carry))]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                keys.append(key)
                found.append(encoder.encode(text))
                chars += len(text) + 1
                if chars >= _BATCH_CHARS:
                    yield build(keys, found, [c.slice(at, len(keys)) for c in others])
                    keys, found, chars, at = [], [], 0, at + len(keys)
            if keys:
                yield build(keys, found, [c.slice(at) for c in others])

    schema = "id long, ids array<int>, begins array<int>, ends array<int>" + ", decoded string" * decode
    schema += "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *carry).mapInArrow(run, schema)


def decode(encoded: DataFrame, model: bytes, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """``id, text`` from the ids of every row; null ids give an empty text."""
    sent = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        held = encoder_of(sent.value).model
        for batch in batches:
            texts = [held.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, "id long, text string")
