"""Offset-preserving SentencePiece encoding (BPE models with byte fallback), and decoding.

A text is normalised by taking, at each position, the longest prefix that the model's compiled character map knows;
for every normalised byte the position it came from is kept. The normalised text is merged into pieces, and each
piece is projected back to the bytes of the source that it stands for. Merges cannot cross from a character to a
following space mark, nor a newline that no piece holds, so segments between those are merged once and remembered.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .scratch import ship

MARK = "▁"
#: Remembered segments of a worker in each of two generations; and characters from which merging uses a heap.
REMEMBERED, LONG = 100_000, 48
#: Kinds of pieces in a model.
NORMAL, UNKNOWN, USER_DEFINED, UNUSED, BYTE = 1, 2, 4, 5, 6


class CharacterMap:
    """The compiled map of a model: a double-array trie of source strings, and their replacements.

    A unit holds 8 bits of label, a bit that says a value follows, and the offset of its children.
    """

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob, np.uint32, size // 4, 4).tolist()
        self.texts = blob[4 + size :]

    @staticmethod
    def _children(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement of the longest known prefix of data from at on, and the length of that prefix."""
        units, found = self.units, None
        if not units:
            return None
        node = self._children(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units) or units[node] & 0x800000FF != data[i]:
                break
            unit = units[node]
            node ^= self._children(unit)
            if unit & 256:
                found = units[node] & 0x7FFFFFFF, i + 1 - at
        if found is None:
            return None
        start, length = found
        return self.texts[start : self.texts.index(b"\0", start)], length


class PieceModel:
    """A model file: normalise(), encode() with spans, decode()."""

    def __init__(self, blob: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(blob)
        spec, self.library = proto.normalizer_spec, sentencepiece.SentencePieceProcessor(model_proto=blob)
        kinds = [p.type for p in proto.pieces]
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or {USER_DEFINED, UNUSED} & set(kinds):
            raise ValueError("only BPE models with byte fallback and without user-defined or unused pieces are supported")
        self.map = CharacterMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.suffix = proto.trainer_spec.treat_whitespace_as_suffix
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        #: The order of merges: a higher score first.
        scores = {p.piece: -p.score for p in proto.pieces if p.type == NORMAL}
        self.rank = scores
        self.bytes = np.zeros(256, np.int32)
        self.size = np.zeros(len(kinds), np.int64)
        for i, p in enumerate(proto.pieces):
            self.size[i] = 1 if p.type == BYTE else len(p.piece.encode())
            if p.type == BYTE:
                self.bytes[int(p.piece[3:5], 16)] = i
        # of a piece in a text that is its own normal form: a mark stands for one space
        self.plain = self.size - 2 * np.array([p.piece.count(MARK) if p.type == NORMAL else 0 for p in proto.pieces])
        several = [p for p in self.ids if len(p) > 1]
        inert = "\n" if not any("\n" in p for p in several) else ""
        joined = any(re.search(f"[^{MARK}]{MARK}", p) for p in several) or not self.escape
        self.split = None if joined else re.compile(f"{MARK}*[^{MARK}{inert}]+|{MARK}+" + (f"|{inert}" if inert else ""))
        self.identity = self.map is None and not self.squeeze and self.escape and self.prefix and not self.suffix
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes, and its end, the source byte it begins at."""
        data, out, where, at = text.encode(), bytearray(), [], 0
        space = MARK.encode() if self.escape else b" "

        def prefix(i: int) -> tuple[bytes, int]:
            found = self.map.longest(data, i) if self.map else None
            if found is None:
                n = 1 + (data[i] >= 0xC0) + (data[i] >= 0xE0) + (data[i] >= 0xF0)
                found = data[i : i + n], n
            return found

        def put(b: bytes, i: int) -> None:
            out.extend(b)
            where.extend([i] * len(b))

        while self.squeeze and at < len(data):
            b, n = prefix(at)
            if b != b" ":
                break
            at += n
        if at >= len(data):
            return "", np.array([at])
        if self.prefix and not self.suffix:
            put(space, at)
        after_space = self.squeeze
        while at < len(data):
            b, n = prefix(at)
            if after_space:
                b = b.lstrip(b" ")
            if b:
                put(b.replace(b" ", space), at)
                after_space = b.endswith(b" ")
            at += n
            after_space &= self.squeeze
        if self.squeeze:
            while out.endswith(space):
                del out[-len(space) :]
                at = where[len(out)]
                del where[len(out) :]
        if self.prefix and self.suffix:
            put(space, at)
        return out.decode(errors="replace"), np.array([*where, at], np.int64)

    def merge(self, segment: str) -> bytes:
        """The ids of a segment's pieces, as bytes."""
        parts = list(segment)
        if len(parts) < LONG:
            rank, none = self.rank.get, math.inf
            ranks = [rank(x + y, none) for x, y in zip(parts, parts[1:], strict=False)]
            while ranks and (best := min(ranks)) < none:
                i = ranks.index(best)
                parts[i] += parts.pop(i + 1)
                del ranks[i]
                if i < len(ranks):
                    ranks[i] = rank(parts[i] + parts[i + 1], none)
                if i:
                    ranks[i - 1] = rank(parts[i - 1] + parts[i], none)
        else:
            parts = self._merge_long(parts)
        ids, out = self.ids, []
        for p in parts:
            i = ids.get(p)
            if i is None:
                out.extend(self.bytes[list(p.encode())].tolist())
            else:
                out.append(i)
        return np.array(out, np.int32).tobytes()

    def _merge_long(self, parts: list[str]) -> list[str]:
        n, rank = len(parts), self.rank
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n and (r := rank.get(both := parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (r, i, j, both))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if not parts[i] or not parts[j] or right[i] != j or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, ""
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [p for p in parts if p]

    def pieces(self, normal: str) -> np.ndarray:
        """The ids of a normalised text."""
        young, old, out = self.young, self.old, []
        for segment in self.split.findall(normal) if self.split else [normal] if normal else []:
            ids = young.get(segment)
            if ids is None:
                ids = old.get(segment)
                if ids is None:
                    ids = self.merge(segment)
                if len(segment) < 2 * LONG:
                    young[segment] = ids
                    if len(young) >= REMEMBERED:
                        self.old = old = young
                        self.young = young = {}
            out.append(ids)
        return np.frombuffer(b"".join(out), np.int32)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the whole text, and the source bytes from which and below which each piece comes."""
        if not text:
            return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32)
        if self.identity and MARK not in text:
            ids = self.pieces(MARK + text.replace(" ", MARK))
            ends = np.cumsum(self.plain[ids]) - 1
        else:
            normal, where = self.normalise(text)
            ids = self.pieces(normal)
            ends = where[np.cumsum(self.size[ids])]
        starts = np.concatenate([ends[:1] * 0, ends[:-1]])
        return ids, starts.astype(np.int32), ends.astype(np.int32)

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist())


_loaded: dict[str, PieceModel] = {}


def _model(name: str) -> PieceModel:
    if name not in _loaded:
        with open(SparkFiles.get(name), "rb") as f:
            _loaded[name] = PieceModel(f.read())
    return _loaded[name]


def encode(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", spans: bool = True, decoded: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, ids[, starts, ends][, decoded]) per row of docs; model is the path of a model file at the driver.

    starts and ends are byte offsets in the UTF-8 text; a piece of a fallback byte spans that byte, the added prefix no
    bytes. decoded is the library's decode(ids). Null and empty texts have no pieces. Repeated rows give repeated rows,
    an empty table none; only the columns named are read. Bytes that aren't UTF-8 count as U+FFFD.
    """
    ship(docs.sparkSession)
    name = model.rsplit("/", 1)[-1]
    docs.sparkSession.sparkContext.addFile(model)
    kept = len(keep)
    kind = F.col(text).cast("string").cast("binary").alias("__text")
    picked = docs.select(F.col(doc_id).alias("doc_id"), *(F.col(c) for c in keep), kind)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1]), "ids array<int>", *(["starts array<int>", "ends array<int>"] if spans else []), *(["decoded string"] if decoded else [])])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _model(name)
        for batch in batches:
            last = batch.column(1 + kept)
            size = pc.fill_null(pc.binary_length(last), 0).to_numpy(zero_copy_only=False)
            offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
            for i, j in K.runs(offsets):
                found = [pieces.encode(x.decode(errors="replace") if x else "") for x in last.slice(i, j - i).to_pylist()]
                n = [len(x[0]) for x in found]
                columns = [*(c.slice(i, j - i) for c in batch.columns[: 1 + kept])]
                columns += [K.lists(np.concatenate([x[k] for x in found]), n, pa.int32()) for k in range(3 if spans else 1)]
                if decoded:
                    columns.append(pa.array([pieces.decode(x[0]) for x in found], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *keep, "ids", *(["starts", "ends"] if spans else []), *(["decoded"] if decoded else [])])

    return picked.mapInArrow(each, schema)
