"""SentencePiece encoding and decoding that keeps, for every piece, the bytes of the source it came from.

The text is normalised here: the longest prefix known to the model's compiled character map is replaced, white
space is escaped, and each normalised byte records the source byte it stems from. A copy of the model without its
normaliser then merges the pieces, and the lengths of the pieces, laid along the recorded alignment, give source spans.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.words import PieceCache, cut_points, flat_lists, row_slices, text_bytes

MARK = b"\xe2\x96\x81"  # U+2581, the escaped space
_UNKNOWN, _USER_DEFINED, _BYTE = 2, 4, 6


class Encoded(NamedTuple):
    """Pieces of a run of texts: ``ids[first[d]:first[d + 1]]``, each with its span of source bytes."""

    ids: np.ndarray
    first: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    codec: PieceCodec


class CharMap:
    """A compiled character map: a double-array trie over source bytes, and the replacements it points to."""

    def __init__(self, compiled: bytes):
        size = int.from_bytes(compiled[:4], "little")
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist()
        self.texts = compiled[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest known prefix of ``text[at:]``, and its replacement."""
        units, found = self.units, None
        node = 0 ^ _offset(units[0])
        for i in range(at, len(text)):
            node ^= text[i]
            unit = units[node] if node < len(units) else 0
            if unit & 0x800000FF != text[i]:
                break
            node ^= _offset(unit)
            if unit >> 8 & 1:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])]


def _offset(unit: int) -> int:
    return unit >> 10 << ((unit & 0x200) >> 6)


class PieceCodec:
    """Encoder and decoder of one serialised model; made once per task."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        kinds = np.array([p.type for p in proto.pieces])
        if (kinds == _USER_DEFINED).any() or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("models with user-defined pieces or white space as suffix are not supported")
        self.spec = type(proto.normalizer_spec)()
        self.spec.CopyFrom(proto.normalizer_spec)
        self.char_map = CharMap(self.spec.precompiled_charsmap) if self.spec.precompiled_charsmap else None
        self.space = MARK if self.spec.escape_whitespaces else b" "
        pieces = [p.piece.encode() for p in proto.pieces]
        self.sizes = np.array([1 if k == _BYTE else len(p) for p, k in zip(pieces, kinds)], np.int64)
        self.unknown = int(np.flatnonzero(kinds == _UNKNOWN)[0])
        # No merge crosses from a word into the next mark, unless some piece holds such a place.
        self.by_word = proto.trainer_spec.model_type == 2 and not any(
            p[i] not in MARK and p.startswith(self.space, i + 1) for p in pieces for i in range(len(p) - 1)
        )
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=model)
        bare = proto.normalizer_spec
        bare.precompiled_charsmap = b""
        bare.add_dummy_prefix = bare.remove_extra_whitespaces = bare.escape_whitespaces = False
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.cache = PieceCache(
            lambda pieces: flat_lists(self.bare.encode([p.decode("utf-8", "replace") for p in pieces], num_threads=1))
        )

    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them (and the end) the offset of its source byte."""
        if self.char_map is None and not self.spec.remove_extra_whitespaces:
            source = np.frombuffer(text, np.uint8)
            width = np.where(source == 0x20, len(self.space), 1)
            lead = self.space if text and self.spec.add_dummy_prefix else b""
            at = np.repeat(np.arange(len(source)), width)
            return lead + text.replace(b" ", self.space), np.concatenate([np.zeros(len(lead), np.int64), at, [len(source)]])
        parts, at, i = [], [], 0
        while i < len(text):
            hit = self.char_map.longest(text, i) if self.char_map else None
            taken, new = hit or (_char_size(text[i]), text[i : i + _char_size(text[i])])
            same = new == text[i : i + taken]
            parts.append(new)
            at += [i + j if same else i for j in range(len(new))]
            i += taken
        return self._escape(b"".join(parts), at + [len(text)])

    def _escape(self, plain: bytes, at: list[int]) -> tuple[bytes, np.ndarray]:
        if self.spec.remove_extra_whitespaces:
            keep = [b != 0x20 or (i > 0 and plain[i - 1] != 0x20) for i, b in enumerate(plain)]
            last = len(plain.rstrip(b" "))
            chosen = [i for i in range(last) if keep[i]]
            at = [at[i] for i in chosen] + [at[last]]
            plain = bytes(plain[i] for i in chosen)
        out, source = bytearray(), []
        if plain and self.spec.add_dummy_prefix:
            out += self.space
            source += [at[0]] * len(self.space)
        for b, origin in zip(plain, at):
            new = self.space if b == 0x20 else bytes([b])
            out += new
            source += [origin] * len(new)
        return bytes(out), np.array([*source, at[-1]], np.int64)

    def encode(self, column: pa.Array) -> Encoded:
        """Ids with begin and end ids; these two have empty spans at the ends of the text."""
        data, text_at = text_bytes(column)
        raw = data.tobytes()
        texts, maps = zip(*(self.normalise(raw[a:b]) for a, b in zip(text_at[:-1], text_at[1:])))
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        normal = np.frombuffer(b"".join(texts), np.uint8)
        ids, counts = self.cache.ids(normal, self._cuts(normal, np.append(0, ends)))
        size = self.sizes[ids]
        if (ids == self.unknown).any() or size.sum() != len(normal):
            raise ValueError("the model lacks byte pieces for unknown characters")
        after = np.cumsum(size)
        doc = np.searchsorted(ends, after - size, side="right")
        source = np.concatenate(maps)
        shift = np.arange(len(texts))  # each map has one entry more than its text
        n_before = np.searchsorted(doc, np.arange(len(texts) + 1))
        first = n_before + 2 * np.arange(len(texts) + 1)
        slot = np.arange(len(ids)) + 2 * doc + 1
        full = np.empty(first[-1], np.int32)
        begin, end = np.zeros((2, first[-1]), np.int64)
        full[slot], begin[slot], end[slot] = ids, source[after - size + shift[doc]], source[after + shift[doc]]
        full[first[:-1]], full[first[1:] - 1] = self.whole.bos_id(), self.whole.eos_id()
        begin[first[1:] - 1] = end[first[1:] - 1] = np.diff(text_at)
        return Encoded(full, first, begin, end, self)

    def _cuts(self, normal: np.ndarray, edges: np.ndarray) -> np.ndarray:
        if not self.by_word or not len(normal):
            return cut_points(len(normal), edges)
        marks = normal == self.space[0]
        for k in range(1, len(self.space)):
            marks[:-k] &= normal[k:] == self.space[k]
            marks[-k:] = False
        inner = np.zeros(len(normal), bool)  # a mark right after a mark
        inner[len(self.space) :] = marks[: -len(self.space)] if len(normal) > len(self.space) else False
        return cut_points(len(normal), edges, np.flatnonzero(marks & ~inner))

    def decode(self, ids: np.ndarray, first: np.ndarray) -> list[str]:
        flat = ids.tolist()
        return self.whole.decode([flat[a:b] for a, b in zip(first[:-1], first[1:])], num_threads=1)


def _char_size(lead: int) -> int:
    return 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


SPANS = T.StructType([T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("ids", "begin", "end")])


def spans(encoded: Encoded) -> list[pa.Array]:
    """Ids, and the source bytes ``[begin, end)`` of each."""
    first = pa.array(encoded.first.astype(np.int32))
    columns = (encoded.ids, encoded.begin, encoded.end)
    return [pa.ListArray.from_arrays(first, pa.array(c.astype(np.int32))) for c in columns]


def encode(
    df: DataFrame,
    key: str,
    text: str,
    model: bytes,
    outputs: T.StructType = SPANS,
    project: Callable[[Encoded], list[pa.Array]] = spans,
) -> DataFrame:
    """Encode every row's whole text; gives ``key`` and the ``outputs`` that ``project`` makes of the pieces.

    NULL encodes as the empty text: begin and end id only. Keys may be NULL or repeated; repeated rows are encoded
    each. An empty table gives an empty table. Other columns are left out, so their names cannot clash.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    source = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in batches:
            for part in row_slices(batch, "_text"):
                codec = codec or PieceCodec(shared.value)
                made = project(codec.encode(part.column("_text")))
                yield pa.RecordBatch.from_arrays([part.column("_key"), *made], [key, *outputs.names])

    return source.mapInArrow(run, T.StructType([T.StructField(key, df.schema[key].dataType), *outputs.fields]))


def decode(df: DataFrame, key: str, ids: str, model: bytes, out: str = "text") -> DataFrame:
    """``key`` and the text of an id column. NULL ids give NULL, no ids the empty text."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    source = df.select(F.col(key).alias("_key"), F.col(ids).alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        codec = sentencepiece.SentencePieceProcessor(model_proto=shared.value)
        for batch in batches:
            texts = [None if row is None else codec.decode(row) if row else "" for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, out])

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField(out, T.StringType())])
    return source.mapInArrow(run, schema)
