"""Ids of a byte-level BPE vocabulary, and its words, for a run of texts."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa

from gridloom.llm.words import SPACE, PieceCache, cut_points, split_words, spread

# The white space beyond ASCII that the vocabulary's pattern treats as white space.
_WIDE_SPACE = [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_WIDE_SPACE_BYTES = [chr(c).encode() for c in _WIDE_SPACE]
_WIDE_LEAD = np.zeros(256, bool)
_WIDE_LEAD[[b[0] for b in _WIDE_SPACE_BYTES]] = True
_WIDE_CODE = np.array([int.from_bytes(b.ljust(3, b"\0"), "big") for b in _WIDE_SPACE_BYTES])


class ByteBpe:
    """The ids that the ``tokenizers`` file of the same vocabulary gives, made from its rank file.

    The pattern never joins a character to a white space run that follows it, so a text is cut before each run and
    each distinct cut is encoded once. Texts with other white space, or with a special token's string, go whole.
    """

    def __init__(self, ranks: bytes, pattern: str, specials: dict[str, int]):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.special = specials
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens=specials)
        opens = np.zeros(max([*table.values(), *specials.values()]) + 1, bool)
        opens[[i for piece, i in table.items() if SPACE[piece[0]]]] = True
        self.opens_word = opens
        sizes = np.ones(len(opens), np.int64)
        sizes[list(table.values())] = [len(piece) for piece in table]
        slices = _Slices(self.encoding, sizes)
        self.cache = PieceCache(slices.listed, direct=slices.cut)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the offsets of the texts within them; NULL is the empty text."""
        words = split_words(column)
        raw = words.data.tobytes()
        cuts = cut_points(len(words.data), words.text_at, words.end)
        edges = words.text_at
        odd = self._odd(words.data, raw, edges)
        if len(odd):
            inside = np.zeros(len(cuts), bool)
            for d in odd:
                inside[np.searchsorted(cuts, edges[d], "right") : np.searchsorted(cuts, edges[d + 1])] = True
            cuts = cuts[~inside]
        ids, counts = self.cache.ids(words.data, cuts)
        before = np.concatenate([[0], np.cumsum(counts)])
        first = before[np.searchsorted(cuts, edges)]
        if not len(odd):
            return ids, first
        rows = [ids[a:b] for a, b in zip(first[:-1], first[1:])]
        for d in odd:
            text = raw[edges[d] : edges[d + 1]].decode("utf-8", "replace")
            rows[d] = np.array(self.encoding.encode(text, allowed_special="all"), np.int32)
        return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])

    def _odd(self, data: np.ndarray, raw: bytes, edges: np.ndarray) -> np.ndarray:
        places = wide_spaces(data).tolist()
        for mark in (s.encode() for s in self.special):
            at = raw.find(mark)
            while at >= 0:
                places.append(at)
                at = raw.find(mark, at + 1)
        return np.unique(np.searchsorted(edges, np.array(places, np.int64), "right") - 1)


def wide_spaces(data: np.ndarray) -> np.ndarray:
    """Where the UTF-8 bytes ``data`` hold white space beyond ASCII."""
    at = np.flatnonzero(_WIDE_LEAD[data])
    lead, *rest = (data[np.minimum(at + i, len(data) - 1)].astype(np.int64) for i in range(3))
    third = np.where(lead >= 0xE0, rest[1], 0)  # of three bytes, by its lead
    return at[np.isin(lead << 16 | rest[0] << 8 | third, _WIDE_CODE)]


class _Slices:
    """Ids of byte slices. It knows nothing of the cache that asks it, so no cycle keeps the two beyond their task."""

    def __init__(self, encoding, sizes: np.ndarray):
        self.encoding, self.sizes = encoding, sizes

    def listed(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ends = np.cumsum([len(p) for p in pieces])
        data = np.frombuffer(b"".join(pieces), np.uint8)
        return self.cut(data, np.append(0, ends[:-1]), ends)

    def cut(self, data: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slices that open with white space and close without go in one string; the lengths of the ids part them."""
        if not len(low):
            return np.empty(0, np.int32), np.zeros(0, np.int64)
        joined = SPACE[data[low]] & ~SPACE[data[high - 1]]
        counts = np.zeros(len(low), np.int64)
        size = (high - low)[joined]
        ids = self._plain(spread(data, low[joined], size).tobytes())
        ends = np.cumsum(size)
        at = np.searchsorted(np.cumsum(self.sizes[ids]), ends, "left") + 1 if len(ends) else np.zeros(0, np.int64)
        counts[joined] = np.diff(at, prepend=0)
        rest = zip(low[~joined].tolist(), high[~joined].tolist())
        single = [self._plain(data[a:b].tobytes()) for a, b in rest]
        counts[~joined] = [len(s) for s in single]
        out = np.empty(counts.sum(), np.int32)
        from_joined = np.repeat(joined, counts)
        out[from_joined] = ids
        if single:
            out[~from_joined] = np.concatenate(single)
        return out, counts

    def _plain(self, raw: bytes) -> np.ndarray:
        text = raw.decode("utf-8", "replace")
        return self.encoding.encode_to_numpy(text, allowed_special=set(), disallowed_special=()).astype(np.int32)
