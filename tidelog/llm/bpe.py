"""Byte-pair encoding by dynamic programming over prefixes.

A byte prefix of a piece has one encoding, so one last token. Keeping that token for each prefix keeps the encodings of
all prefixes at once: the encoding of a prefix is its last token after the encoding of what is left. A token that ends at
a position is the last one exactly if, with the last token of the prefix before it, it is a pair that merging in order
of rank would leave apart. Whether two tokens stay apart is read from the merges that built them, and remembered.

So appending bytes only adds prefixes, and an edit redoes the prefixes after it; nothing is merged again.

The text is first cut into pieces, in two steps with the same result as the tokenizer's pattern: into chunks (a run of
non-space with the one blank before it, or white space), which repeat often and are remembered with their ids, and
chunks into pieces. What is remembered is bounded and starts anew when full, which doesn't change results.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain

import numpy as np

TOKENIZER_DIR = "/opt/tokenizers"
#: Remembered chunks, pieces and pairs per process; each some 100 bytes.
MOST_REMEMBERED = 400_000
LONGEST_REMEMBERED = 48

# The pattern of the byte-level tokenizer, and the characters with the Unicode property White_Space.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WHITE = "\t\n\x0b\x0c\r \x85   -     　"

_CHUNK = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]")
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t\n\x0b\x0c\r A-Za-z0-9]+|[\t\n\x0b\x0c\r ]+(?![^\t\n\x0b\x0c\r ])|[\t\n\x0b\x0c\r ]")


@lru_cache(1)
def _any_script():
    import regex

    return regex.compile(PATTERN.replace(r"\s", rf"[{WHITE}]").replace(r"\S", f"[^{WHITE}]").replace(f"[^[{WHITE}]", f"[^{WHITE}"))


class Vocabulary:
    """Tokens by rank, how each was merged, and which pairs stay apart."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes = {r: b for b, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self._halves: dict[int, tuple[int, int]] = {}
        self._apart: dict[int, bool] = {}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge made this one; of a single byte, itself twice."""
        known = self._halves.get(token)
        if known is None:
            b = self.bytes[token]
            known = (token, token)
            for cut in range(1, len(b)):
                left, right = self.ranks.get(b[:cut]), self.ranks.get(b[cut:])
                if left is None or right is None or left >= token or right >= token:
                    continue
                if self._stay_apart(left, right, token):
                    known = (left, right)
                    break
            self._halves[token] = known
        return known

    def apart(self, left: int, right: int) -> bool:
        """Whether encoding the bytes of both gives just these two tokens."""
        key = left << 32 | right
        known = self._apart.get(key)
        if known is None:
            if len(self._apart) >= MOST_REMEMBERED:
                self._apart.clear()
            known = self._apart[key] = self._stay_apart(left, right, None)
        return known

    def _stay_apart(self, left: int, right: int, own: int | None) -> bool:
        """Go back in time along both edges that meet at the border.

        ``x`` lasts until its parent of rank ``x_end`` is made, ``y`` likewise. A merge across the border happens if its
        rank comes before both ends; at equal rank the one further left goes first. ``own`` is the merge that is asked about.
        """
        ranks, names = self.ranks, self.bytes
        x, y, x_end, y_end = left, right, 1 << 62, 1 << 62
        while True:
            across = ranks.get(names[x] + names[y])
            if across is not None and across < x_end and across <= y_end and across != own:
                return False
            if x > y and len(names[x]) > 1:
                x, x_end = self.halves(x)[1], x
            elif len(names[y]) > 1:
                y, y_end = self.halves(y)[0], y
            elif len(names[x]) > 1:
                x, x_end = self.halves(x)[1], x
            else:
                return True


class Prefixes:
    """The last token of every prefix of one piece; position 0 is the empty prefix."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        """Exact: the prefixes there were keep their tokens."""
        v = self.vocabulary
        get, apart, longest, last = v.ranks.get, v.apart, v.longest, self.last
        begin, data = len(self.data), self.data + more
        self.data = data
        for end in range(begin + 1, len(data) + 1):
            for start in range(max(0, end - longest), end):
                token = get(data[start:end])
                if token is not None and (start == 0 or apart(last[start], token)):
                    last.append(token)
                    break

    def replace(self, start: int, end: int, new: bytes) -> None:
        """Put ``new`` in place of the bytes from ``start`` to ``end``; prefixes before ``start`` stay as they are."""
        tail = self.data[end:]
        self.data, self.last = self.data[:start], self.last[: start + 1]
        self.append(new + tail)

    def ids(self, upto: int | None = None) -> list[int]:
        """The encoding of the prefix of ``upto`` bytes, or of all."""
        at, out, names = len(self.data) if upto is None else upto, [], self.vocabulary.bytes
        while at:
            out.append(self.last[at])
            at -= len(names[self.last[at]])
        return out[::-1]


class _Pieces(dict):
    """Piece to ids, made when asked for."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8", "surrogatepass")
        token = self.vocabulary.ranks.get(data)
        ids = (token,) if token is not None else tuple(Prefixes(self.vocabulary, data).ids())
        if len(piece) <= LONGEST_REMEMBERED:
            if len(self) >= MOST_REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids


class _Chunks(dict):
    """Chunk to ids, made from its pieces when asked for."""

    def __init__(self, pieces: _Pieces) -> None:
        self.pieces = pieces

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        cut = _ASCII if chunk.isascii() else _any_script()
        ids = tuple(chain.from_iterable(map(self.pieces.__getitem__, cut.findall(chunk))))
        if len(chunk) <= 20:
            if len(self) >= MOST_REMEMBERED:
                self.clear()
            self[chunk] = ids
        return ids


class Encoder:
    """Texts to ids, without special tokens. Empty and null texts have no ids."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.chunks = _Chunks(_Pieces(vocabulary))

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.chunks.__getitem__, _CHUNK.findall(text or ""))))

    def encode_batch(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the offsets at which each text's ids begin."""
        parts, offsets = [], [0]
        get, cut = self.chunks.__getitem__, _CHUNK.findall
        for t in texts:
            ids = np.fromiter(chain.from_iterable(map(get, cut(t))), dtype=np.int32) if t else np.empty(0, np.int32)
            parts.append(ids)
            offsets.append(offsets[-1] + len(ids))
        return (np.concatenate(parts) if parts else np.empty(0, np.int32)), np.array(offsets, dtype=np.int32)

    def count(self, text: str | None) -> int:
        return sum(map(len, map(self.chunks.__getitem__, _CHUNK.findall(text)))) if text else 0


class Document:
    """A text with its ids that can grow and be edited; only chunks near a change are encoded again.

    Chunks are cut from left to right without looking back, and look ahead no further than to the end of white space, which
    two chunks share at most. So all chunks but the last three before a change stay, and after it cutting goes on only until a
    new cut falls on an old one.
    """

    def __init__(self, encoder: Encoder, text: str = "") -> None:
        self.encoder, self.text = encoder, ""
        self.starts: list[int] = []
        self.parts: list[tuple[int, ...]] = []
        self.append(text)

    def append(self, more: str) -> int:
        return self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> int:
        """Put ``new`` in place of the characters from ``start`` to ``end``; the number of chunks encoded again."""
        old_starts, old_parts = self.starts, self.parts
        shift = len(new) - (end - start)
        self.text = self.text[:start] + new + self.text[end:]
        keep = max(0, bisect_left(old_starts, start) - 3)
        at = old_starts[keep] if keep < len(old_starts) else min(start, len(self.text))
        starts, parts = old_starts[:keep], old_parts[:keep]
        tail = bisect_left(old_starts, end)
        made = 0
        for m in _CHUNK.finditer(self.text, at):
            if m.start() >= start + len(new):
                tail = bisect_left(old_starts, m.start() - shift, tail)
                if tail < len(old_starts) and old_starts[tail] == m.start() - shift:
                    starts += [s + shift for s in old_starts[tail:]]
                    parts += old_parts[tail:]
                    break
            starts.append(m.start())
            parts.append(self.encoder.chunks[m[0]])
            made += 1
        self.starts, self.parts = starts, parts
        return made

    def ids(self) -> list[int]:
        return list(chain.from_iterable(self.parts))


@lru_cache(4)
def encoder(path: str) -> Encoder:
    """One encoder per process and vocabulary file."""
    return Encoder(Vocabulary.load(path))
