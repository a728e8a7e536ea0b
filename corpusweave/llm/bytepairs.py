"""Byte-pair merging shared by the token operators: vocabulary files, a heap-driven merge, caches.

A text is first cut into *units*: a run of non-white-space with the one space before it, or a run of
white space. Every match of the pre-token pattern lies inside one unit, so a unit's result can be kept
in a dictionary and most of a text costs one lookup for each word.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
import struct
from collections.abc import Callable

import regex

# The published pre-token pattern of these vocabularies, and Unicode's White_Space.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

UNIT = re.compile(rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
PIECE = regex.compile(PATTERN)
CACHED_UNITS = 300_000  # a worker empties its dictionary of units when it holds this many
CACHED_PIECES = 800_000  # and that of single pre-tokens


def merge(symbols: list, join: Callable) -> tuple[list, int]:
    """Pop the lowest-rank adjacent pair (leftmost of equals) until none is left.

    ``join(a, b)`` gives (rank, merged symbol) or None. Neighbours are linked by index lists, so a
    merge costs one heap operation whatever the length. Returns the symbols left and the merges made.
    """
    size = len(symbols)
    after = list(range(1, size + 1))
    before = list(range(-1, size - 1))
    alive = [True] * size
    symbols = list(symbols)
    heap = []
    for i in range(size - 1):
        found = join(symbols[i], symbols[i + 1])
        if found is not None:
            heap.append((found[0], i, symbols[i], symbols[i + 1], found[1]))
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, left, right, merged = heapq.heappop(heap)
        j = after[i] if alive[i] else size
        if j >= size or symbols[i] != left or symbols[j] != right:
            continue  # one of the two has been merged since
        symbols[i], alive[j] = merged, False
        merges += 1
        after[i] = k = after[j]
        if k < size:
            before[k] = i
            found = join(merged, symbols[k])
            if found is not None:
                heapq.heappush(heap, (found[0], i, merged, symbols[k], found[1]))
        h = before[i]
        if h >= 0:
            found = join(symbols[h], merged)
            if found is not None:
                heapq.heappush(heap, (found[0], h, symbols[h], merged, found[1]))
    return [s for s, kept in zip(symbols, alive, strict=True) if kept], merges


def merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a short piece: the ranks of all neighbours stand in a list whose minimum is merged."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    get, none = ranks.get, len(ranks) + (1 << 32)
    pairs = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while pairs and (least := min(pairs)) < none:
        i = pairs.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], none)
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], none)
    return [ranks[p] for p in parts]


def read_ranks(content: bytes) -> dict[bytes, int]:
    """A rank file: one base-64 token and its rank in each line."""
    ranks = {}
    for line in content.splitlines():
        if line.strip():
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return ranks


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabulary files: a byte that prints stands
    for itself, the others take code points from 256 on, in order."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in prints}
    rest = (b for b in range(256) if b not in table)
    return table | {b: chr(256 + i) for i, b in enumerate(rest)}


class JsonMerges:
    """Merge rules and special strings of a byte-level BPE vocabulary in JSON form."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model = spec["model"]
        vocab = model["vocab"]
        self.first = [vocab[symbol] for _, symbol in sorted(byte_symbols().items())]
        self.pairs = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self.special = [x["content"] for x in spec.get("added_tokens", ())]

    def count(self, piece: bytes) -> int:
        """Tokens of one pre-token: its bytes minus the merges."""
        if len(piece) < 2:
            return len(piece)
        pairs = self.pairs
        return len(piece) - merge([self.first[b] for b in piece], lambda a, b: pairs.get((a, b)))[1]


class RankEncoder(dict):
    """unit -> ids as little-endian unsigned 32-bit bytes, computed on first use."""

    def __init__(self, content: bytes):
        super().__init__()
        self.ranks = read_ranks(content)
        self.pieces: dict[str, bytes] = {}
        self.tokens = [b""] * (1 + max(self.ranks.values(), default=-1))
        for token, rank in self.ranks.items():
            self.tokens[rank] = token

    def piece_ids(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        ranks = self.ranks
        if len(piece) <= 64:
            return merge_short(piece, ranks)

        def join(a: bytes, b: bytes):
            rank = ranks.get(a + b)
            return None if rank is None else (rank, a + b)

        return [ranks[s] for s in merge([piece[i : i + 1] for i in range(len(piece))], join)[0]]

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= CACHED_UNITS:
            self.clear()
        if len(self.pieces) >= CACHED_PIECES:
            self.pieces.clear()
        coded = b""
        for piece in PIECE.findall(unit):
            own = self.pieces.get(piece)
            if own is None:
                ids = self.piece_ids(piece.encode())
                own = struct.pack(f"<{len(ids)}I", *ids)
                if len(piece) <= 64:
                    self.pieces[piece] = own
            coded += own
        if len(unit) <= 64:
            self[unit] = coded
        return coded

    def decode(self, ids) -> bytes:
        """Raw bytes of the ids, concatenated."""
        return b"".join(map(self.tokens.__getitem__, ids))


_loaded: dict = {}


def once(kind: Callable, content):
    """``kind(content.value)``, built once in each Python worker for a broadcast variable."""
    key = (kind, content.id if hasattr(content, "id") else hash(content.value))
    if key not in _loaded:
        _loaded[key] = kind(content.value)
    return _loaded[key]
