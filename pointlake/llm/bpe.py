"""Byte-level BPE as a streaming transducer with bounded lookahead.

Text is split by the tokenizer's pattern; within a piece the merge list decides. Which token stands at a place depends
on the bytes to its right, but only on so many of them: a token x at time r (all merges of a lower rank done) can only be
undone by a merge (t, y) of a lower rank whose t is a suffix token of x, and whether y stands there takes |y| bytes and
what y itself depends on. Ranks fall along such a chain, so the recursion

    need(a, x) = |x| + reach(x, rank(a, x))
    reach(x, r) = max of need(t, y) over the suffix tokens t of x and merges (t, y) ranked below t's deadline

is finite; t's deadline is r for x itself, else the rank of the merge that takes t into its parent. The greatest reach of a
token without a deadline is the lookahead of the merge list. `Transducer` holds a window of bytes, emits each token that ends at
least the lookahead before the window's end, and forgets its bytes, so its memory doesn't grow with the text. Removing
a stable prefix is sound: any run of tokens of an encoding is the encoding of its own bytes.
"""
from __future__ import annotations

import codecs
import heapq
import json
import os
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache

import regex

# Fixed value: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts beyond this many characters are split lazily and not cached; a matter of memory only.
LONG = 1 << 16
CACHE_PIECES, CACHE_CHARS = 200_000, 48


def default_path() -> str:
    try:
        import public_tokenizers

        return public_tokenizers.path("byte_bpe_50k.json")
    except ImportError:
        return os.environ.get("POINTLAKE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: printable Latin-1 for itself, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Vocabulary and merge list of a file, and the lookahead it needs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = byte_letters()
        raw = {t: bytes(letters[c] for c in t) for t in model["vocab"] if all(c in letters for c in t)}
        self.bytes_of = {model["vocab"][t]: b for t, b in raw.items()}
        id_of = {b: i for i, b in self.bytes_of.items()}
        self.of_byte = [id_of[bytes([b])] for b in range(256)]
        self.rank: dict[tuple[int, int], int] = {}
        self.result: list[int] = []
        for m in model["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            x, y = model["vocab"][a], model["vocab"][b]
            self.rank[x, y] = len(self.result)
            self.result.append(model["vocab"][a + b])
        self.lookahead = self._lookahead()

    def _lookahead(self) -> int:
        made: dict[int, tuple[int, int]] = {}  # token -> (right part, rank)
        ranks: dict[int, list[int]] = {}  # of the merges with this left part, ascending
        needs: dict[int, list[int]] = {}  # running maximum of need along them

        def reach(x: int, deadline: int) -> int:
            most = 0
            while True:
                if (at := ranks.get(x)) and (n := bisect_left(at, deadline)):
                    most = max(most, needs[x][n - 1])
                if x not in made:
                    return most
                x, deadline = made[x]

        for (a, x), r in self.rank.items():  # in order of rank
            need = len(self.bytes_of[x]) + reach(x, r)
            ranks.setdefault(a, []).append(r)
            so_far = needs.setdefault(a, [])
            so_far.append(max(need, so_far[-1]) if so_far else need)
            made.setdefault(self.result[r], (x, r))
        return max((reach(t, len(self.result)) for t in self.bytes_of), default=0)

    def encode_window(self, data: bytes) -> list[int]:
        """All merges applied to data, lowest rank first, of equal ones the leftmost."""
        ids = [self.of_byte[b] for b in data]
        return self._short(ids) if len(ids) <= 64 else self._long(ids)

    def _short(self, ids: list[int]) -> list[int]:
        rank = self.rank
        while len(ids) > 1:
            best, r = -1, 1 << 60
            for i in range(len(ids) - 1):
                x = rank.get((ids[i], ids[i + 1]), r)
                if x < r:
                    best, r = i, x
            if best < 0:
                return ids
            ids[best : best + 2] = [self.result[r]]
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        rank, n = self.rank, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in rank]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or rank.get((ids[i], ids[j])) != r:
                continue
            ids[i], ids[j] = self.result[r], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (x := rank.get((ids[i], ids[k]))) is not None:
                    heapq.heappush(heap, (x, i))
            if (h := before[i]) >= 0 and (x := rank.get((ids[h], ids[i]))) is not None:
                heapq.heappush(heap, (x, h))
        return [t for t in ids if t >= 0]


class Transducer:
    """Bytes of one piece in, stable tokens out. The window holds the lookahead and a block."""

    def __init__(self, merges: Merges, block: int = 2048):
        self.m, self.block, self.window = merges, block, b""

    def feed(self, data: bytes) -> list[int]:
        self.window += data
        if len(self.window) < self.m.lookahead + self.block:
            return []
        out, done, stable = [], 0, len(self.window) - self.m.lookahead
        for t in self.m.encode_window(self.window):
            end = done + len(self.m.bytes_of[t])
            if end > stable:
                break
            out.append(t)
            done = end
        self.window = self.window[done:]
        return out

    def finish(self) -> list[int]:
        out, self.window = self.m.encode_window(self.window), b""
        return out


class Tokenizer:
    def __init__(self, path: str):
        self.merges = Merges(path)
        self.pattern = regex.compile(PATTERN)
        self.cache: dict[str, tuple[int, ...]] = {}

    def _piece(self, piece: str) -> tuple[int, ...]:
        t, out, step = Transducer(self.merges), [], 1024
        for i in range(0, len(piece), step):
            out += t.feed(piece[i : i + step].encode())
        out += t.finish()
        ids = tuple(out)
        if len(piece) <= CACHE_CHARS:
            if len(self.cache) >= CACHE_PIECES:
                self.cache.clear()
            self.cache[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Token ids; null and empty texts give an empty list."""
        out: list[int] = []
        if not text:
            return out
        get = self.cache.get
        pieces = self.pattern.findall(text) if len(text) <= LONG else (m.group() for m in self.pattern.finditer(text))
        for p in pieces:
            out += get(p) or self._piece(p)
        return out


class ByteToText:
    """Incremental decoder: tokens' bytes in, text out as soon as its characters are complete."""

    def __init__(self, merges: Merges):
        self.bytes_of, self.state = merges.bytes_of, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(map(self.bytes_of.__getitem__, ids)))

    def finish(self) -> str:
        return self.state.decode(b"", final=True)


def decode(merges: Merges, ids: list[int], step: int = 4096) -> Iterator[str]:
    d = ByteToText(merges)
    for i in range(0, len(ids), step):
        yield d.feed(ids[i : i + step])
    yield d.finish()


@lru_cache(maxsize=4)
def load(path: str) -> Tokenizer:
    return Tokenizer(path)
