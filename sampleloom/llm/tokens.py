"""Token counts and natural boundaries of texts, for a public byte-level BPE tokenizer."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np

#: Rank file of the tokenizer; a parameter of every operator that counts tokens.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value of that tokenizer: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A run of white space starts a new token whatever precedes it, so a text can be tokenized in parts cut there.
SYNC = re.compile(rb"(?<=[!-~])[ \t\n\r]")
PART = 1 << 16


@lru_cache(maxsize=4)
def encoder(path: str = TOKENIZER):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def token_lengths(path: str = TOKENIZER) -> np.ndarray:
    """Length in bytes of each token."""
    enc = encoder(path)
    out = np.zeros(enc.n_vocab, np.int32)
    for raw, rank in enc._mergeable_ranks.items():
        out[rank] = len(raw)
    return out


def parts(raw: bytes, size: int = PART):
    """``raw`` in parts of about ``size`` bytes that are tokenized independently."""
    at = 0
    while len(raw) - at > 2 * size:
        end = sync(raw, at + size, size)
        yield raw[at:end]
        at = end
    yield raw[at:]


def sync(raw: bytes, at: int, reach: int) -> int:
    """The first place from ``at`` on, within ``reach`` bytes, where a text can be cut for tokenizing; else the next character."""
    m = SYNC.search(raw, at, at + reach)
    if m:
        return m.start()
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += 1
    return at


def count_tokens(text: str, path: str = TOKENIZER) -> int:
    enc = encoder(path)
    if len(text) <= PART:
        return len(enc.encode_ordinary(text))
    return sum(len(enc.encode_ordinary(p.decode())) for p in parts(text.encode()))


def token_sizes(text: str, path: str = TOKENIZER) -> np.ndarray:
    """Length in bytes of each token of ``text``."""
    return token_lengths(path)[np.asarray(encoder(path).encode_ordinary(text), np.int64)]


#: How good a place is for a cut: inside a character, inside a word, between words, after a sentence, at a line's end, at a paragraph's end.
INSIDE, WORD_PART, WORD, SENTENCE, LINE, PARAGRAPH = range(6)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True
_CLOSE = np.zeros(256, bool)
_CLOSE[[ord(c) for c in "\"')]*"]] = True


def strengths(raw: bytes, at: np.ndarray) -> np.ndarray:
    """How good a cut before byte ``at`` of ``raw`` is, from INSIDE to PARAGRAPH."""
    b = np.frombuffer(raw, np.uint8)
    n = len(b)
    if not n:
        return np.zeros(len(at), np.uint8)
    solid = np.flatnonzero(~_WHITE[b])
    lines = np.append(0, np.cumsum(b == 10))
    i = np.searchsorted(solid, at)
    solid = np.concatenate([[-1], solid, [n]])
    before, after = solid[i], solid[i + 1]
    breaks = lines[after] - lines[np.maximum(before, 0)]
    last = b[np.maximum(before, 0)]
    last2, last3 = b[np.maximum(before - 1, 0)], b[np.maximum(before - 2, 0)]
    ideographic = ((last3 == 0xE3) & (last2 == 0x80) & (last == 0x82)) | ((last3 == 0xEF) & (last2 == 0xBC) & ((last == 0x81) | (last == 0x9F)))
    stop = _STOP[last] | (_CLOSE[last] & _STOP[last2])
    gap = after - before > 1
    out = np.full(len(at), WORD_PART, np.uint8)
    out[ideographic] = SENTENCE
    out[gap] = WORD
    out[gap & (stop | ideographic)] = SENTENCE
    out[gap & (breaks == 1)] = LINE
    out[gap & (breaks > 1)] = PARAGRAPH
    out[(b[np.minimum(at, n - 1)] & 0xC0 == 0x80) & (at < n)] = INSIDE
    return out


class Cutter:
    """Cuts a sequence of tokens into pieces of at most ``limit`` tokens, ``overlap`` of them shared with the piece before.

    A cut is taken at the best place in the last ``slack`` share of the piece,
    the latest of equals; never inside a character. Where ``count`` is given, a
    piece is counted by itself, for it may tokenize otherwise than inside its
    text, and is cut shorter until it is within the limit. ``feed`` takes a
    stream of tokens' lengths in bytes and how good a cut before each is; it
    keeps no more than the piece in hand.
    """

    def __init__(self, limit: int, overlap: int = 0, slack: float = 0.5, reserve: int = 8):
        if not 0 <= overlap < limit:
            raise ValueError("overlap must be less than limit")
        self.most, self.slack = limit, slack
        self.limit = max(limit - min(reserve, limit // 8), overlap + 1, 1)
        self.overlap = overlap
        self.at = 0  # byte offset of the first token kept
        self.sizes, self.good = np.zeros(0, np.int64), np.zeros(0, np.uint8)

    def place(self, good: np.ndarray, s: int, top: int) -> int:
        """Where a piece of ``top`` tokens at most that begins at token ``s`` is best cut."""
        least = s + max(int(top * (1 - self.slack)), self.overlap + 1)
        window = good[least : max(s + top, least) + 1]
        k = least + len(window) - 1 - int(np.argmax(window[::-1]))
        if good[k] == INSIDE:  # one character spans all: end before or after it
            k = next((j for j in range(least - 1, s + self.overlap, -1) if good[j] != INSIDE), k)
            while k < len(good) and good[k] == INSIDE:
                k += 1
        return k

    def following(self, good: np.ndarray, s: int, k: int) -> int:
        """Where the piece after that of the tokens ``s`` to ``k`` begins."""
        nxt = k - self.overlap
        if not self.overlap:
            return nxt
        low = max(k - self.overlap - 8, s + 1)
        while nxt > low and good[nxt] < WORD:
            nxt -= 1
        if good[nxt] < WORD:
            nxt = k - self.overlap
            while nxt > s + 1 and good[nxt] == INSIDE:
                nxt -= 1
        return nxt

    def step(self, good: np.ndarray, offset: np.ndarray, s: int, final: bool = False, count=None) -> tuple[int, int, int | None] | None:
        """End of the piece that begins at token ``s``, begin of the next one, tokens counted; None if more tokens are needed."""
        n, size, top = len(good), None, self.limit
        if n - s <= self.limit:
            if not final:
                return None
            if count is None or (size := count(int(offset[s]), int(offset[n]))) <= self.most:
                return n, n, size
            top = n - s - 1
        while True:
            k = self.place(good, s, top) if s + max(top, self.overlap + 1) < n else n
            if k >= n:
                return (n, n, count(int(offset[s]), int(offset[n])) if count else None) if final else None
            if count is None or (size := count(int(offset[s]), int(offset[k]))) <= self.most or top <= self.overlap + 1:
                return k, self.following(good, s, k), size
            top = max(min(top, k - s) - max(size - self.most, 1), self.overlap + 1)

    def walk(self, good: np.ndarray, offset: np.ndarray, s: int, final: bool = False, count=None):
        """Pieces (begin, end, tokens counted) from token ``s`` on; returns the token that the next piece begins at."""
        while s < len(good) and (piece := self.step(good, offset, s, final, count)):
            yield int(offset[s]), int(offset[piece[0]]), piece[2]
            s = piece[1]
        return s

    def feed(self, sizes: np.ndarray, good: np.ndarray, final: bool = False, count=None):
        sizes, good = np.append(self.sizes, sizes), np.append(self.good, good)
        offset = self.at + np.append(0, np.cumsum(sizes))
        s = yield from self.walk(good, offset, 0, final, count)
        self.at, self.sizes, self.good = int(offset[s]), sizes[s:], good[s:]

    def finish(self, count=None):
        yield from self.feed(np.zeros(0, np.int64), np.zeros(0, np.uint8), True, count)


def cut_text(text: str, cutter: Cutter, path: str = TOKENIZER) -> list[tuple[int, int, int]]:
    """Byte ranges of the pieces of ``text`` and their tokens."""
    raw, out = text.encode(), []
    count = lambda a, b: count_tokens(raw[a:b].decode(), path)
    for part in parts(raw):
        sizes = token_sizes(part.decode(), path)
        base = cutter.at + int(cutter.sizes.sum())
        at = base + np.append(0, np.cumsum(sizes)[:-1]) if len(sizes) else np.zeros(0, np.int64)
        near = max(0, base - 8)
        out += cutter.feed(sizes, strengths(raw[near : base + len(part) + 64], at - near), count=count)
    return out + list(cutter.finish(count))
