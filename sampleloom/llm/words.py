"""Words of texts as hashes, by NumPy over byte buffers."""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np

TAG = re.compile(r"</?[A-Za-z!][^<>]*>|\[/?[A-Za-z*]{1,12}(?:=[^\[\]\n]*)?\]")
HYPHEN = re.compile(r"(?<=\w)-[ \t]*\r?\n[ \t>|:]*(?=\w)")
HIDDEN = re.compile("[­​-‏⁠﻿̀-ͯ]")
SIGN = re.compile(r"[^\w\s]|_")
#: Bytes handled at once, and the longest text slice.
BUFFER = 1 << 21

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[65:91] = _WORD[128:] = True


def plain(text: str) -> str:
    """``text`` without markup, entities, accents, hidden signs and hyphenation at line ends, in lower case."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text or "[" in text:
        text = TAG.sub(" ", text)
    if "-" in text and "\n" in text:
        text = HYPHEN.sub("", text)
    if not text.isascii():
        text = SIGN.sub(" ", HIDDEN.sub("", unicodedata.normalize("NFKD", text)).casefold())
    return text


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and of its inverse."""
    global _POWER
    if len(_POWER[0]) < n:
        with np.errstate(over="ignore"):
            inverse = np.uint64(pow(int(_P), -1, 1 << 64))
            _POWER = tuple(np.cumprod(np.append(np.uint64(1), np.full(n - 1, x))) for x in (_P, inverse))
    return _POWER


_POWER: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of a buffer, and where the words begin."""
    b = _LOWER[np.frombuffer(raw, np.uint8)]
    word = np.concatenate([[False], _WORD[b], [False]])
    edge = np.flatnonzero(word[1:] != word[:-1])
    start, end = edge[::2], edge[1::2]
    up, down = _powers(len(b) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)])])
        h = (total[end] - total[start]) * down[start]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h, start


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``texts`` in order, and for each text where its words begin; one more entry ends the last."""
    hashes: list[np.ndarray] = []
    counts = np.zeros(len(texts) + 1, np.int64)
    pending: list[bytes] = []
    owners: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if not pending:
            return
        h, start = _hashes(b"\n".join(pending))
        begin = np.cumsum([0, *(len(x) + 1 for x in pending)])
        np.add.at(counts, np.array(owners) + 1, np.diff(np.searchsorted(start, begin)))
        hashes.append(h)
        pending.clear()
        owners.clear()
        size = 0

    for i, text in enumerate(texts):
        raw = plain(text).encode()
        while True:
            cut = len(raw)
            if cut > BUFFER:  # a very long text: slices that end at a blank, if there is one
                cut = max(raw.rfind(b" ", 0, BUFFER), raw.rfind(b"\n", 0, BUFFER)) + 1 or BUFFER
            pending.append(raw[:cut])
            owners.append(i)
            size += cut
            if size > BUFFER:
                flush()
            raw = raw[cut:]
            if not raw:
                break
    flush()
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.cumsum(counts)
