"""Words of many texts at once, as numbers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# The ASCII white space that separates words
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


@dataclass(frozen=True)
class Words:
    """Words of some texts in order: ``codes`` number the entries of ``known``.

    ``text`` is the row of each word, ``piece`` differs where a break or the end of a
    text lies between two words, ``words`` has the words themselves.
    """

    codes: np.ndarray
    known: pa.Array
    text: np.ndarray
    piece: np.ndarray
    words: pa.Array


def cut_words(texts: pa.Array, spaces: bytes = SPACES, breaks: bytes = b"", lower: bool = False) -> Words:
    """Words of string rows without NULLs. ``breaks`` end a piece of text; ``lower`` turns A-Z into a-z."""
    buffers = texts.buffers()
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    bounds = np.frombuffer(buffers[1], dtype=wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = np.frombuffer(buffers[2] or b"", dtype=np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    letters = np.arange(256, dtype=np.uint8)
    if lower:
        letters[ord("A") : ord("Z") + 1] += 32
    kind = np.zeros(256, dtype=np.uint8)
    kind[list(spaces)] = 1
    kind[list(breaks)] = 2
    kinds = kind[held]
    inside = kinds == 0
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    firsts = bounds[:-1][np.diff(bounds) > 0]
    starts[firsts] = inside[firsts]  # a text's first word does not go on from the text before
    begin = np.flatnonzero(starts)
    text = np.searchsorted(bounds, begin, side="right") - 1
    piece = text
    if breaks:
        piece = text + np.cumsum(kinds == 2)[begin]
    data = letters[held[inside]]
    # the n-th letter kept starts a word where as many letters lie before it
    offsets = np.append(np.flatnonzero(starts[inside]), len(data))
    if len(data) >= 1 << 31:
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
    else:
        words = pa.BinaryArray.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
    coded = words.dictionary_encode()
    return Words(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, text, piece, words)
