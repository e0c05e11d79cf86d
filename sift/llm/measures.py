"""Per-document text measures shared by the quality operators (whole texts, arrays only)."""

from __future__ import annotations

import numpy as np

from . import textkit as tk

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER | np.roll(_UPPER, 32)
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "!?"]] = True
_HEAD = np.ones(256, bool)  # bytes that begin a code point
_HEAD[0x80:0xC0] = False

#: order of the shape vector
SHAPE = ["log_words", "word_length", "symbols", "dup_lines", "repeats", "upper", "marks", "digits", "other", "variety", "lines"]


def _twice(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Is each item equal to another of its document."""
    out = np.zeros(len(h), bool)
    if len(h) > 1:
        key = tk.mix(h + doc.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        by = np.argsort(key)
        key = key[by]
        same = key[1:] == key[:-1]
        out[by[1:][same]] = True
        out[by[:-1][same]] = True
    return out


def _later(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Is each item equal to an earlier one of its document."""
    out = np.ones(len(h), bool)
    if len(h):
        _, first = np.unique(tk.mix(h + doc.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)), return_index=True)
        out[first] = False
    return out


def _distinct(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Distinct items of each document (by 40 hash bits; a slice has fewer than 2**24 documents)."""
    key = np.sort((doc.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=n)


def _count(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def measures(data: np.ndarray, off: np.ndarray, window: int = 8) -> dict[str, np.ndarray]:
    """Counts of each document of a slice.

    n_words, word_chars (code points in words), n_symbols, n_lines (lines with a
    word), n_dup_lines (equal to an earlier line), n_repeat_words (words inside
    ``window``-word windows found twice or more), n_distinct words, n_chars,
    n_upper, n_letters, n_digits, n_marks.
    """
    n = len(off) - 1
    start, end, doc = tk.words(data, off, tk.SPACE_SEP)
    h = tk.span_hash(data, start, end)
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_HEAD[data], out=chars[1:])
    out = {"n_words": tk.per_doc(doc, n), "word_chars": tk.per_doc(doc, n, chars[end] - chars[start]),
           "n_chars": chars[off[1:]] - chars[off[:-1]]}
    for name, table in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_letters", _LETTER), ("n_digits", _DIGIT), ("n_marks", _MARK)):
        out[name] = _count(table[data], off)
    ls, le, ld = tk.runs(data != 10, off)
    first_word = np.searchsorted(start, ls)
    has = np.flatnonzero((first_word < len(start)) & (np.append(start, -1)[np.minimum(first_word, len(start))] < le)) if len(start) else np.zeros(0, np.int64)
    ls, le, ld = ls[has], le[has], ld[has]
    later = _later(tk.span_hash(data, ls, le), ld)
    out["n_lines"] = tk.per_doc(ld, n)
    out["n_dup_lines"] = tk.per_doc(ld, n, later.astype(np.int64))
    ix, g = tk.grams(h, doc, window)
    begins = ix[_twice(g, doc[ix])]
    cover = np.bincount(begins, minlength=len(h) + window) - np.bincount(begins + window, minlength=len(h) + window)[:len(h) + window]
    out["n_repeat_words"] = tk.per_doc(doc, n, (np.cumsum(cover)[:len(h)] > 0).astype(np.int64))
    out["n_distinct"] = _distinct(h, doc, n)
    return out


def shape(m: dict[str, np.ndarray]) -> np.ndarray:
    """Documents x SHAPE matrix of scale-free measures."""
    w, c, lines = np.maximum(m["n_words"], 1), np.maximum(m["n_chars"], 1), np.maximum(m["n_lines"], 1)
    return np.stack([
        np.log1p(m["n_words"]), m["word_chars"] / w, m["n_symbols"] / w, m["n_dup_lines"] / lines,
        m["n_repeat_words"] / w, m["n_upper"] / np.maximum(m["n_letters"], 1), m["n_marks"] / w, m["n_digits"] / c,
        (c - m["n_letters"] - m["n_digits"]) / c, m["n_distinct"] / w, np.log1p(m["n_words"] / lines)], axis=1).astype(np.float64)
