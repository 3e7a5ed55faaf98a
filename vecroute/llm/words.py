"""Words of whole texts as flat NumPy arrays, batch by batch, for the operators that need them."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def give_back() -> None:
    """Return memory that earlier batches freed to the system, so that workers of many stages stay small."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def hash_words(words: pa.Array) -> np.ndarray:
    """A hash of 31 bits of each word: the sum of its bytes times powers of an odd number, mixed; all words at once."""
    words = words.cast(pa.large_string())
    if not len(words):
        return np.zeros(0, np.int64)
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    first, size = offsets[:-1], np.diff(offsets)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64) + np.uint64(1)
    place = np.arange(len(data)) - np.repeat(first - offsets[0], size)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(max(1, int(size.max())), 0x9E3779B97F4A7C15, np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data * powers[place])])
        x = sums[offsets[1:] - offsets[0]] - sums[first - offsets[0]]
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(33)).astype(np.int64)


def split_codes(texts: pa.Array, letters_only: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row of each word, code of each word, the distinct words as they are in Arrow, "" among them perhaps).

    Words are runs without ASCII white space; with ``letters_only``, runs of letters in lower case.
    """
    give_back()
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if letters_only:
        texts = pc.replace_substring_regex(pc.utf8_lower(texts), pattern=r"[^\p{L}]+", replacement=" ")
    lists = pc.ascii_split_whitespace(texts)
    rows = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    flat = lists.flatten().dictionary_encode()
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.combine_chunks()
    codes = flat.indices.to_numpy(zero_copy_only=False)
    return rows.astype(np.int64), codes.astype(np.int64), flat.dictionary


def split_words(texts: pa.Array, letters_only: bool = False) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(row of each word, code of each word, the distinct words); nulls count as empty.

    Words are those of ``split_codes``.
    """
    rows, codes, names = split_codes(texts, letters_only)
    names = names.to_pylist()
    if "" in names:  # what stands before or after white space
        full = codes != names.index("")
        rows, codes = rows[full], codes[full]
    return rows, codes, names
