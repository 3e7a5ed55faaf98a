"""Token ids of whole texts with a public tokenizer, at the cost of the distinct pieces of a batch.

Some tokenizers lower-case texts and part them at white space, and between a letter and ASCII punctuation
other than an apostrophe (which may begin a contraction), before anything else. The ids of a text are then
those of such pieces, one after the other. Each distinct piece is encoded by the library, and kept in a
bounded store of the worker process. A tokenizer that treats one of ``PROBES`` otherwise, as those do that
keep case or take white space into their tokens, gets whole texts instead.
"""

from __future__ import annotations

import os
import sys
from itertools import chain, repeat
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from vecroute.llm.words import split_words

_SEAM = r"([A-Za-z])([!-&(-/:-@\[-`{-~])"

#: Texts whose ids tell whether a tokenizer parts texts as it is taken to.
PROBES = ["The cat sat.", "it's a.b, x's.'s (no)", "Two  words\n\tand more\r\n", "A<b>c </b> 3.5% don't", "UPPER lower", " lead and trail ", "é́ É! ß?x", "a_b-c/d@e"]


class PieceStore:
    """Ids of pieces seen so far; when it holds ``most`` pieces, further ones live for a batch only."""

    def __init__(self, tokenizer_path: str, plain_specials: bool = False, most: int = 700_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        if plain_specials:  # special tokens' strings in a text are then ordinary text
            self.tokenizer.encode_special_tokens = True
        self.by_piece = all(self._ids(t) == [i for p in self._parted([t])[2] for i in self._ids(p)] for t in PROBES)
        self.most = most
        self.index: dict[str, int] = {}
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _parted(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(text of each piece, code of each piece, the distinct pieces)."""
        whole = pc.fill_null(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()), "")
        plain = pc.ascii_lower(whole)
        parted = pc.replace_substring_regex(plain, pattern=_SEAM, replacement=r"\1 \2")
        special = pc.match_substring_regex(plain, pattern=r"<\|[a-z_0-9]+\|>")  # such strings stay in one piece, as they are
        return split_words(pc.if_else(special, whole, parted))

    def _places(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text of each piece, its entry; start, size of each entry in the ids of all entries)."""
        rows, codes, names = self._parted(texts)
        places = np.fromiter(map(self.index.get, names, repeat(-1)), np.int64, len(names))
        start, size, flat = self.start, self.size, self.flat
        if (new := np.flatnonzero(places < 0)).size:
            pieces = [names[i] for i in new]
            more, sizes = self._encode(pieces)
            n = len(size)
            places[new] = np.arange(n, n + len(new))
            start = np.concatenate([start, len(flat) + np.cumsum(sizes) - sizes])
            size, flat = np.concatenate([size, sizes]), np.concatenate([flat, more])
            if n + len(new) <= self.most:
                self.index.update(zip(pieces, range(n, n + len(new)), strict=True))
                self.start, self.size, self.flat = start, size, flat
        return rows, places[codes], start, size, flat

    def count(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each text."""
        if not self.by_piece:
            return np.diff(self.encode(texts, 0)[1]) - 1
        rows, at, _, size, _ = self._places(texts)
        return np.bincount(rows, weights=size[at], minlength=len(texts)).astype(np.int64)

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not any("<|" in p for p in pieces):
            # the pieces as the words of one text: a single result instead of one a piece
            found = self.tokenizer.encode(pieces, is_pretokenized=True, add_special_tokens=False)
            return np.array(found.ids, np.int32), np.bincount(np.array(found.word_ids, np.int64), minlength=len(pieces))
        # special tokens are only told from text in a text of its own
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(ids), np.int32), np.fromiter(map(len, ids), np.int64, len(ids))

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each closed by ``end_id``; offsets of the texts)."""
        if not self.by_piece:
            whole = self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)
            ids = [[*e.ids, end_id] for e in whole]
            return np.fromiter(chain.from_iterable(ids), np.int32), np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
        rows, at, start, size, flat = self._places(texts)
        sizes = size[at]
        per_text = np.bincount(rows, weights=sizes, minlength=len(texts)).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(per_text + 1)])
        out = np.full(offsets[-1], end_id, np.int32)
        ends = np.cumsum(sizes)
        source = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start[at] - (ends - sizes), sizes)
        inside = np.ones(len(out), bool)
        inside[offsets[1:] - 1] = False
        out[inside] = flat[source]
        return out, offsets


def worker_store(tokenizer_path: str, plain_specials: bool = False) -> PieceStore:
    """The store of this worker process, which lives on between its tasks."""
    cache = sys.modules.setdefault("_vecroute_stores", ModuleType("_vecroute_stores"))
    if not hasattr(cache, "stores"):
        cache.stores = {}
    key = (tokenizer_path, plain_specials)
    if key not in cache.stores:
        cache.stores[key] = PieceStore(tokenizer_path, plain_specials)
    return cache.stores[key]
