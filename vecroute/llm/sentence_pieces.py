"""Encoding and decoding with merge-type vocabularies of the sentencepiece library.

A text's symbols are its code points. Adjacent symbols whose union is a piece stand on an agenda, ordered by
the piece's score and then from the left; the best pair is merged, its new neighbours are put on the agenda,
and pairs of symbols that are no more are passed over when they come up. Pieces marked as unused are merged
through and taken apart again at the end; symbols that are no piece become bytes where the vocabulary has
them, and the unknown id, once a stretch, where it hasn't.

A merge across two code points that stand side by side in no piece can't happen, so the symbols on both sides of
such a seam are merged apart: mostly between words, and about punctuation. Seams are marked on whole batches at
once; each distinct stretch between them is merged once by a worker, and kept in a bounded store. Short
stretches are merged side by side, each by its own agenda, as arrays; long ones with a heap.

Every text that is encoded is encoded by the library as well, by Arrow batches, and another result is an error.

Defined cases: a null text counts as empty, and an empty text has the ids of begin and end alone; texts are
taken whole, at any length; null and repeated ids of rows stay as they are, as do further columns, but an
input column named as the output is an error; an empty table gives no rows. Vocabularies of other types, and
those with user-defined pieces, are an error.
"""

from __future__ import annotations

import heapq
import sys
from collections.abc import Iterator
from itertools import chain
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecroute.llm.encode import PieceStore
from vecroute.llm.words import give_back

MARK = "\u2581"  # stands for a blank in normalised texts and pieces

#: Stretches of up to so many symbols are merged with others at once.
TOGETHER = 32


class PairTable:
    """Which two symbols make which, and the agendas of many stretches side by side.

    A round takes the top of each stretch's agenda, the best pair and of those the leftmost, and looks up the
    pairs that the new symbols make; stretches without a pair are done."""

    def __init__(self, cost: dict[str, float], ids: dict[str, int]):
        names = [*cost, *sorted({c for p in cost for c in p} - set(cost))]
        number = {p: i for i, p in enumerate(names)}
        found = []
        for piece, value in cost.items():
            for cut in range(1, len(piece)):
                left, right = number.get(piece[:cut]), number.get(piece[cut:])
                if left is not None and right is not None:
                    found.append((left * len(names) + right, value, number[piece]))
        found.sort()
        self.n = len(names)
        self.keys = np.array([f[0] for f in found] or [-1], np.int64)
        self.cost, self.makes = np.array([f[1] for f in found] or [0.0]), np.array([f[2] for f in found] or [0], np.int64)
        self.symbol = np.full(0x110000, -1, np.int32)
        single = [p for p in names if len(p) == 1]
        self.symbol[[ord(p) for p in single]] = [number[p] for p in single]
        self.ids = np.array([ids.get(p, -1) for p in names] + [-1], np.int64)  # the last for symbols of no number

    def _look_up(self, left: np.ndarray, right: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = np.where(same & (left >= 0) & (right >= 0), left * self.n + right, -2)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        return np.where(hit, self.cost[at], np.inf), np.where(hit, self.makes[at], -1)

    def merge(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols that are left of all texts, the text of each); -1 for code points that are in no piece."""
        symbols = self.symbol[np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)].astype(np.int64)
        owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
        if not len(symbols):
            return symbols, owner
        cost, makes = self._look_up(symbols, np.append(symbols[1:], -1), np.append(owner[1:] == owner[:-1], False))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            sizes = np.diff(np.append(starts, len(symbols)))
            best = np.repeat(np.minimum.reduceat(cost, starts), sizes)
            over = np.isinf(best)
            if over.any():
                done.append((symbols[over], owner[over]))
                symbols, owner, cost, makes, best = (x[~over] for x in (symbols, owner, cost, makes, best))
                if not len(symbols):
                    break
            at = np.flatnonzero(cost == best)
            at = at[np.append(True, owner[at[1:]] != owner[at[:-1]])]
            symbols[at] = makes[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, owner, cost, makes = (x[keep] for x in (symbols, owner, cost, makes))
            at -= np.arange(len(at))
            changed = np.concatenate([at, at[at > 0] - 1])
            follows = np.minimum(changed + 1, len(symbols) - 1)
            same = (owner[follows] == owner[changed]) & (follows > changed)
            cost[changed], makes[changed] = self._look_up(symbols[changed], symbols[follows], same)
        symbols, owner = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(owner, kind="stable")
        return symbols[order], owner[order]


class Vocabulary(PieceStore):
    """A model file's pieces, and the ids of stretches merged so far; ``most`` of them are kept."""

    def __init__(self, model_path: str, most: int = 500_000):
        import sentencepiece
        from sentencepiece.sentencepiece_model_pb2 import ModelProto

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        model = ModelProto.FromString(self.library.serialized_model_proto())
        kinds = ModelProto.SentencePiece
        if model.trainer_spec.model_type != model.trainer_spec.BPE:
            raise ValueError(f"{model_path}: not a vocabulary of merges")
        if any(p.type == kinds.USER_DEFINED for p in model.pieces):
            raise ValueError(f"{model_path}: user-defined pieces aren't supported")
        usual = (kinds.NORMAL, kinds.UNUSED)
        self.cost = {p.piece: -p.score for p in model.pieces if p.type in usual}  # the least is the best
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type in usual}
        self.unused = {p.piece for p in model.pieces if p.type == kinds.UNUSED}
        self.bytes = [i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE]  # in the order of their values
        self.unknown, self.begin, self.end = self.library.unk_id(), self.library.bos_id(), self.library.eos_id()
        joined = sorted({a + b for p in self.cost for a, b in zip(p, p[1:], strict=False)})
        inner = sorted(set("".join(joined)))
        #: Of each code point, its number among those of longer pieces (0: in none); of two numbers, whether they go together.
        self.kinds = len(inner) + 1
        self.number = np.zeros(0x110000, np.int32)
        self.number[[ord(c) for c in inner]] = np.arange(1, self.kinds)
        self.apart = np.ones(self.kinds**2, bool)
        self.apart[self.number[[ord(p[0]) for p in joined]] * self.kinds + self.number[[ord(p[1]) for p in joined]]] = False
        rules = model.normalizer_spec  # without a map of characters, the library's rules are those of ``normalised``
        self.identity = rules.add_dummy_prefix and rules.escape_whitespaces and not (rules.precompiled_charsmap or rules.remove_extra_whitespaces)
        self.identity &= not model.trainer_spec.treat_whitespace_as_suffix
        self.pairs: PairTable | None = None
        self.most = most
        self.index: dict[str, int] = {}
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def normalised(self, text: str) -> str:
        return (text and MARK + text.replace(" ", MARK)) if self.identity else self.library.normalize(text)

    def merged(self, text: str) -> list[str]:
        """The symbols that are left of a normalised text when no pair is a piece."""
        symbols: list[str] = list(text)
        n, cost_of, halves = len(symbols), self.cost.get, {}
        agenda = []
        for i in range(n - 1):
            both = text[i : i + 2]
            if (cost := cost_of(both)) is not None:
                agenda.append((cost, i, both))
        if not agenda:
            return symbols
        heapq.heapify(agenda)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        while agenda:
            _, left, both = heapq.heappop(agenda)
            first, right = symbols[left], after[left]
            if not first or right < 0 or first + symbols[right] != both:
                continue  # one of the two has been merged since
            if both in self.unused:
                halves[both] = (first, symbols[right])
            symbols[left], symbols[right] = both, ""
            after[left] = following = after[right]
            if following >= 0:
                before[following] = left
                new = both + symbols[following]
                if (cost := cost_of(new)) is not None:
                    heapq.heappush(agenda, (cost, left, new))
            previous = before[left]
            if previous >= 0:
                new = symbols[previous] + both
                if (cost := cost_of(new)) is not None:
                    heapq.heappush(agenda, (cost, previous, new))
        left_over = [s for s in symbols if s]
        if not halves:
            return left_over
        left_over.reverse()
        out = []
        while left_over:  # unused pieces into what they were made of
            if (s := left_over.pop()) in halves:
                left_over.extend(reversed(halves[s]))
            else:
                out.append(s)
        return out

    def word_ids(self, text: str) -> list[int]:
        ids: list[int] = []
        for s in self.merged(text):
            if s in self.ids:
                ids.append(self.ids[s])
            elif self.bytes:
                ids.extend(self.bytes[b] for b in s.encode())
            else:
                ids.append(self.unknown)
        return ids

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all stretches, how many each has)."""
        if self.pairs is None:
            self.pairs = PairTable(self.cost, self.ids)
        long = [i for i, p in enumerate(pieces) if len(p) > TOGETHER or self.unused]
        alone = {i: self.word_ids(pieces[i]) for i in long}
        symbols, owner = self.pairs.merge(["" if i in alone else p for i, p in enumerate(pieces)])
        ids = self.pairs.ids[symbols]
        known = symbols >= 0
        for at in np.flatnonzero(~known | (ids < 0)):  # symbols that are no piece
            alone.setdefault(int(owner[at]), [])
        for i in alone:
            alone[i] = self.word_ids(pieces[i])
        if alone:
            rest = ~np.isin(owner, np.fromiter(alone, np.int64))
            ids, owner = ids[rest], owner[rest]
            more = np.fromiter(chain.from_iterable(alone.values()), np.int64)
            ids = np.concatenate([ids, more])
            owner = np.concatenate([owner, np.repeat(np.fromiter(alone, np.int64), np.fromiter(map(len, alone.values()), np.int64))])
            ids = ids[np.argsort(owner, kind="stable")]
        return ids.astype(np.int32), np.bincount(owner, minlength=len(pieces))

    def _parted(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(text of each stretch, code of each stretch, the distinct stretches) of normalised texts."""
        give_back()
        whole = "".join(texts)
        data = whole.encode()
        kind = self.number[np.frombuffer(whole.encode("utf-32-le"), np.uint32)]
        begins = np.ones(len(kind), bool)
        np.take(self.apart, kind[:-1] * self.kinds + kind[1:], out=begins[1:])
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        full = np.flatnonzero(lengths)
        firsts = (np.cumsum(lengths) - lengths)[full]
        begins[firsts] = True
        begins = np.flatnonzero(begins)
        rows = np.repeat(full, np.diff(np.append(np.searchsorted(begins, firsts), len(begins))))
        points = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)  # the first byte of each code point
        bounds = np.append(points[begins], len(data)).astype(np.int64)
        coded = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(bounds), pa.py_buffer(data)).dictionary_encode()
        return rows, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each between the ids of begin and end; offsets of the texts)."""
        plain = [t or "" for t in texts.to_pylist()]
        rows, at, start, size, flat = self._places(list(map(self.normalised, plain)))
        sizes = size[at]
        ends = np.cumsum(sizes)
        ids = flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start[at] - (ends - sizes), sizes)]
        owner = np.repeat(rows, sizes)
        if not self.bytes:  # a stretch of unknown symbols is one
            more = np.ones(len(ids), bool)
            more[1:] = (ids[1:] != self.unknown) | (ids[:-1] != self.unknown) | (owner[1:] != owner[:-1])
            ids, owner = ids[more], owner[more]
        n = np.bincount(owner, minlength=len(plain)) + 2
        offsets = np.concatenate([[0], np.cumsum(n)])
        out = np.full(offsets[-1], self.end if end_id is None else end_id, np.int32)
        out[offsets[:-1]] = self.begin
        inside = np.ones(len(out), bool)
        inside[offsets[:-1]] = inside[offsets[1:] - 1] = False
        out[inside] = ids
        return out, offsets

    def check(self, texts: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> None:
        """An error unless the library has the same ids."""
        for i, text in enumerate(texts.to_pylist()):
            if not np.array_equal(self.library.encode(text or "", out_type="numpy", add_bos=True, add_eos=True), ids[offsets[i] : offsets[i + 1]]):
                raise ValueError(f"the library has other ids for the text that begins {(text or '')[:60]!r}")


def _kept(kind, model_path: str):
    """What this worker process has made of a model file, which lives on between its tasks."""
    cache = sys.modules.setdefault("_vecroute_pieces", ModuleType("_vecroute_pieces"))
    if not hasattr(cache, "known"):
        cache.known = {}
    key = (kind.__name__, model_path)
    if key not in cache.known:
        cache.known[key] = kind(model_path)
    return cache.known[key]


def _library(model_path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_path)


def encode(docs: DataFrame, model_path: str, text_col: str = "text", into: str = "ids", check: bool = True) -> DataFrame:
    """``docs`` with ``into`` (array of int, between the ids of begin and end) in place of the text."""
    keep = [c for c in docs.columns if c != text_col]
    if into in keep:
        raise ValueError(f"column {into!r} is there already")
    schema = docs.select(*keep, F.array(F.lit(0)).alias(into)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _kept(Vocabulary, model_path)
        for b in batches:
            texts = b.column(text_col)
            ids, offsets = known.encode(texts)
            if check:
                known.check(texts, ids, offsets)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), lists], names=[*keep, into])

    return docs.withColumn(text_col, F.col(text_col).cast("string")).select(*keep, text_col).mapInArrow(run, schema)


def decode(ids: Column, model_path: str) -> Column:
    """The text of a list of ids; null gives none."""

    @F.arrow_udf("string")
    def run(lists: pa.Array) -> pa.Array:
        known, flat, ends = _kept(_library, model_path), lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        valid = lists.is_valid().to_numpy(zero_copy_only=False)
        return pa.array([known.decode(flat[a:b].tolist()) if v else None for a, b, v in zip(ends[:-1], ends[1:], valid, strict=True)], pa.string())

    return run(ids)
