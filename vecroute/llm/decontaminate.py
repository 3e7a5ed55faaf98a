"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into parts of at most ``PART`` words; their words are the terms. Every document
becomes, once for all items, the sequence of the hashes of its words. Parts are searched by length class
(up to 8, 16, 32, ... words), each with the terms of its own parts and in passages of three times the class's
length, a third apart, so that each stretch of twice a part's length lies whole in some passage.
Terms are weighted by their frequency in the passage and their rarity over all documents. A randomised SVD of
the passages' TF-IDF matrix (one pass of a Gaussian sketch, summed up by Spark, then solved as a Nystroem
problem of the sketch's size) gives latent vectors. A passage that holds a part beside other text has a lower
cosine to it the more it holds besides, so the bound follows the lengths: passages whose cosine to a part
reaches ``min_cosine`` times the ratio of the part's latent length to theirs (1 at most) are candidates.
A candidate is a leak if in some stretch of it, of twice the part's length, the longest common subsequence
covers ``min_common`` of the part's words, and ``min_answer`` of its answer terms, the rarest third, are there.

The answer check needs no latent vector, so part of it comes first: a passage that holds fewer answer terms
than the least demanding part of its class asks for can't pass for any, and isn't projected. All documents and
whole texts take part in the counts and in the search. Benchmarks of more than ``ITEMS`` items are searched in
blocks of that size, which bounds what is sent to the executors; every document meets every block.

Words of items and documents are cut by one rule: parted by white space of any kind, case folded, letters and
digits alone. They are compared by hashes of 31 bits, so a short item may match a stranger whose words have the
same hashes: of one word about one in 2**31 distinct words, of more words the less.

Items of fewer than ``LEAST`` words leave no room for paraphrase: they match where their words stand side by
side. Defined cases: a null or empty text has no passage; items without a word, or null ones, match nothing;
repeated items match each under their own id; repeated rows of documents give one row per (doc_id, item_id); a
null doc_id is kept; texts of any length are searched to their end; of equally rare terms the first by name
are answer terms; no documents or no items give no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecroute.llm.common import materialise
from vecroute.llm.words import hash_words, split_codes

PART, LEAST, ITEMS = 256, 5, 2000
_NOT_WORD = re.compile(r"[\W_]+")
_NOT_WORD_OR_END = re.compile(r"(?:[^\w\n]|_)+")
#: ASCII's letters in lower case and digits; 0 for all other bytes.
_PLAIN = np.array([ord(chr(i).lower()) if i < 128 and chr(i).isalnum() else 0 for i in range(256)], np.uint8)
#: White space beyond ASCII's usual: file separators, next line, and Unicode's blanks.
_BLANKS = r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@dataclass(frozen=True)
class Parts:
    """The parts of a block of items, as arrays of term numbers; ``terms`` are the terms' hashes."""

    items: list[int]
    terms: np.ndarray
    words: list[np.ndarray]
    length: int = PART  # of the longest part that may be here

    def classes(self) -> list[tuple[Parts, np.ndarray]]:
        """The parts by length class, lengths up to 8, 16, 32, ...; with the numbers here of each class's terms."""
        level = np.array([max(3, (len(w) - 1).bit_length()) for w in self.words])
        out = []
        for x in np.unique(level):
            own = np.flatnonzero(level == x)
            terms = np.unique(np.concatenate([self.words[j] for j in own]))
            words = [np.searchsorted(terms, self.words[j]) for j in own]
            out.append((Parts([self.items[j] for j in own], self.terms[terms], words, 1 << int(x)), terms))
        return out


def plain_words(names: pa.Array) -> pa.Array:
    """Words as they are compared, for items and documents alike: case folded, letters and digits alone.

    Words of ASCII are mapped byte by byte, all at once; the others are folded as one text."""
    names = names.cast(pa.large_string())
    if not len(names):
        return names
    offsets = np.frombuffer(names.buffers()[1], np.int64)[names.offset : names.offset + len(names) + 1]
    data = np.frombuffer(names.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    mapped = _PLAIN[data]
    kept = mapped != 0
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(kept)])[offsets - offsets[0]]
    plain = pa.LargeStringArray.from_buffers(len(names), pa.py_buffer(ends), pa.py_buffer(mapped[kept]))
    mask = ~pc.string_is_ascii(names).to_numpy(zero_copy_only=False)
    if mask.any():
        other = names.filter(pa.array(mask))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(other)], pa.int32()), other), pa.scalar("\n", pa.large_string()))[0].as_py()
        folded = _NOT_WORD_OR_END.sub("", joined.casefold()).split("\n")
        if len(folded) != len(other):  # a word that holds a line's end
            folded = [_NOT_WORD.sub("", w.casefold()) for w in other.to_pylist()]
        plain = pc.replace_with_mask(plain, pa.array(mask), pa.array(folded, pa.large_string()))
    return plain


def has_blanks(names: pa.Array) -> bool:
    """Whether a word holds white space of other kinds than ASCII's; only bytes outside plain ASCII can."""
    names = names.cast(pa.large_string())
    odd = pc.or_(pc.invert(pc.string_is_ascii(names)), pc.invert(pc.ascii_is_printable(names)))
    return bool(pc.any(pc.match_substring_regex(names.filter(odd), pattern=_BLANKS)).as_py())


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row of each word, code of each word, the distinct words by ``plain_words``, "" among them perhaps).

    Words are parted by white space of any kind; a batch with other kinds than ASCII's is parted anew."""
    rows, codes, names = split_codes(texts)
    if has_blanks(names):
        rows, codes, names = split_codes(pc.replace_substring_regex(pc.fill_null(texts.cast(pa.large_string()), ""), pattern=_BLANKS, replacement=" "))
    return rows, codes, plain_words(names)


def normal_words(text: str | None) -> list[str]:
    """The words of one text."""
    _, codes, names = word_codes(pa.array([text or ""], pa.large_string()))
    names = names.to_pylist()
    return [names[c] for c in codes if names[c]]


def hashed(word: str) -> int:
    return int(hash_words(pa.array([word], pa.large_string()))[0])


def parts_of(rows: list) -> Parts | None:
    """Parts of (item_id, text) rows that have ``LEAST`` words; None if there are none."""
    items, words = [], []
    for item, text in rows:
        w = normal_words(text)
        if len(w) < LEAST:
            continue
        n = -(-len(w) // PART)
        for k in range(n):
            items.append(item)
            words.append(w[len(w) * k // n : len(w) * (k + 1) // n])
    if not words:
        return None
    names = sorted({x for w in words for x in w})
    number = dict(zip(names, range(len(names)), strict=True))
    return Parts(items, np.array([hashed(x) for x in names], np.int64), [np.array([number[x] for x in w], np.int64) for w in words])


def word_sequences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, ids): the hash of every word of each text, by ``word_codes``; words without a letter or digit
    are left out."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = rows.select("doc_id", F.array(F.lit(0)).alias("ids")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r, codes, plain = word_codes(b.column("text"))
            number = np.where(pc.equal(plain, "").to_numpy(zero_copy_only=False), -1, hash_words(plain))
            ids = number[codes] if len(plain) else np.zeros(0, np.int64)
            real = ids >= 0
            sizes = np.bincount(r[real], minlength=b.num_rows)
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids[real].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), lists], names=["doc_id", "ids"])

    return rows.mapInArrow(run, schema)


def numbering(terms: np.ndarray, numbers: np.ndarray):
    """A function from hashes to numbers, -1 for hashes that no term has.

    Few words are terms, so a table of the hashes' low bits lets most of them go without a search."""
    order = np.argsort(terms, kind="stable")
    known, numbers = terms[order], numbers[order].astype(np.int32)
    low = np.zeros(1 << 20, bool)
    low[known & 0xFFFFF] = True

    def look_up(ids: np.ndarray) -> np.ndarray:
        out = np.full(len(ids), -1, np.int32)
        maybe = np.flatnonzero(low[ids & 0xFFFFF])
        at = np.minimum(np.searchsorted(known, ids[maybe]), len(known) - 1)
        hit = known[at] == ids[maybe]
        out[maybe[hit]] = numbers[at[hit]]
        return out

    return look_up


def short_matches(sequences: DataFrame, rows: list) -> DataFrame | None:
    """Leaks of the (item_id, text) rows of fewer than ``LEAST`` words: documents in which they stand word by
    word; None if there are no such rows."""
    wanted: dict[tuple, list[int]] = {}
    for item, text in rows:
        w = normal_words(text)
        if 0 < len(w) < LEAST:
            wanted.setdefault(tuple(hashed(x) for x in w), []).append(item)
    if not wanted:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("ids")
            row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            docs, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for words, known in wanted.items():
                n = len(words)
                if len(flat) >= n:
                    at = np.flatnonzero(flat[: len(flat) - n + 1] == words[0])
                    for k in range(1, n):
                        at = at[(flat[at + k] == words[k]) & (row[at + k] == row[at])]
                    found = np.unique(row[at])
                    docs.append(np.repeat(found, len(known)))
                    items.append(np.tile(np.array(known, np.int64), len(found)))
            docs, items = np.concatenate(docs), np.concatenate(items)
            ones = pa.array(np.ones(len(docs)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(docs)), pa.array(items), ones, ones, ones], names=["doc_id", "item_id", "cosine", "common", "answered"])

    return sequences.mapInArrow(run, _leak_schema(sequences))


def _leak_schema(rows: DataFrame):
    schema = rows.select("doc_id", F.lit(0).cast("long").alias("item_id"), *(F.lit(0.0).alias(c) for c in ("cosine", "common", "answered"))).schema
    for f in schema:
        f.nullable = True
    return schema


def document_frequency(sequences: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, int]:
    """(number of documents with each term, number of documents)."""
    n_terms = len(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, docs, number = np.zeros(n_terms + 1, np.int64), 0, numbering(terms, np.arange(n_terms))
        for b in batches:
            lists = b.column("ids")
            rows = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = number(lists.flatten().to_numpy(zero_copy_only=False))
            on = ids >= 0
            pairs = np.unique(rows[on] * n_terms + ids[on])
            total[:n_terms] += np.bincount(pairs % n_terms, minlength=n_terms)
            docs += b.num_rows
        total[n_terms] = docs
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["t", "n"])

    found = np.zeros(n_terms + 1, np.int64)
    for r in sequences.select("ids").mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).collect():
        found[r["t"]] = r["n"]
    return found[:-1], int(found[-1])


def answer_terms(parts: Parts, df: np.ndarray) -> list[np.ndarray]:
    """The rarest third of each part's distinct terms, two at least."""
    out = []
    for w in parts.words:
        distinct = np.unique(w)
        order = np.lexsort((distinct, df[distinct]))
        out.append(np.sort(distinct[order[: max(2, len(distinct) // 3)]]))
    return out


@dataclass(frozen=True)
class Sought:
    """A length class of parts as ``passages`` looks for it: its answer terms, and the numbers of its terms among all."""

    parts: Parts
    terms: np.ndarray
    answers: list[np.ndarray]


def passages(sequences: DataFrame, terms: np.ndarray, classes: list[Sought], min_answer: float) -> DataFrame:
    """(doc_id, at, ids, length) of the passages that hold as many answer terms as some part of the class of that length
    demands; ``ids`` are terms of the class, -1 for other words. All classes are looked for in one pass."""
    schema = sequences.select("doc_id", F.lit(0).alias("at"), "ids", F.lit(0).alias("length")).schema
    for f in schema:
        f.nullable = True
    plans = []
    for c in classes:
        own = np.full(len(terms) + 1, -1, np.int32)  # the last stands for -1
        own[c.terms] = np.arange(len(c.terms))
        marked = np.zeros(len(c.terms) + 1, bool)
        marked[np.unique(np.concatenate(c.answers))] = True
        plans.append((c.parts.length, own, marked, max(1, min(int(np.ceil(min_answer * len(a))) for a in c.answers))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = numbering(terms, np.arange(len(terms)))
        for b in batches:
            lists = b.column("ids")
            every = number(lists.flatten().to_numpy(zero_copy_only=False))
            ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
            for step, own, marked, need in plans:
                flat = own[every]
                hits = np.concatenate([[0], np.cumsum(marked[flat])])
                row, at, out = [], [], []
                for i in np.flatnonzero(hits[ends[1:]] - hits[ends[:-1]] >= need):
                    a, z = ends[i], ends[i + 1]
                    starts = np.arange(a, max(a + 1, z - 2 * step), step)
                    stops = np.minimum(starts + 3 * step, z)
                    on = hits[stops] - hits[starts] >= need
                    for s, e in zip(starts[on], stops[on], strict=True):
                        row.append(i)
                        at.append(s - a)
                        out.append(flat[s:e])
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
                values = np.concatenate(out) if out else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(at, pa.int32()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32())), pa.array(np.full(len(row), step), pa.int32()),
                    ],
                    names=["doc_id", "at", "ids", "length"],
                )

    return sequences.select("doc_id", "ids").mapInArrow(run, schema)


def weighed(lists: list[np.ndarray], idf: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """(unit rows in sparse form: (row, term, weight), blanks left out; the rows' lengths before they are made 1)."""
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    ids = np.concatenate(lists) if lists else np.zeros(0, np.int64)
    on = ids >= 0
    pairs, tf = np.unique(row[on] * len(idf) + ids[on], return_counts=True)
    row, term = pairs // len(idf), pairs % len(idf)
    w = (1 + np.log(tf)) * idf[term]
    norm = np.sqrt(np.bincount(row, weights=w * w, minlength=len(lists)))
    return (row, term, w / np.maximum(norm[row], 1e-12)), norm


def tfidf(lists: list[np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit rows in sparse form: (row, term, weight); blanks are left out."""
    return weighed(lists, idf)[0]


def norms_of(lists: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    """Lengths of the TF-IDF vectors before ``tfidf`` makes them 1."""
    return weighed(lists, idf)[1]


def _project(sparse: tuple, basis: np.ndarray, n: int) -> np.ndarray:
    """Sparse rows times ``basis``; the rows of the sparse form follow each other."""
    row, term, w = sparse
    out = np.zeros((n, basis.shape[1]))
    if len(row):
        cut = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        parts = basis.astype(np.float32)[term]  # single precision: half the memory to pass through
        parts *= w.astype(np.float32)[:, None]
        out[row[cut]] = np.add.reduceat(parts, cut, axis=0)
    return out


def latent_basis(found: DataFrame, parts: Parts, idf: np.ndarray, k: int = 64, extra: int = 16, seed: int = 7) -> np.ndarray:
    """Right singular vectors (terms x k) of the passages' TF-IDF matrix, with the parts as rows too.

    The sketch of A'A is summed over all passages by Spark; the parts weigh as much as the passages.
    """
    n_terms = len(idf)
    width = min(k + extra, n_terms)
    omega = np.random.default_rng(seed).standard_normal((n_terms, width))
    names = [f"s{j}" for j in range(width)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z = np.zeros((n_terms, width))
        rows = 0
        for pdf in batches:
            row, term, w = sparse = tfidf([np.asarray(x) for x in pdf["ids"]], idf)
            y = _project(sparse, omega, len(pdf))
            order = np.argsort(term, kind="stable")
            turned = (term[order], row[order], w[order])  # the transpose, by term
            z += _project(turned, y, n_terms)
            rows += len(pdf)
        used = np.flatnonzero(np.abs(z).sum(axis=1))
        out = pd.DataFrame(z[used], columns=names)
        out.insert(0, "t", used)
        out.insert(1, "n", 0)
        yield pd.concat([out, pd.DataFrame([[-1, rows, *np.zeros(width)]], columns=out.columns)], ignore_index=True)

    schema = "t long, n long, " + ", ".join(f"{c} double" for c in names)
    sums = found.select("ids").mapInPandas(run, schema).groupBy("t").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in names)).toPandas()
    z = np.zeros((n_terms, width))
    real = sums[sums["t"] >= 0]
    z[real["t"].to_numpy(np.int64)] = real[names].to_numpy()
    count = max(1, int(sums["n"].sum()))
    own = tfidf(parts.words, idf)
    y = _project(own, omega, len(parts.words))
    order = np.argsort(own[1], kind="stable")
    z += max(1.0, count / len(parts.words)) * _project((own[1][order], own[0][order], own[2][order]), y, n_terms)
    core = omega.T @ z
    value, vector = np.linalg.eigh((core + core.T) / 2)
    good = value > value.max() * 1e-10
    factor = z @ (vector[:, good] / np.sqrt(value[good]))  # A'A is nearly factor @ factor.T
    left, size, _ = np.linalg.svd(factor, full_matrices=False)
    return left[:, : min(k, int((size > 0).sum()))]


def common_length(a: np.ndarray, masks: dict[int, int], n: int) -> int:
    """Longest common subsequence with a text of ``n`` words, whose places by word are bit masks."""
    state = full = (1 << n) - 1
    for x in a.tolist():
        m = masks.get(x)
        if m:
            u = state & m
            state = ((state + u) | (state - u)) & full
    return n - state.bit_count()


def search(
    found: DataFrame, parts: Parts, idf: np.ndarray, answers: list[np.ndarray], basis: np.ndarray,
    min_cosine: float, min_common: float, min_answer: float,
) -> DataFrame:
    """(doc_id, item_id, cosine, common, answered) of the passages that are leaks."""
    schema = _leak_schema(found)

    def length(x: np.ndarray) -> np.ndarray:
        return np.maximum(np.linalg.norm(x, axis=1), 1e-12)

    n_terms, n_parts = len(idf), len(parts.words)
    weight = norms_of(parts.words, idf)
    asked = np.concatenate(answers)  # answer terms and the parts that ask for them, by term
    by = np.argsort(asked, kind="stable")
    part_of = np.repeat(np.arange(n_parts), [len(a) for a in answers])[by]
    first = np.searchsorted(asked[by], np.arange(n_terms + 1))
    wanted = np.array([len(a) for a in answers])

    def answered_share(row: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Share of each part's answer terms in each passage; (row, term) pairs are distinct."""
        size = first[term + 1] - first[term]
        at = np.repeat(first[term] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        cell = np.repeat(row, size) * n_parts + part_of[at]
        return np.bincount(cell, minlength=n * n_parts).reshape(n, n_parts) / wanted

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        goal = _project(tfidf(parts.words, idf), basis, n_parts)
        own = length(goal)
        masks: list[dict[int, int] | None] = [None] * n_parts
        for pdf in batches:
            lists = [np.asarray(x) for x in pdf["ids"]]
            sparse, norms = weighed(lists, idf)
            latent = _project(sparse, basis, len(lists))
            whole = length(latent)
            near = latent @ goal.T / (whole[:, None] * own[None, :])
            # tfidf() makes rows of length 1, so lengths as they were before come from the weights' sums
            ratio = norms[:, None] * whole[:, None] / (weight * own)[None, :]
            answered = answered_share(sparse[0], sparse[1], len(lists))
            out = []
            for i, j in zip(*np.nonzero((near * np.maximum(1.0, ratio) >= min_cosine) & (answered >= min_answer)), strict=True):
                n = len(parts.words[j])
                if masks[j] is None:
                    places: dict[int, int] = {}
                    for p, t in enumerate(parts.words[j].tolist()):
                        places[t] = places.get(t, 0) | 1 << p
                    masks[j] = places
                # within stretches of twice the part's length, an eighth of it apart
                best = (0.0, 0.0)
                for at in range(0, max(1, len(lists[i]) - 2 * n + n // 4), max(1, n // 4)):
                    stretch = lists[i][at : at + 2 * n]
                    if (share := np.isin(answers[j], stretch).mean()) >= min_answer:
                        best = max(best, (common_length(stretch, masks[j], n) / n, share))
                if best[0] >= min_common:
                    out.append((pdf["doc_id"].iloc[i], parts.items[j], float(near[i, j]), best[0], float(best[1])))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "cosine", "common", "answered"])

    return found.mapInPandas(run, schema)


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    min_cosine: float = 0.3,
    min_common: float = 0.6,
    min_answer: float = 0.5,
) -> DataFrame:
    """(doc_id, item_id, cosine, common, answered): the best passage of every leak, over all documents."""
    items = benchmark.where(F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull()).select(
        F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text")
    )
    blocks = max(1, -(-items.count() // ITEMS))
    sequences = materialise(word_sequences(docs, id_col, text_col), "words")
    out = None
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).distinct().orderBy("item", "text").collect()
        rows = [tuple(r) for r in rows]
        hits = [short_matches(sequences, rows)]
        parts = parts_of(rows)
        if parts is not None:
            df, n = document_frequency(sequences, parts.terms)
            idf = np.log((n + 1) / (df + 0.5)).clip(min=0.05)
            classes = [Sought(group, terms, answer_terms(group, df[terms])) for group, terms in parts.classes()]
            held = materialise(passages(sequences, parts.terms, classes, min_answer), "passages", by=["length"])
            for c in classes:
                found, weights = held.where(F.col("length") == c.parts.length).drop("length"), idf[c.terms]
                basis = latent_basis(found, c.parts, weights)
                hits.append(search(found, c.parts, weights, c.answers, basis, min_cosine, min_common, min_answer))
        for one in hits:
            if one is not None:
                out = one if out is None else out.union(one)
    if out is None:
        return sequences.limit(0).select("doc_id", F.lit(0).cast("long").alias("item_id"), *(F.lit(0.0).alias(c) for c in ("cosine", "common", "answered")))
    return out.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("cosine", "common", "answered")))
