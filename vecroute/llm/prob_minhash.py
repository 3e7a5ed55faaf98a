"""Near-duplicate documents by ProbMinHash, banding and verification.

Documents are weighted sets of shingles of five words, weight 1 + ln(occurrences). Every shingle is a
Poisson process whose rate is its weight: its arrivals, drawn from a hash of the shingle, fall on random
registers, and a register keeps the shingle that arrived first. A text's processes end early, once they
have passed the latest first arrival. The share of registers on which two texts agree estimates their
probability Jaccard similarity. Bands of registers give buckets. A text that repeats shingles is in the
buckets of its unit-weight signature, too, as what it repeats would push a near-copy without the repeats
far below that similarity; for other texts the two signatures are one.

A link is an exact Jaccard similarity of the distinct shingles of ``threshold`` or more. Of candidates,
only those are verified whose unit-weight registers agree on a share of ``threshold - SLACK`` or more: that
share estimates the similarity with a standard error below 0.04 at 0.8, so that a pair over the threshold
falls under the bound less often than once in a billion.

Groups stay cheap and whole: equal texts are one node; in a bucket each node is compared with the least
node (a star), never all with all; links are joined into components. Then, only in buckets that still
hold more than one component (each set of nodes once), registers are compared inside bounded blocks, and
only the shingles of nodes that have a candidate of another component in a block are sent to it. A block
emits only links that join components, fewer than it has nodes: no link between different texts of a bucket
is lost, and no pairs are written.

Defined cases: words are white-space runs as they stand; a text of one to four words is one shingle; a
text without a word (or null) is in no bucket and is a class of its own; repeated rows and equal texts
share a class; a null id can't name a class, so classes are named by the least id that isn't null, or
null if there is none; very long texts are read whole, and blocks hold the fewer the longer they are;
further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecroute.llm.common import materialise, release_memory
from vecroute.llm.components import components
from vecroute.llm.words import split_words

WORDS = 5
BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
SLACK = 0.25

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all shingles, repeats too; offsets of the texts)."""
    rows, codes, names = split_words(texts)
    n = len(texts)
    starts = np.searchsorted(rows, np.arange(n + 1))
    sizes = np.diff(starts)
    h = np.fromiter((xxhash.xxh64_intdigest(w) for w in names), np.uint64, len(names))[codes] if names else np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        if len(h) >= WORDS:
            acc = h[: len(h) - WORDS + 1].copy()
            for k in range(1, WORDS):
                acc = _mix(acc * _GOLDEN + h[k : len(h) - WORDS + 1 + k])
        else:
            acc = np.zeros(0, np.uint64)
        full = np.flatnonzero(rows[: len(acc)] == rows[WORDS - 1 :][: len(acc)]) if len(acc) else np.zeros(0, np.int64)
        short = np.flatnonzero((sizes > 0) & (sizes < WORDS))
        extra = np.zeros(len(short), np.uint64)
        for j, r in enumerate(short):
            a = np.uint64(sizes[r])
            for x in h[starts[r] : starts[r + 1]]:
                a = _mix(np.array([a * _GOLDEN + x], np.uint64))[0]
            extra[j] = a
    values = np.concatenate([acc[full], extra])
    owner = np.concatenate([rows[full], short])
    order = np.argsort(owner, kind="stable")
    return values[order], np.searchsorted(owner[order], np.arange(n + 1))


def signature(elements: np.ndarray, weights: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """The shingle that arrives first at each of ``m`` registers."""
    first = np.full(m, np.inf)
    sig = np.zeros(m, np.uint64)
    at = np.zeros(len(elements))
    done = 0
    with np.errstate(over="ignore"):
        while len(elements):
            k = max(1, -(-900 // len(elements)))  # arrivals of each process to draw at once
            steps = np.arange(done + 1, done + k + 1, dtype=np.uint64)
            r = _mix(elements[:, None] + steps[None, :] * _GOLDEN)
            gaps = -np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weights[:, None]
            times = at[:, None] + np.cumsum(gaps, axis=1)
            place = (_mix(r ^ _GOLDEN) % np.uint64(m)).astype(np.int64).ravel()
            flat = times.ravel()
            np.minimum.at(first, place, flat)
            won = flat == first[place]
            sig[place[won]] = np.repeat(elements, k)[won]
            at, done = times[:, -1], done + k
            go = at < first.max()
            elements, weights, at = elements[go], weights[go], at[go]
    return sig


def band_keys(sigs: np.ndarray) -> np.ndarray:
    """One 64-bit key a band of each signature (rows)."""
    with np.errstate(over="ignore"):
        parts = sigs.reshape(len(sigs), BANDS, ROWS)
        acc = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLDEN, (len(sigs), BANDS)).copy()
        for j in range(ROWS):
            acc = _mix(acc * _GOLDEN + parts[:, :, j])
    return acc.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release_memory()
    for b in batches:
        values, ends = shingles(b.column("text"))
        sigs = np.zeros((b.num_rows, REGISTERS), np.uint64)
        unit = sigs.copy()
        again = []
        has = ends[1:] > ends[:-1]
        for i in np.flatnonzero(has):
            elements, counts = np.unique(values[ends[i] : ends[i + 1]], return_counts=True)
            sigs[i] = unit[i] = signature(elements, 1 + np.log(counts))
            if len(elements) > 1 and counts.max() > 1:
                again.append(i)
                unit[i] = signature(elements, np.ones(len(elements)))
        keys = [k if x else k[:0] for k, x in zip(band_keys(sigs), has, strict=True)]
        for i, k in zip(again, band_keys(unit[again]), strict=True):
            keys[i] = np.union1d(keys[i], k)
        offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
        flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        short = _mix(unit).astype(np.uint16)  # registers are compared, never read: 16 bits tell them apart
        yield pa.RecordBatch.from_arrays(
            [
                b.column("id"),
                b.column("node"),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64())),
                pa.array([r.tobytes() for r in short], pa.binary()),
                pa.array(has),
            ],
            names=["id", "node", "bands", "registers", "worded"],
        )
    release_memory()


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, node, bands, registers, worded); ``node`` is the MD5 of the text, null if it is null."""
    rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(F.col(text_col).cast("binary"))).alias("node"), F.col(text_col).cast("string").alias("text"))
    schema = rows.select("id", "node", F.array(F.lit(0).cast("long")).alias("bands"), F.lit(b"").alias("registers"), F.lit(True).alias("worded")).schema
    for f in schema:
        f.nullable = True
    return rows.mapInArrow(_sign, schema)


def registers_of(column: pa.Array | pd.Series) -> np.ndarray:
    """Signatures as rows of a matrix."""
    values = column.to_pylist() if isinstance(column, pa.Array) else column
    return np.frombuffer(b"".join(values), np.uint16).reshape(-1, REGISTERS)


def likely(pairs: DataFrame, nodes: DataFrame, bound: float) -> DataFrame:
    """The pairs (a, b) of which ``bound`` of the registers agree; ``nodes``: (node, registers)."""
    one = nodes.select(F.col("node").alias("a"), F.col("registers").alias("x"))
    two = nodes.select(F.col("node").alias("b"), F.col("registers").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same = (registers_of(b.column("x")) == registers_of(b.column("y"))).mean(axis=1)
            yield b.filter(pa.array(same >= bound)).select(["a", "b"])

    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def enough_in_common(x: np.ndarray, y: np.ndarray, threshold: float) -> bool:
    """Whether two sets, sorted, have a Jaccard similarity of ``threshold`` or more."""
    if min(len(x), len(y)) < threshold * max(len(x), len(y)):
        return False
    if len(x) > len(y):
        x, y = y, x
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return both >= threshold * (len(x) + len(y) - both)


def verify(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose shingles are similar; ``sets`` has a row (node, shingles) per node."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            read = lambda v: np.frombuffer(v.as_buffer(), np.uint64)
            keep = [enough_in_common(read(x), read(y), threshold) for x, y in zip(b.column("x"), b.column("y"), strict=True)]
            yield b.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def _sets_of(docs: DataFrame, nodes: DataFrame, members: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, shingles) of ``nodes``: the distinct shingles, sorted, of the text of one document each."""
    one = members.groupBy("node").agg(F.min("id").alias("id")).join(nodes.distinct(), "node", "left_semi")
    with_id = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(
        one.select("id"), "id", "left_semi"
    )
    of_text = F.unhex(F.md5(F.col("text").cast("binary")))
    found = with_id.withColumn("node", of_text).join(one, ["id", "node"], "left_semi").select("node", "text")
    # texts that only rows without an id have
    bare = docs.where(F.col(id_col).isNull()).select(F.col(text_col).cast("string").alias("text")).withColumn("node", of_text)
    bare = bare.join(one.where("id is null"), "node", "left_semi").select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, ends = shingles(b.column("text"))
            sets = [np.unique(values[a:z]).tobytes() for a, z in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(sets, pa.binary())], names=["node", "shingles"])
        release_memory()

    return found.union(bare).mapInArrow(run, "node binary, shingles binary").dropDuplicates(["node"])


BLOCK = ["bucket", "c", "d"]


def by_block(work):
    """Turn a function of one block's rows into one of batches in which the rows of a block follow each other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            keys = pdf[BLOCK].to_numpy(np.int64)
            cut = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            bounds = [0, *cut, len(pdf)]
            for a, z in zip(bounds[:-1], bounds[1:], strict=True):
                part = pdf.iloc[a:z]
                if len(part) and held and tuple(held[0][BLOCK].iloc[0]) != tuple(keys[a]):
                    yield work(pd.concat(held))
                    held = []
                if len(part):
                    held.append(part)
        if held:
            yield work(pd.concat(held))

    return run


def agreeing(registers: np.ndarray, comp: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, share of registers) of the pairs of a block that lie in different components and may be similar."""
    rows, cols, shares = [], [], []
    for i in range(len(registers) - 1):
        other = np.flatnonzero(comp[i + 1 :] != comp[i]) + i + 1
        same = (registers[other] == registers[i]).mean(axis=1)
        hit = same >= bound
        rows.append(np.full(int(hit.sum()), i))
        cols.append(other[hit])
        shares.append(same[hit])
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, cols, shares))


def _active(bound: float):
    """The rows of a block that have a possible link to another component there."""

    def work(block: pd.DataFrame) -> pd.DataFrame:
        i, j, _ = agreeing(registers_of(block["registers"]), pd.factorize(block["comp"])[0], bound)
        return block.iloc[np.union1d(i, j).astype(np.int64)]

    return by_block(work)


def _block_links(threshold: float, bound: float):
    """Links between different components within a block, fewer than its rows."""

    def work(block: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(x, np.uint64) for x in block["shingles"]]
        comp = pd.factorize(block["comp"])[0]
        i, j, share = agreeing(registers_of(block["registers"]), comp, bound)
        node, out = block["node"].to_numpy(object), []
        for k in np.argsort(-share, kind="stable"):
            a, b = int(i[k]), int(j[k])
            if comp[a] != comp[b] and enough_in_common(sets[a], sets[b], threshold):
                comp[comp == comp[b]] = comp[a]
                out.append((node[a], node[b]))
        return pd.DataFrame(out, columns=["a", "b"])

    return by_block(work)


def _open_links(
    buckets: DataFrame, comps: DataFrame, nodes: DataFrame, sets: DataFrame, threshold: float, block: int = 256, block_bytes: int = 8 << 20
) -> DataFrame:
    """Links between different components that share a bucket.

    The nodes of a bucket are dealt into as many parts as keep each below about ``block`` nodes and
    ``block_bytes`` of shingles; every two parts meet in one task as a block. Buckets with the same nodes are
    taken once.
    """
    known = buckets.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    sizes = (
        known.groupBy("bucket")
        .agg(
            F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n"),
            F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"),
        )
        .where("lo <> hi")
        .groupBy("n", "x", "y")
        .agg(F.min("bucket").alias("bucket"))
    )
    inside = materialise(known.join(sizes.select("bucket"), "bucket").select("bucket", "node", "comp"), "open")
    weighed = sets.select("node", F.octet_length("shingles").alias("bytes"))
    parts = (
        inside.join(weighed, "node")
        .groupBy("bucket")
        .agg(F.ceil(F.greatest(F.count("*") / block, F.sum("bytes") / block_bytes)).cast("int").alias("parts"))
    )
    dealt = (
        inside.join(parts, "bucket")
        .withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .where((F.col("parts") == 1) | (F.col("part") != F.col("other")))  # a part meets itself in any block
        .select("bucket", "node", "comp", F.least("part", "other").alias("c"), F.greatest("part", "other").alias("d"))
    )
    bound = threshold - SLACK

    def together(rows: DataFrame) -> DataFrame:
        return rows.repartition(*BLOCK).sortWithinPartitions(*BLOCK, "node")

    marked = together(dealt.join(nodes.select("node", "registers"), "node"))
    active = materialise(marked.mapInPandas(_active(bound), marked.schema), "active")
    return together(active.join(sets, "node")).mapInPandas(_block_links(threshold, bound), "a binary, b binary")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8
) -> DataFrame:
    """(id, class_id): every row of ``docs`` with the least id of its class of near-duplicates."""
    return text_classes(docs, id_col, text_col, threshold).select("id", "class_id")


def text_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8
) -> DataFrame:
    """(id, node, comp, class_id): every row with the MD5 of its text, and its class by a node that is the
    same for all of the class (null for a text without a word) and by the least id."""
    members = materialise(signatures(docs, id_col, text_col), "signatures")
    worded = members.where("worded")
    nodes = worded.groupBy("node").agg(F.first("bands").alias("bands"), F.first("registers").alias("registers"), F.min("id").alias("id"))
    nodes = materialise(nodes, "nodes")
    buckets = nodes.select("node", F.explode("bands").alias("bucket"))
    heads = buckets.groupBy("bucket").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1")
    shared = materialise(buckets.join(heads, "bucket").select("bucket", "node", "b"), "buckets")
    stars = shared.where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    stars = materialise(likely(stars, nodes, threshold - SLACK), "stars")
    sets = materialise(_sets_of(docs, shared.select("node"), nodes.select("node", "id"), id_col, text_col), "shingles")
    links = materialise(verify(stars, sets, threshold), "links")
    comps = components(links)
    more = materialise(_open_links(shared.select("bucket", "node"), comps, nodes, sets, threshold), "links")
    if more.limit(1).count():
        comps = components(links.union(more))
    named = nodes.select("node", "id").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = named.groupBy("comp").agg(F.min("id").alias("class_id"))
    classes = named.join(least, "comp").select("node", "comp", "class_id")
    single = members.where("not worded").select("id", "node", F.lit(None).cast("binary").alias("comp"), F.col("id").alias("class_id"))
    return worded.select("id", "node").join(classes, "node").select("id", "node", "comp", "class_id").union(single)
