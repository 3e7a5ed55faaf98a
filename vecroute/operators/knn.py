"""Exact nearest neighbours of a query set among all vectors, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecroute.functions.distance import DENSE, matrix_of
from vecroute.functions.memory import give_back
from vecroute.functions.paths import shuffled_rank
from vecroute.functions.storage import materialise


def pair_distances(queries: np.ndarray, vectors: np.ndarray, metric: str) -> np.ndarray:
    """Distance of each row of one matrix to the same row of the other, in double precision."""
    if metric == "inner_product":
        return -(queries * vectors).sum(axis=1)
    if metric in ("angular", "cosine"):
        length = np.linalg.norm(queries, axis=1) * np.linalg.norm(vectors, axis=1)
        dots = (queries * vectors).sum(axis=1)
        return 1 - np.divide(dots, length, out=np.zeros_like(length), where=length > 0)
    return np.sqrt(((vectors - queries) ** 2).sum(axis=1))


def block_top_k(
    queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, metric: str, bound: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, distance) of each query's nearest ``k`` of a block; ties go to the lower id.

    One matrix product ranks all pairs up to rounding; those within reach of the k-th are measured anew.
    ``bound`` is each query's reach in the blocks before, infinite at first, and is lowered to that of this one:
    what lies beyond it isn't returned.
    """
    if metric == "euclidean":
        rough = (-2 * queries) @ vectors.T
        rough += (vectors**2).sum(axis=1)[None, :]
    else:
        rough = -queries @ vectors.T
    if metric in ("angular", "cosine"):
        for norm in (np.linalg.norm(queries, axis=1)[:, None], np.linalg.norm(vectors, axis=1)[None, :]):
            rough *= np.divide(1.0, norm, out=np.zeros_like(norm), where=norm > 0)
    slack = 1e-9 * (1 + max(rough.max(), -rough.min()))
    reach = np.full(len(queries), np.inf) if bound is None else bound
    inside = rough <= (reach + slack)[:, None]
    many = np.flatnonzero(inside.sum(axis=1) > k)
    if len(many):
        reach[many] = np.minimum(reach[many], np.partition(rough[many], k - 1, axis=1)[:, k - 1])
        inside[many] = rough[many] <= (reach[many] + slack)[:, None]
    row, col = np.nonzero(inside)
    exact = pair_distances(queries[row], vectors[col], metric)
    order = np.lexsort((ids[col], np.round(exact, 9), row))
    row, col, exact = row[order], col[order], exact[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    keep = place < k
    return row[keep], ids[col[keep]], exact[keep]


#: Pairs that are ranked at once, in double precision: 4 MB a matrix.
PAIRS = 1 << 19
#: Vectors of a block; few, since their lengths are taken anew for each block of queries.
VECTORS = 1 << 11
#: Rows that are added to a task's best before these are sorted and cut, at least.
FRESH = 1 << 18
#: Queries of a wave, as a task holds them.
WAVE_BYTES = 32 << 20


def _raw_matrix(lists: pa.Array) -> np.ndarray:
    """``matrix_of`` in the precision that the column has."""
    if lists.type.value_type != pa.float32():
        return matrix_of(lists)
    if lists.null_count or len(lists.value_lengths().unique()) > 1:
        raise ValueError("vectors must all have one width, and none may be null")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _cells(cells: pa.Array) -> Iterator[tuple[tuple, np.ndarray]]:
    """The distinct lists of a column with the rows that hold each."""
    rows: dict[tuple, list[int]] = {}
    for i, cell in enumerate(cells.to_pylist()):
        rows.setdefault(tuple(cell), []).append(i)
    for cell, held in rows.items():
        yield cell, np.array(held)


def _nearest(blocks: int, k: int, metric: str, least: int | None):
    """The best ``k`` of each query among a partition's vectors; the queries' ``blocks`` come first.

    With ``least``, a query meets the vectors whose cell has a leaf that it probes, and ``strict`` says if it
    probes ``least`` of them; others are of use only to a query that has none of those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        came, parts, probing = 0, [], []
        q, names, seen, bounds, by_leaf = None, None, None, {}, {}
        held: list[tuple] = []
        fresh = 0

        def reduced() -> tuple:
            one, ids, d, strict = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((ids, np.round(d, 9), ~strict, one))
            one, ids, d, strict = one[order], ids[order], d[order], strict[order]
            keep = (np.arange(len(one)) - np.searchsorted(one, one) < k) & (strict | ~seen[one])
            return one[keep], ids[keep], d[keep], strict[keep]

        def meet(asked: np.ndarray, m: np.ndarray, ids: np.ndarray, strict: bool) -> None:
            nonlocal fresh
            for a in range(0, len(m), VECTORS):
                near, own = m[a : a + VECTORS].astype(float), ids[a : a + VECTORS]
                step = max(1, PAIRS // len(near))
                for c in range(0, len(asked), step):
                    part = asked[c : c + step]
                    bound = bounds[strict][part]
                    row, found, d = block_top_k(q[part].astype(float), near, own, k, metric, bound)
                    bounds[strict][part] = bound
                    held.append((part[row], found, d, np.full(len(row), strict)))
                    fresh += len(row)
                    if fresh > max(FRESH, len(held[0][0])):  # so that a large state isn't sorted at every step
                        held[:] = [reduced()]
                        fresh = 0

        for b in batches:
            block = b.column(0).to_numpy()
            for i in np.flatnonzero(block >= 0):
                came += 1
                asked = b.column(1)[int(i)].values
                if asked is not None and len(asked):
                    parts.append((asked.field("query_id").to_numpy().copy(), _raw_matrix(asked.field("embedding")).copy()))
                    probing += asked.field("probed").to_pylist() if least is not None else []
            mine = b.filter(pa.array(block < 0))
            if not mine.num_rows:
                continue
            if came != blocks:
                raise ValueError(f"{came} of {blocks} blocks of queries came before the vectors")
            if q is None and parts:
                names, q = (np.concatenate(x) for x in zip(*parts, strict=True))
                parts, seen = [], np.zeros(len(names), bool)
                bounds = {strict: np.full(len(names), np.inf) for strict in (True, False)}
                lengths = [len(x) for x in probing]
                leaf = np.fromiter((x for own in probing for x in own), np.int64, sum(lengths))
                order = np.argsort(leaf, kind="stable")
                leaf, owner, probing = leaf[order], np.repeat(np.arange(len(lengths)), lengths)[order], []
                starts = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]]) if len(leaf) else []
                by_leaf = {int(leaf[x]): y for x, y in zip(starts, np.split(owner, starts[1:]), strict=True)} if len(leaf) else {}
            if q is None:
                continue
            m, ids = _raw_matrix(mine.column(3)), mine.column(2).to_numpy()
            if q.shape[1] != m.shape[1]:
                raise ValueError(f"queries of width {q.shape[1]}, vectors of width {m.shape[1]}")
            if least is None:
                meet(np.arange(len(q)), m, ids, True)
                continue
            weak = []
            for cell, near in _cells(mine.column(4)):
                owners = [by_leaf[x] for x in cell if x in by_leaf]
                if not owners:
                    continue
                asked, times = np.unique(np.concatenate(owners), return_counts=True)
                enough = asked[times >= least]
                seen[enough] = True
                if len(enough):
                    meet(enough, m[near], ids[near], True)
                if least > 1:
                    weak.append((asked[times < least], near))
            for asked, near in weak:
                asked = asked[~seen[asked]]
                if len(asked):
                    meet(asked, m[near], ids[near], False)
        if held:
            one, ids, d, strict = reduced()
            for a in range(0, len(one), 65_536):
                z = slice(a, a + 65_536)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (names[one[z]], ids[z], d[z], strict[z])], names=["query_id", "vec_id", "distance", "strict"])
            one = ids = d = strict = None
        q = names = seen = None
        held.clear(), bounds.clear(), by_leaf.clear()
        give_back()

    return run


def nearest_in_blocks(
    queries: DataFrame, vectors: DataFrame, k: int, metric: str = "euclidean", least: int | None = None, query_block: int | None = None,
    broadcast_bytes: int = WAVE_BYTES,
) -> DataFrame:
    """(query_id, rank from 0, vec_id, distance): each query's nearest ``k``; ties of nine digits go to the lower id.

    ``queries`` (query_id, embedding), ``vectors`` (vec_id, embedding). With ``least``, queries have ``probed``
    and vectors ``cell``, lists of leaves: a query meets the vectors with at least ``least`` leaves that it
    probes or, if there is none, those with any.

    Queries are dealt into blocks by a hash of the id (16 MB, unless ``query_block`` says how many rows) and
    broadcast. The first row of each partition of vectors brings the blocks to the task, once, so neither
    queries nor vectors are repeated; the task keeps the best ``k``, and a window takes the best of those.
    Queries whose measured size is within ``broadcast_bytes`` take one pass over the vectors, more take waves
    of that size, whose results are written before the next.
    """
    if metric not in DENSE:
        raise ValueError(f"{metric!r} can't be mined; one of {', '.join(DENSE)}")
    if k < 1:
        raise ValueError("k must be positive")
    listed = [] if least is None else ["probed"]
    wide = F.size("embedding") + (F.lit(0) if least is None else 2 * F.size("probed"))
    asked_rows, width = queries.agg(F.count("*"), F.max(wide)).first()
    size = asked_rows * max(1, width or 1) * 4
    n = max(1, -(-asked_rows // query_block) if query_block else -(-size // (16 << 20)))
    block = F.pmod(F.xxhash64("query_id"), F.lit(n)).cast("int").alias("block")
    asked = queries.select(block, F.struct("query_id", "embedding", *listed).alias("q"))
    asked = asked.groupBy("block").agg(F.collect_list("q").alias("asked"))
    rows = vectors.select("vec_id", "embedding", *([] if least is None else ["cell"]))
    rows = rows.withColumn("__first", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0)
    schema = "query_id long, vec_id long, distance double, strict boolean"

    def wave(first: int, last: int) -> DataFrame:
        near = asked.where(F.col("block").between(first, last - 1))
        brings = F.concat(F.sequence(F.lit(first), F.lit(last - 1)), F.array(F.lit(-1)))
        led = rows.withColumn("block", F.explode(F.when(F.col("__first"), brings).otherwise(F.array(F.lit(-1)))))
        led = led.join(F.broadcast(near), "block", "left").select("block", "asked", "vec_id", "embedding", *([] if least is None else ["cell"]))
        found = led.mapInArrow(_nearest(last - first, k, metric, least), schema)
        own = Window.partitionBy("query_id")
        place = F.row_number().over(own.orderBy(F.desc("strict"), F.round("distance", 9), "vec_id"))
        found = found.withColumn("rank", (place - 1).cast("int")).withColumn("__top", F.max("strict").over(own))
        return found.where((F.col("rank") < k) & (F.col("strict") == F.col("__top"))).select("query_id", "rank", "vec_id", "distance")

    if size <= broadcast_bytes:
        return wave(0, n)
    asked, out = materialise(asked, "asked"), None
    at_once = max(1, n * broadcast_bytes // size)  # blocks of a wave
    for first in range(0, n, at_once):
        part = materialise(wave(first, min(n, first + at_once)), "wave")
        out = part if out is None else out.unionByName(part)
    return out


def exact_knn(
    queries: DataFrame, vectors: DataFrame, k: int, metric: str = "euclidean", query_block: int | None = None,
    broadcast_bytes: int = WAVE_BYTES,
) -> DataFrame:
    """``nearest_in_blocks`` among all vectors, in single precision. Null vectors and differing widths are errors."""
    single = F.col("embedding").cast("array<float>").alias("embedding")
    return nearest_in_blocks(queries.select("query_id", single), vectors.select("vec_id", single), k, metric, None, query_block, broadcast_bytes)


def sample_ids(vectors: DataFrame, n: int, seed: int) -> DataFrame:
    """Exactly ``n`` rows (all, if there are fewer), by the order of a seeded hash of their ids.

    Only ids are ranked, in 4,096 ranges of the hash; the rows themselves are then picked by a semi-join."""
    picked = shuffled_rank(vectors.select("vec_id"), seed).where(F.col("rank") < n).select("vec_id")
    return vectors.join(picked, "vec_id", "left_semi")


def mine_labels(
    queries: DataFrame, vectors: DataFrame, top_k: int, subset_size: int | None, seed: int, metric: str = "euclidean"
) -> DataFrame:
    """Neighbours within a seeded sample of the vectors, or exactly if the sample is all of them.

    A query that is in the sample finds itself first.
    """
    if subset_size is not None and subset_size < vectors.count():
        vectors = sample_ids(vectors, subset_size, seed)
    return exact_knn(queries, vectors, top_k, metric)


def linspace_sample(rows: DataFrame, n: int, index_col: str = "i") -> DataFrame:
    """``n`` rows evenly spaced by an index 0..m-1 (all, if there are no more): the i-th at
    floor(i (m - 1) / (n - 1))."""
    m = rows.count()
    if n >= m:
        return rows
    wanted = rows.sparkSession.range(n).select(F.expr(f"cast(floor(id * {m - 1}D / {max(1, n - 1)}D) as long)").alias(index_col))
    return rows.join(wanted.distinct(), index_col, "left_semi")
