"""Mixing to target weights with soft memberships.

A multinomial classifier, fitted on a bounded sample of a labelled table, gives every document a
posterior over domains. Rates r >= 0, one per document, then solve

    minimise 1/2 |sum_d r_d n_d p_d - T|^2

over all documents d with n_d token ids and posterior p_d, where T are the wanted token totals of the
domains. From r = 1, each step of projected gradient (scaled by the domains' Gram matrix, of the size of
their number) is r_d <- max(floor, r_d - p_d . v): a pass over the documents sums up domain totals, and the
driver only sees those few numbers. A document's rate follows from its posterior and the list of v, so
no state is kept between the passes. ``floor`` is 0, or 1 where no document may be dropped.

Defined cases: null or empty texts have no tokens, the prior as posterior, and the rate that follows
from it; very long texts count whole; without labels there is a single domain; labels beyond
``max_domains`` are pooled as ``other``, and equally common labels are taken by name; rows that repeat in
the labelled sample count as often; domains without a target keep their natural total; a target of 0 is
allowed; targets that can't be reached are approached as far as the steps go, and a warning tells the gap.
Rows keep their number and the columns in ``keep`` stay, of which none may begin with two underscores.
"""

from __future__ import annotations

import warnings
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecroute.llm.common import materialise, release_memory
from vecroute.llm.encode import worker_store
from vecroute.llm.words import split_words

BINS = 2048


@dataclass(frozen=True)
class DomainModel:
    domains: list[str]
    weights: np.ndarray  # (BINS + 1, domains); the last row is the intercept


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors over hashed word beginnings and endings, word counts) of whole texts."""
    rows, codes, names = split_words(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    n = len(texts)
    counts = np.bincount(rows, minlength=n)
    x = np.zeros(n * BINS)
    if names:
        words = pa.array(names, pa.large_string())
        for mark, part in (("<", pc.utf8_slice_codeunits(words, 0, 3)), (">", pc.utf8_slice_codeunits(words, -3))):
            coded = part.dictionary_encode()
            bins = np.array([zlib.crc32((mark + w).encode()) % BINS for w in coded.dictionary.to_pylist()])
            of_word = bins[coded.indices.to_numpy(zero_copy_only=False)]
            x += np.bincount(rows * BINS + of_word[codes], minlength=n * BINS)
    x = np.sqrt(x.reshape(n, BINS))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12), counts


def posteriors(model: DomainModel, x: np.ndarray) -> np.ndarray:
    z = x @ model.weights[:-1] + model.weights[-1]
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def train_domains(
    labelled: DataFrame,
    label_col: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_rows: int = 2000,
    max_domains: int = 32,
    l2: float = 1e-4,
    steps: int = 200,
) -> DomainModel:
    """Fit on at most ``max_rows`` labelled rows, taken in the order of a hash of the id."""
    known = labelled.where(F.col(label_col).isNotNull())
    common = [r[0] for r in known.groupBy(label_col).count().orderBy(F.desc("count"), label_col).limit(max_domains + 1).collect()]
    if not common:
        return DomainModel(["all"], np.zeros((BINS + 1, 1)))
    named = [str(d) for d in common[: max_domains if len(common) > max_domains else None]]
    domains = sorted(named) + (["other"] if len(common) > max_domains else [])
    picked = known.select(
        F.xxhash64(F.col(id_col).cast("string"), F.lit("mixing")).alias("h"), F.col(label_col).cast("string").alias("y"), F.col(text_col).cast("string").alias("text")
    )
    # a range of the hash that holds about max_rows rows, then the first of them
    total = known.count()
    bound = int((min(1.0, 1.5 * max_rows / total) - 0.5) * 2.0**64) if total > max_rows else None
    if bound is not None:
        picked = picked.where(F.col("h") <= min(bound, 2**63 - 1))

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, _ = features(pa.Array.from_pandas(pdf["text"], type=pa.large_string()))
            yield pd.DataFrame({"h": pdf["h"], "y": pdf["y"], "x": [v.astype("<f4").tobytes() for v in x]})

    got = picked.mapInPandas(vectors, "h long, y string, x binary").orderBy("h", "y", "x").limit(max_rows).collect()
    x = np.stack([np.frombuffer(r["x"], "<f4") for r in got]).astype(float)
    x = np.hstack([x, np.ones((len(x), 1))])
    y = np.zeros((len(x), len(domains)))
    for i, r in enumerate(got):
        y[i, domains.index(r["y"]) if r["y"] in domains else len(domains) - 1] = 1
    w, last = np.zeros((BINS + 1, len(domains))), np.zeros((BINS + 1, len(domains)))
    for k in range(steps):  # accelerated gradient; rows have squared norm 2, so the curvature is below 1
        v = w + k / (k + 3) * (w - last)
        z = x @ v
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        last, w = w, v - 1.0 * (x.T @ (p - y) / len(x) + l2 * v)
    return DomainModel(domains, w)


def memberships(docs: DataFrame, model: DomainModel, keep: tuple[str, ...], tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """``keep`` columns of ``docs`` with ``__n_tokens`` (ids of the text) and ``__posterior`` (array of double)."""
    schema = docs.select(*keep, F.lit(0).cast("long").alias("__n_tokens"), F.array(F.lit(0.0)).alias("__posterior")).schema
    for f in schema:
        f.nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        k, store = len(model.domains), worker_store(tokenizer_path)
        for b in batches:
            x, _ = features(b.column(text_col))
            counts = store.count(b.column(text_col))
            p = posteriors(model, x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(p) * k + 1, k), pa.int32()), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in keep), pa.array(counts, pa.int64()), lists], names=[*keep, "__n_tokens", "__posterior"]
            )
        release_memory()

    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(run, schema)


def rates_of(p: np.ndarray, steps: list[np.ndarray], floor: float = 0.0) -> np.ndarray:
    r = np.ones(len(p))
    for v in steps:
        r = np.maximum(floor, r - p @ v)
    return r


def _sum_up(members: DataFrame, k: int, steps: list[np.ndarray], floor: float) -> tuple[np.ndarray, np.ndarray]:
    """(domain totals at the present rates, Gram matrix over documents whose rate is free to fall)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, gram = np.zeros(k), np.zeros((k, k))
        for pdf in batches:
            if len(pdf):
                p, n = np.stack(pdf["__posterior"].to_numpy()), pdf["__n_tokens"].to_numpy(float)
                r = rates_of(p, steps, floor)
                total += (r * n) @ p
                gram += (p * (n * ((r > floor) | (not steps)))[:, None]).T @ p
        release_memory()
        both = np.concatenate([total, gram.ravel()])
        yield pd.DataFrame({"i": np.arange(len(both)), "v": both})

    sums = members.select("__posterior", "__n_tokens").mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    both = np.zeros(k + k * k)
    for r in sums:
        both[r["i"]] = r["v"]
    return both[:k], both[k:].reshape(k, k)


def tempered(natural: np.ndarray, exponent: float, never_less: bool) -> np.ndarray:
    """Targets in proportion to natural totals to a power; either of the same sum, or scaled so that
    no domain's total falls."""
    t = np.where(natural > 0, np.maximum(natural, 1e-300) ** exponent, 0.0)
    if not t.sum():
        return t
    if never_less:
        return t * np.max(natural[t > 0] / t[t > 0])
    return t * natural.sum() / t.sum()


def fit_rates(
    members: DataFrame,
    domains: list[str],
    weights: dict[str, float] | None = None,
    exponent: float = 0.7,
    never_less: bool = False,
    floor: float = 0.0,
    tolerance: float = 1e-6,
    most_steps: int = 40,
) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(steps, targets, totals reached) for the rows of ``memberships``.

    ``weights`` are the wanted shares by domain; without them, totals are tempered by ``exponent``.
    """
    k = len(domains)
    steps: list[np.ndarray] = []
    natural, gram = _sum_up(members, k, steps, floor)
    if weights is None:
        target = tempered(natural, exponent, never_less)
    else:
        free = np.array([d not in weights for d in domains])
        share = np.array([weights.get(d, 0.0) for d in domains])
        target = np.where(free, natural, share / max(share.sum(), 1e-12) * natural[~free].sum())
    now = natural
    scale = max(natural.sum(), 1e-12)
    best = ([], natural)
    for _ in range(most_steps):
        gap = now - target
        if np.abs(gap).max() <= tolerance * scale:
            break
        steps = [*steps, np.linalg.lstsq(gram + 1e-12 * scale * np.eye(k), gap, rcond=None)[0]]
        now, gram = _sum_up(members, k, steps, floor)
        if np.abs(now - target).max() < np.abs(best[1] - target).max():
            best = (steps, now)
    if (miss := np.abs(best[1] - target).max()) > tolerance * scale:
        warnings.warn(f"token totals miss their targets by up to {miss / scale:.2g} of all tokens", stacklevel=2)
    return best[0], target, best[1]


def rate_column(posterior: Column, steps: list[np.ndarray], floor: float = 0.0) -> Column:
    """The rate of each document, in Spark expressions."""
    if not steps:
        return F.lit(1.0)
    table = F.array(*(F.array(*(F.lit(float(x)) for x in v)) for v in steps))
    dot = lambda v: F.aggregate(F.zip_with(posterior, v, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return F.aggregate(table, F.lit(1.0), lambda r, v: F.greatest(F.lit(float(floor)), r - dot(v)))


def mix(
    docs: DataFrame,
    labelled: DataFrame,
    label_col: str,
    keep: tuple[str, ...],
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    **settings,
) -> tuple[DataFrame, DomainModel, list[np.ndarray]]:
    """(``keep`` columns, n_tokens, posterior, domain, rate) of every row, the model and the steps."""
    model = train_domains(labelled, label_col, id_col, text_col)
    members = materialise(memberships(docs, model, keep, tokenizer_path, text_col), "memberships")
    steps, _, _ = fit_rates(members, model.domains, **settings)
    names = F.array(*(F.lit(d) for d in model.domains))
    p = F.col("__posterior")
    out = members.select(
        *keep,
        F.col("__n_tokens").alias("n_tokens"),
        p.alias("posterior"),
        F.get(names, F.array_position(p, F.array_max(p)).cast("int") - 1).alias("domain"),
        rate_column(p, steps, settings.get("floor", 0.0)).alias("rate"),
    )
    return out, model, steps


def copies(docs: DataFrame, rate: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row as often as its rate: the whole part, and one more with the chance of the rest.

    The draw is of the row: a hash of its id, its text and its place in the input's partitions, so rows that
    share an id or have none, or repeat as a whole, are drawn each on its own. A null rate gives none."""
    place = F.monotonically_increasing_id()
    draw = F.pmod(F.xxhash64(F.col(id_col), F.md5(F.col(text_col).cast("binary")), place, F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    n = F.floor(rate + draw).cast("int")
    cols = docs.columns
    return docs.withColumn("__n", n).where("__n >= 1").withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*cols)
