"""Toxicity: logistic regression over hashed word features, regularised by counterfactuals.

A text's features are its distinct lower-case words and their prefixes of 4 to 6 letters, hashed into a
fixed number of bins. Training takes at most ``max_rows`` labelled texts (in the order of a hash of the
id), counts for every bin how many texts of either label have it, keeps the bins whose likelihood ratio is
``min_ratio`` or more, at most ``n_features`` of them, and fits their weights by gradient steps on

    log loss (both labels weigh the same in all) + l2 |w|^2 + counterfactual * mean (z(x) - z(x'))^2

where z is the log odds and x' is x with its terms of some group swapped for others of it. Groups are those of
``identity_groups``: names for people, in four languages. All their terms have weights, which the penalty drives
together, so a neutral mention of a group carries no score of its own. Texts without such a term have no x', and
where no labelled text has one the fit is that without the penalty.

Defined cases: null and empty texts have no features and get the score of the intercept. Without labelled
rows of both classes every score is 0. An id with several labels counts as toxic if one says so; several
texts under one labelled id are all trained on. Equal ratios are taken by bin. Very long texts are read
whole. Rows keep their number, repeated ones too, and columns other than those named don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecroute.llm.words import split_words

# Groups of terms for people that may be swapped for each other, in en, es, fr and de.
IDENTITY_GROUPS = [
    ["women", "men", "girls", "boys"],
    ["woman", "man", "girl", "boy"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["black", "white", "asian", "latino", "arab"],
    ["gay", "straight", "lesbian", "bisexual", "transgender"],
    ["immigrants", "refugees", "natives", "foreigners"],
    ["disabled", "deaf", "blind", "elderly", "young"],
    ["mujeres", "hombres", "niñas", "niños"],
    ["musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"],
    ["negros", "blancos", "asiáticos", "latinos", "árabes"],
    ["gais", "lesbianas", "bisexuales", "transexuales"],
    ["inmigrantes", "refugiados", "extranjeros", "gitanos"],
    ["femmes", "hommes", "filles", "garçons"],
    ["musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"],
    ["noirs", "blancs", "asiatiques", "arabes"],
    ["homosexuels", "lesbiennes", "bisexuels", "transgenres"],
    ["immigrés", "réfugiés", "étrangers", "roms"],
    ["frauen", "männer", "mädchen", "jungen"],
    ["muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"],
    ["schwarze", "weiße", "asiaten", "araber"],
    ["schwule", "lesben", "bisexuelle", "transsexuelle"],
    ["einwanderer", "flüchtlinge", "ausländer", "einheimische"],
]

BINS = 1 << 18


@dataclass(frozen=True)
class ToxicityModel:
    bins: np.ndarray  # the bins that have a weight
    weights: np.ndarray
    intercept: float


def word_bins(word: str) -> list[int]:
    """Bins of a word's features."""
    keys = ["=" + word] + [f"{k}{word[:k]}" for k in (4, 5, 6) if len(word) > k]
    return [zlib.crc32(k.encode()) % BINS for k in keys]


def bins_of(words: list[str]) -> np.ndarray:
    """``word_bins`` of many words, a row each; -1 where a word is too short for a prefix. Prefixes repeat, so
    each is hashed once."""
    out = np.full((len(words), 4), -1, np.int64)
    out[:, 0] = np.fromiter((zlib.crc32(b"=" + w.encode()) % BINS for w in words), np.int64, len(words))
    column = pa.array(words, pa.large_string())
    length = pc.utf8_length(column).to_numpy(zero_copy_only=False)
    for j, k in enumerate((4, 5, 6), 1):
        part = pc.utf8_slice_codeunits(column, 0, k).dictionary_encode()
        bins = np.array([zlib.crc32(f"{k}{x}".encode()) % BINS for x in part.dictionary.to_pylist()], np.int64)
        on = length > k
        out[on, j] = bins[part.indices.to_numpy(zero_copy_only=False)[on]]
    return out


def text_bins(texts: pd.Series, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bin) pairs of whole texts; only the bins marked in ``wanted``, if that is given."""
    rows, codes, names = split_words(pa.Array.from_pandas(texts, type=pa.large_string()), letters_only=True)
    if not names:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bins = bins_of(names)
    good = bins >= 0 if wanted is None else (bins >= 0) & wanted[bins]
    on = good.any(axis=1)[codes]
    pairs = np.unique(rows[on] * len(names) + codes[on])
    rows, codes = pairs // len(names), pairs % len(names)
    row, place = np.nonzero(good[codes])
    both = np.unique(rows[row] * BINS + bins[codes[row], place])
    return both // BINS, both % BINS


def swap_terms(text: str, groups: list[list[str]]) -> str | None:
    """The text with each identity term replaced by the next one of its group; None if it has none."""
    to = {t: g[(i + 1) % len(g)] for g in reversed(groups) for i, t in enumerate(g)}  # the first group that has a term
    words = (text or "").lower().split()
    bare = [w.strip(".,;:!?\"'()*#$%&|<>") for w in words]
    if not any(b in to for b in bare):
        return None
    return " ".join(w.replace(b, to[b]) if b in to else w for w, b in zip(words, bare, strict=True))


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int) -> DataFrame:
    """At most ``max_rows`` labelled texts; only their ids, a bounded set, are broadcast."""
    picked = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("__id"))
        .agg(F.max(label_col).cast("double").alias("y"))
        .orderBy(F.xxhash64(F.col("__id").cast("string"), F.lit("toxicity")), "__id")
        .limit(max_rows)
    )
    texts = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).cast("string").alias("text"))
    return texts.join(F.broadcast(picked), F.col("__doc") == F.col("__id")).select("__id", "text", "y")


def _count_bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    toxic, clean = np.zeros(BINS, np.int64), np.zeros(BINS, np.int64)
    for pdf in batches:
        rows, bins = text_bins(pdf["text"])
        hot = pdf["y"].to_numpy()[rows] > 0.5
        toxic += np.bincount(bins[hot], minlength=BINS)
        clean += np.bincount(bins[~hot], minlength=BINS)
    used = np.flatnonzero(toxic + clean)
    yield pd.DataFrame({"bin": used, "toxic": toxic[used], "clean": clean[used]})


def _likelihood_ratio(a: np.ndarray, b: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """G statistic of each bin's 2x2 table: a of n1 toxic texts have it, b of n0 clean ones."""
    table = np.stack([a, b, n1 - a, n0 - b]).astype(float)
    have, total = a + b, n1 + n0
    fit = np.stack([have * n1, have * n0, (total - have) * n1, (total - have) * n0]) / total
    with np.errstate(divide="ignore", invalid="ignore"):
        return 2 * np.where(table > 0, table * np.log(table / fit), 0).sum(axis=0)


def _fit(x: np.ndarray, y: np.ndarray, twins: np.ndarray, counterfactual: float, l2: float, steps: int):
    """Weights and intercept by accelerated gradient steps; ``twins``: x - x' of the swapped texts."""
    w, b = np.zeros(x.shape[1]), 0.0
    share = np.where(y > 0.5, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    last_w, last_b = w.copy(), b
    bend, direction = 0.0, np.full(x.shape[1] + 1, (x.shape[1] + 1) ** -0.5)
    for _ in range(40):  # power steps to the largest curvature, with room for what they still lack
        turned = np.append(x.T @ (share * (x @ direction[:-1] + direction[-1])), share @ (x @ direction[:-1] + direction[-1])) / 4
        if len(twins):
            turned[:-1] += 2 * counterfactual * (twins.T @ (twins @ direction[:-1])) / len(twins)
        bend = float(np.linalg.norm(turned))
        direction = turned / max(bend, 1e-12)
    rate = 1.0 / (1.2 * bend + 2 * l2 + 1e-9)
    for k in range(steps):
        m = k / (k + 3)
        vw, vb = w + m * (w - last_w), b + m * (b - last_b)
        p = 1 / (1 + np.exp(-np.clip(x @ vw + vb, -40, 40)))
        g = share * (p - y)
        gw = x.T @ g + 2 * l2 * vw
        if len(twins):
            gw += 2 * counterfactual * (twins.T @ (twins @ vw)) / len(twins)
        last_w, last_b = w, b
        w, b = vw - rate * gw, vb - rate * float(g.sum())
    return w, b


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    identity_groups: list[list[str]] | None = None,
    max_rows: int = 10_000,
    n_features: int = 768,
    min_ratio: float = 10.83,
    counterfactual: float = 1.0,
    l2: float = 2e-4,
    steps: int = 600,
) -> ToxicityModel:
    """Fit on at most ``max_rows`` labelled texts: the driver gets their selected bins, never the texts.

    The default ``min_ratio`` is what a bin without meaning reaches once in a thousand times."""
    groups = list(IDENTITY_GROUPS if identity_groups is None else identity_groups)
    rows = _sample(docs, labels, id_col, text_col, label_col, max_rows)
    counts = (
        rows.mapInPandas(_count_bins, "bin long, toxic long, clean long")
        .groupBy("bin")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where("toxic + clean >= 3")
        .toPandas()
    )
    totals = rows.agg(F.sum("y"), F.count("y")).first()
    n1, n = float(totals[0] or 0), int(totals[1] or 0)
    if not n1 or n1 == n or counts.empty:
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), -np.inf)
    ratio = _likelihood_ratio(counts["toxic"].to_numpy(), counts["clean"].to_numpy(), n1, n - n1)
    counts = counts.assign(ratio=ratio).sort_values(["ratio", "bin"], ascending=[False, True])
    identity = {b for g in groups for t in g for b in word_bins(t)}
    telling = counts[counts["ratio"] >= min_ratio]["bin"].head(n_features)
    chosen = np.array(sorted({*telling, *(identity & {*counts["bin"]})}), np.int64)

    def design(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def of(texts: pd.Series) -> list[list[int]]:
            r, b = text_bins(texts)
            at = np.searchsorted(chosen, b)
            hit = (at < len(chosen)) & (chosen[np.minimum(at, len(chosen) - 1)] == b)
            r, at = r[hit], at[hit]
            ends = np.searchsorted(r, np.arange(len(texts) + 1))
            return [at[i:j].tolist() for i, j in zip(ends, ends[1:], strict=False)]

        for pdf in batches:
            swapped = [swap_terms(t, groups) for t in pdf["text"]]
            other = of(pd.Series([s or "" for s in swapped], dtype=object))
            yield pd.DataFrame(
                {"y": pdf["y"], "x": of(pdf["text"]), "other": [o if s else None for o, s in zip(other, swapped, strict=True)]}
            )

    got = rows.mapInPandas(design, "y double, x array<int>, other array<int>").collect()
    x, y = np.zeros((len(got), len(chosen))), np.array([r["y"] for r in got])
    twins = np.zeros((sum(r["other"] is not None for r in got), len(chosen)))
    k = 0
    for i, r in enumerate(got):
        x[i, r["x"]] = 1
        if r["other"] is not None:
            twins[k, r["x"]] += 1
            twins[k, r["other"]] -= 1
            k += 1
    w, b = _fit(x, y, twins, counterfactual, l2, steps)
    return ToxicityModel(chosen, w, b)


def score_texts(model: ToxicityModel, texts: pd.Series, table: np.ndarray) -> np.ndarray:
    """Scores of whole texts; ``table``: the weight of every bin."""
    rows, bins = text_bins(texts, table != 0)
    z = model.intercept + np.bincount(rows, weights=table[bins], minlength=len(texts))
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-z))


def predict(model: ToxicityModel, text: Column) -> Column:
    """Score of each text, 0 to 1."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = np.zeros(BINS)
        table[model.bins] = model.weights
        for texts in batches:
            yield pd.Series(score_texts(model, texts, table))

    return run(text.cast("string"))
