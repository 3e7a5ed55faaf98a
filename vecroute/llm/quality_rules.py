"""Quality rules: text statistics and a learned decision list, in Spark expressions only.

``text_stats`` adds the statistics; ``learn_rules`` grows and prunes threshold conjunctions by
sequential covering over labelled statistics; ``verdict`` turns the ordered rules into one ``CASE``
expression. Statistics are computed for whole texts by built-in functions: no Python runs on the
executors. The covering itself works on at most ``max_rows`` labelled rows of statistics (a dozen
numbers each), taken in the order of a hash of their id.

Defined cases: a null or empty text has no words and all counts 0; base rules then fail it. Without
usable labels (none, or of one class) the list is empty and only the base rules decide. Rows keep
their number: repeated ids give repeated rows. Other columns stay, but one named as a statistic is replaced.
Of labelled rows of equal hash the smaller id comes first; of tests of equal gain the first in the order of
``FEATURES`` and of falling bounds is taken. Several labels of one id count as the least.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters that part words, and the characters that count as symbols.
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks"]


def text_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns of ``STATS`` (long) in place of the text."""
    keep = [c for c in docs.columns if c != text_col and c not in STATS]
    t = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split("__t", "\n"), lambda x: x.rlike(NOT_SPACE))
    one = (
        docs.select(*keep, t.alias("__t"))
        .withColumn("__w", F.array_remove(F.split("__t", SPACE), ""))
        .withColumn("__l", lines)
        .select(
            *keep,
            F.size("__w").cast("long").alias("n_words"),
            F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
            F.regexp_count("__t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
            F.size("__l").cast("long").alias("n_lines"),
            F.regexp_count("__t", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
            F.regexp_count("__t", F.lit("[!?]")).cast("long").alias("n_marks"),
            F.transform("__w", lambda x: F.xxhash64(x)).alias("__h"),
        )
    )
    # Windows of three words that occur twice or more: a window's hash is packed with its position into
    # one long (position in as many low bits as the text needs) and the longs are sorted as primitives;
    # neighbours whose packed hashes agree repeat if their words' own 64-bit hashes do. One sort within the
    # row: no shuffle, no map.
    n = F.size("__h") - 2
    bits = F.ceil(F.log2(n + F.lit(1.0))).cast("int")
    window = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.call_function(
            "shiftleft", F.xxhash64(F.get("__h", i), F.get("__h", i + 1), F.get("__h", i + 2)), F.col("__b")
        ).bitwiseOR(i.cast("long")),
    )
    two = (
        one.withColumn("__b", bits)
        .withColumn("__s", F.when(n > 1, F.sort_array(window)))
    )
    s, b = F.col("__s"), F.col("__b")
    high = lambda x: F.call_function("shiftright", x, b)
    low = F.call_function("shiftleft", F.lit(1).cast("long"), b) - 1
    word = lambda x, k: F.get("__h", x.bitwiseAND(low).cast("int") + k)
    same = lambda x, y: (high(x) == high(y)) & (word(x, 0) == word(y, 0)) & (word(x, 1) == word(y, 1)) & (word(x, 2) == word(y, 2))
    twin = F.filter(
        s,
        lambda x, i: F.coalesce(same(x, F.get(s, i + 1)), F.lit(False)) | F.coalesce((i > 0) & same(x, F.get(s, i - 1)), F.lit(False)),
    )
    starts = F.sort_array(F.transform(twin, lambda x: x.bitwiseAND(low)))
    three = two.withColumn("__r", starts).drop("__s", "__h")
    r = F.col("__r")
    covered = F.aggregate(
        F.transform(r, lambda x, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get(r, i + 1) - x, F.lit(3).cast("long")))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    return three.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).select(*keep, *STATS)


#: The ratios that rules may test, as expressions over the statistics.
FEATURES = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_word_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool  # true: value > bound; false: value <= bound
    bound: float


@dataclass(frozen=True)
class Rule:
    """A conjunction of tests; rows that meet it get ``keep``."""

    tests: tuple[Test, ...]
    keep: bool
    precision: float
    covered: int


def _met(x: np.ndarray, tests: list[tuple[int, bool, float]]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, above, bound in tests:
        out &= (x[:, f] > bound) if above else (x[:, f] <= bound)
    return out


def _grow(x: np.ndarray, y: np.ndarray, cuts: list[np.ndarray], max_tests: int) -> list[tuple[int, bool, float]]:
    """Add the test with the best information gain (as in FOIL) until only y rows are met."""
    tests: list[tuple[int, bool, float]] = []
    now = np.ones(len(x), bool)
    while len(tests) < max_tests and y[now].sum() and not y[now].all():
        p0, n0 = y[now].sum(), (~y[now]).sum()
        best, gain = None, 1e-9
        for f, bounds in enumerate(cuts):
            v = x[now, f]
            for bound in bounds:
                for above in (True, False):
                    m = v > bound if above else v <= bound
                    p = y[now][m].sum()
                    if p and (g := p * (np.log2(p / m.sum()) - np.log2(p0 / (p0 + n0)))) > gain:
                        best, gain = (f, above, float(bound)), g
        if best is None:
            break
        tests.append(best)
        now &= _met(x, [best])
    return tests


def _prune(tests: list, x: np.ndarray, y: np.ndarray) -> list:
    """Drop final tests as long as (p - 4 n) / (p + n) on the pruning rows doesn't fall.

    A kept row that is wrongly rejected counts as four that are missed.
    """

    def worth(ts: list) -> float:
        m = _met(x, ts)
        p, n = y[m].sum(), (~y[m]).sum()
        return (p - 4 * n) / (p + n) if p + n else -1.0

    while len(tests) > 1 and worth(tests[:-1]) >= worth(tests):
        tests = tests[:-1]
    return tests


def learn_rules(
    stats: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    label_col: str = "quality",
    max_rows: int = 20_000,
    max_rules: int = 12,
    max_tests: int = 3,
    min_precision: float = 0.99,
    min_covered: int = 4,
) -> list[Rule]:
    """Ordered rules that reject rows of label 0, from at most ``max_rows`` labelled rows.

    Each round grows a conjunction on two thirds of the rows not yet covered, prunes it on the other
    third, and keeps it if its precision over both is ``min_precision`` and it covers ``min_covered``
    rows; a rule that is less precise is grown again on all rows, unpruned and with two more tests. It
    then takes what it covers out. Training stops at the first rule that fails this.
    """
    names = list(FEATURES)
    lab = labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__y")).where("__id is not null and __y is not null")
    lab = lab.groupBy("__id").agg(F.min("__y").alias("__y"))
    rows = (
        stats.join(lab, F.col(id_col) == F.col("__id"))
        .select("__id", "__y", *(F.expr(e).cast("double").alias(k) for k, e in FEATURES.items()))
        .orderBy(F.xxhash64("__id"), "__id", *names)
        .limit(max_rows)
        .collect()
    )
    if not rows:
        return []
    y = np.array([r["__y"] == 0 for r in rows])
    x = np.array([[r[k] for k in names] for r in rows], float)
    if y.all() or not y.any():
        return []
    part = np.array([i % 3 == 2 for i in range(len(rows))])
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.01, 0.99, 50))) for f in range(x.shape[1])]
    left, rules = np.ones(len(x), bool), []
    while len(rules) < max_rules and y[left].any():
        grow, prune = left & ~part, left & part
        tests = _prune(_grow(x[grow], y[grow], cuts, max_tests), x[prune], y[prune])
        if tests and y[_met(x, tests) & left].mean() < min_precision:
            tests = _grow(x[left], y[left], cuts, max_tests + 2)
        m = _met(x, tests) & left
        if not tests or m.sum() < min_covered or (precision := y[m].mean()) < min_precision:
            break
        rules.append(Rule(tuple(Test(names[f], a, b) for f, a, b in tests), False, float(precision), int(m.sum())))
        left &= ~m
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one conditional expression: the first rule met decides, else keep."""
    out = None
    for rule in rules:
        met = F.lit(True)
        for t in rule.tests:
            value = F.expr(FEATURES[t.feature]).cast("double")
            met = met & ((value > t.bound) if t.above else (value <= t.bound))
        out = F.when(met, F.lit(rule.keep)) if out is None else out.when(met, F.lit(rule.keep))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def apply_quality(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """``stats`` with ``base_failed`` and ``kept``."""
    return stats.withColumn("base_failed", base_failed()).withColumn(
        "kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict(rules))
    )
