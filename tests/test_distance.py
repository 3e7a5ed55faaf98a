import pytest
from pyspark.sql import functions as F

from vecroute.functions import distance as D

KINDS = {"jaccard": "array<bigint>"}


@pytest.mark.parametrize(
    "metric, a, b, want",
    [
        ("euclidean", [0, 0], [3, 4], 5.0), ("euclidean", [0, 0], [0, 0], 0.0), ("angular", [0, 0], [1, 0], 1.0), ("angular", [0, 0], [0, 0], 1.0),
        ("angular", [1, 0], [0, 1], 1.0), ("cosine", [2, 0], [5, 0], 0.0), ("inner_product", [2, 0], [1, 0], -2.0), ("inner_product", [0, 1], [1, 0], 0.0),
        ("hamming", [1, 0, 0], [1, 0, 0], 0.0), ("hamming", [1, 1, 0], [1, 0, 0], 1 / 3), ("jaccard", [1, 2, 3], [1, 2, 7], 0.5),
        ("jaccard", [4, 5, 6], [1, 2, 7], 1.0), ("jaccard", [], [1], 1.0), ("jaccard", [], [], 1.0),
    ],
)
def test_metric(spark, metric, a, b, want):
    kind = KINDS.get(metric, "array<float>")
    cast = int if metric == "jaccard" else float
    df = spark.createDataFrame([([cast(x) for x in a], [cast(x) for x in b])], f"a {kind}, b {kind}")
    assert df.select(D.metric(metric)(F.col("a"), F.col("b"))).first()[0] == pytest.approx(want)


def test_normalise(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    assert [r[0] for r in df.select(D.l2_normalize(F.col("v"))).collect()] == [pytest.approx([0.6, 0.8]), [0.0, 0.0]]


def test_unknown_metric():
    with pytest.raises(KeyError):
        D.metric("manhattan")
