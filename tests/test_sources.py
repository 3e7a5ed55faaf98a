import random
import struct

import numpy as np
import pytest

from vecroute.functions.paths import random_init
from vecroute.functions.storage import shared_dir
from vecroute.operators.router import ROUTER_SCHEMA
from vecroute.sources import index as index_io
from vecroute.sources import vectors as V
from vecroute.sources.fetch import LEDGER, fetch_slice


def put(path, suffix, rows):
    m = np.asarray(rows)
    with open(path, "wb") as f:
        if suffix in V.HEADED:
            f.write(struct.pack("<ii", *m.shape) + m.astype(V.HEADED[suffix]).tobytes())
        elif suffix in V.ROWWISE:
            for r in m:
                f.write(struct.pack("<i", len(r)) + r.astype(V.ROWWISE[suffix]).tobytes())
        else:
            np.save(f, m)


ROWS = [[1, 2, 3], [4, 5, 6], [7, 8, 9], [0, 1, 0]]


@pytest.mark.parametrize("suffix", [*V.HEADED, *V.ROWWISE, ".npy"])
def test_read(spark, tmp_path, suffix):
    path = str(tmp_path / f"m{suffix}")
    put(path, suffix, np.array(ROWS, np.float32 if suffix == ".npy" else None))
    got = V.read_vectors(spark, path).orderBy("vec_id").collect()
    assert [r["vec_id"] for r in got] == [0, 1, 2, 3] and [r["embedding"] for r in got] == ROWS
    assert [r["vec_id"] for r in V.read_vectors(spark, path, rows=2).collect()] == [0, 1]
    with pytest.raises(Exception, match="are there"):
        V.read_vectors(spark, path, rows=5).collect()


@pytest.mark.parametrize("suffix", [".fbin", ".u8bin", ".ibin", ".fvecs", ".ivecs"])
def test_write_and_read_back(spark, tmp_path, suffix):
    rng = random.Random(1)
    rows = [(i, [float(rng.randrange(100)) for _ in range(5)]) for i in range(301)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(7)
    path = str(tmp_path / "out")
    V.write_vectors(df, path, suffix)
    back = sorted((r["vec_id"], [float(x) for x in r["embedding"]]) for r in V.read_vectors(spark, path).collect())
    assert back == rows
    with pytest.raises(Exception):
        V.write_vectors(df, path, suffix)
    V.write_vectors(df.where("vec_id < 3"), path, suffix, mode="overwrite")
    assert V.read_vectors(spark, path).count() == 3


def test_headers_are_checked(tmp_path):
    bad = tmp_path / "x.fbin"
    bad.write_bytes(struct.pack("<ii", 5, 5))
    with pytest.raises(ValueError):
        V.matrix_info(str(bad))
    odd = tmp_path / "x.fvecs"
    odd.write_bytes(struct.pack("<i", 3) + b"123")
    with pytest.raises(ValueError):
        V.matrix_info(str(odd))
    with pytest.raises(ValueError):
        V.matrix_info(__file__)


def test_neighbour_files(spark, tmp_path):
    path = tmp_path / "gt.ibin"
    ids = np.array([[3, 1], [2, 4], [5, 1]], "<i4")
    path.write_bytes(struct.pack("<ii", 3, 2) + ids.tobytes() + np.ones((3, 2), "<f4").tobytes())
    truth = V.truth_long(V.read_vectors(spark, str(path), layout="knn_result"))
    assert sorted(map(tuple, truth.collect())) == [(0, 0, 3), (0, 1, 1), (1, 0, 2), (1, 1, 4), (2, 0, 5), (2, 1, 1)]
    same = V.normalise_truth(truth, 3)  # counts from 1
    assert sorted(map(tuple, same.collect()))[0] == (0, 0, 2)
    turned = V.normalise_truth(truth, 2)  # rows are ranks
    assert sorted(map(tuple, turned.collect()))[:3] == [(0, 0, 2), (0, 1, 1), (0, 2, 4)]


def test_index_save_load_merge(spark):
    vectors = spark.range(40).withColumnRenamed("id", "vec_id")
    parts = []
    for seed in (0, 1):
        path = shared_dir(spark, "index")
        router = spark.createDataFrame([(0, [], b, [1.0], float(b)) for b in range(4)], ROUTER_SCHEMA)
        index_io.save_index(random_init(vectors, 4, 2, seed), router, index_io.IndexMeta(4, 2, 1.0, 40, 1), path)
        parts.append(path)
    out = shared_dir(spark, "merged")
    meta = index_io.merge_indexes(spark, parts, out)
    paths, router, again = index_io.load_index(spark, out, k=4, h=2, n=40)
    assert meta == again and meta.n_trees == 2 and paths.count() == 80 and router.count() == 8
    first, _, one = index_io.load_index(spark, out, n_trees=1)
    want = sorted((r["vec_id"], r["leaf_id"]) for r in random_init(vectors, 4, 2, 0).collect())
    assert one.n_trees == 1 and sorted((r["vec_id"], r["leaf_id"]) for r in first.collect()) == want
    for wrong in ({"k": 5}, {"n": 41}, {"n_trees": 3}):
        with pytest.raises(ValueError):
            index_io.load_index(spark, out, **wrong)


def test_shards_are_bounded_whatever_the_batches(spark, tmp_path):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        df = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(40)], "vec_id long, embedding array<float>").coalesce(1)
        V.register(spark)
        df.write.format("vectors").option("suffix", ".fvecs").option("shardBytes", "64").mode("append").save(str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [f.stat().st_size for f in sorted((tmp_path / "out").iterdir())] == [96] * 5
    assert [r["embedding"][0] for r in V.read_vectors(spark, str(tmp_path / "out")).orderBy("vec_id").collect()] == [float(i) for i in range(40)]


def test_shards_are_bounded(spark, tmp_path):
    rows = [(i, [float(i), 0.0]) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    V.register(spark)
    df.write.format("vectors").option("suffix", ".fvecs").option("shardBytes", "64").mode("append").save(str(tmp_path / "out"))
    files = sorted((tmp_path / "out").iterdir())
    assert len(files) >= 12 and all(f.stat().st_size <= 96 for f in files)  # 8 rows, and their widths
    assert sorted(r["embedding"][0] for r in V.read_vectors(spark, str(tmp_path / "out")).collect()) == [float(i) for i in range(100)]
    for bad in ([(0, [1.0]), (1, [1.0, 2.0])], [(0, None)]):
        with pytest.raises(Exception, match="one width"):
            V.write_vectors(spark.createDataFrame(bad, "vec_id long, embedding array<float>").coalesce(1), str(tmp_path / f"bad{len(bad)}"))


@pytest.fixture
def served(tmp_path):
    """A vector file behind an address that serves ranges, and what was asked of it."""
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    m = np.random.default_rng(1).integers(0, 255, (1000, 7), np.uint8)
    data, asked = struct.pack("<ii", 1000, 7) + m.tobytes(), []

    class Ranges(BaseHTTPRequestHandler):
        def do_GET(self):
            a, z = map(int, self.headers["Range"].removeprefix("bytes=").split("-"))
            asked.append((a, z))
            self.send_response(206)
            self.end_headers()
            self.wfile.write(data[a : z + 1])

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Ranges)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/base.u8bin", m, asked
    server.shutdown()


def test_ranges_of_a_remote_file(spark, tmp_path, served):
    url, m, asked = served
    target = str(tmp_path / "slice")
    done = fetch_slice(spark, url, target, 750, piece_rows=100).collect()
    assert sum(r["rows"] for r in done) == 750 and len(done) == 8 and all(r["fetched"] for r in done)
    assert max(z for _, z in asked) == 8 + 750 * 7 - 1  # nothing beyond what is wanted
    back = V.read_vectors(spark, target).orderBy("vec_id").collect()
    assert [r["embedding"] for r in back] == m[:750].tolist()
    asked.clear()
    assert not any(r["fetched"] for r in fetch_slice(spark, url, target, 750, piece_rows=100).collect()) and asked == [(0, 7)]
    (tmp_path / "slice" / "piece-000002.u8bin").write_bytes(struct.pack("<ii", 100, 7) + bytes(700))  # other bytes
    (tmp_path / "slice" / "piece-000005.u8bin").write_bytes(b"cut off")
    (tmp_path / "slice" / LEDGER / "piece-000006.json").unlink()
    again = {r["piece"] for r in fetch_slice(spark, url, target, 750, piece_rows=100).collect() if r["fetched"]}
    assert again == {2, 5, 6}
    assert [r["embedding"] for r in V.read_vectors(spark, target).orderBy("vec_id").collect()] == m[:750].tolist()
    with pytest.raises(ValueError, match="1001"):
        fetch_slice(spark, url, target, 1001)


def test_goes_on_after_a_break(spark, tmp_path):
    source, target = tmp_path / "base.u8bin", str(tmp_path / "slice")
    m = np.arange(600, dtype=np.uint32).astype(np.uint8).reshape(200, 3)
    whole = struct.pack("<ii", 200, 3) + m.tobytes()
    source.write_bytes(whole[: 8 + 120 * 3])  # ends in the third piece
    with pytest.raises(Exception, match="ends after"):
        fetch_slice(spark, str(source), target, 200, piece_rows=50)
    source.write_bytes(whole)
    done = {r["piece"]: r["fetched"] for r in fetch_slice(spark, str(source), target, 200, piece_rows=50).collect()}
    assert done[2] and done[3] and len(done) == 4  # the first two may have been stopped with the job
    assert [r["embedding"] for r in V.read_vectors(spark, target).orderBy("vec_id").collect()] == m.tolist()
