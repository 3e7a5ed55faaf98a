"""Vector files as a Spark data source, and as a sink of sharded files.

``spark.read.format("vectors").load(path)`` reads one file, or a folder of shards in the order of their
names, as (vec_id, embedding); the suffix tells the layout. Rows are split into ranges, each a partition
that reads only its bytes. ``df.write.format("vectors").option("suffix", ".fbin").save(path)`` writes a
folder with shards of at most 64 MB (``shardBytes``) a partition: tasks write under names that readers pass over, and the commit renames what
the successful attempts wrote. Paths may lie in any store that pyarrow opens (file, hdfs, s3 or s3a, gs).
"""

from __future__ import annotations

import ast
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from vecroute.functions.storage import exists

# Element type by suffix; files with a (rows, width) header, and files with a width per row.
HEADED = {".fbin": "<f4", ".f32bin": "<f4", ".u8bin": "u1", ".i8bin": "i1", ".ibin": "<i4", ".i32bin": "<i4"}
ROWWISE = {".fvecs": "<f4", ".ivecs": "<i4"}
INTEGER = {".ibin", ".i32bin", ".ivecs"}


@dataclass(frozen=True)
class MatrixInfo:
    """Shape, element type and placement of a matrix file, from its header alone."""

    path: str
    rows: int
    width: int
    dtype: str
    offset: int  # of the first row's values
    stride: int  # bytes from row to row


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path inside) of a path or URI."""
    if "://" not in path:
        return fs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:"))
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def _suffix(path: str) -> str:
    return os.path.splitext(path)[1].lower()


def matrix_info(path: str, layout: str = "") -> MatrixInfo:
    store, inside = store_of(path)
    suffix, size = _suffix(path), store.get_file_info(inside).size or 0
    with store.open_input_file(inside) as f:
        if suffix in HEADED:
            rows, width = struct.unpack("<ii", f.read(8))
            item = np.dtype(HEADED[suffix]).itemsize
            # a neighbour file holds the ids' block and then the distances' block
            blocks = 2 if layout == "knn_result" else 1
            if rows < 0 or width < 0 or size != 8 + blocks * rows * width * item:
                raise ValueError(f"{path}: header says {rows} x {width}, which {size} bytes don't hold")
            return MatrixInfo(path, rows, width, HEADED[suffix], 8, width * item)
        if suffix in ROWWISE:
            head = f.read(4)
            if not head:
                return MatrixInfo(path, 0, 0, ROWWISE[suffix], 4, 4)
            width = struct.unpack("<i", head)[0]
            stride = 4 + 4 * width
            if width <= 0 or size % stride:
                raise ValueError(f"{path}: {size} bytes are no whole rows of width {width}")
            return MatrixInfo(path, size // stride, width, ROWWISE[suffix], 4, stride)
        if suffix == ".npy":
            if f.read(6) != b"\x93NUMPY":
                raise ValueError(f"{path} is no .npy file")
            major = f.read(2)[0]
            n = struct.unpack("<H" if major == 1 else "<I", f.read(2 if major == 1 else 4))[0]
            head = ast.literal_eval(f.read(n).decode("latin1"))
            if head["fortran_order"] or len(head["shape"]) != 2:
                raise ValueError(f"{path}: a row-major matrix is wanted")
            (rows, width), dtype = head["shape"], head["descr"]
            return MatrixInfo(path, rows, width, dtype, f.tell(), width * np.dtype(dtype).itemsize)
    raise ValueError(f"{path}: unknown suffix {suffix!r}")


def read_rows(info: MatrixInfo, start: int, stop: int) -> np.ndarray:
    item = np.dtype(info.dtype).itemsize
    store, inside = store_of(info.path)
    need = (stop - start - 1) * info.stride + info.width * item if stop > start else 0
    with store.open_input_file(inside) as f:
        raw = np.frombuffer(f.read_at(need, info.offset + start * info.stride).ljust((stop - start) * info.stride, b"\0"), np.uint8)
    rows = raw.reshape(stop - start, info.stride)[:, : info.width * item]
    return np.ascontiguousarray(rows).view(info.dtype)


@dataclass
class RowRange(InputPartition):
    info: MatrixInfo
    start: int
    stop: int
    first_id: int


class VectorSource(DataSource):
    """Options: ``path``; ``rows`` (read this many rows, an error if there are fewer); ``layout``
    (``knn_result``: ids followed by distances); ``rowsPerPartition``."""

    @classmethod
    def name(cls) -> str:
        return "vectors"

    def _files(self) -> list[str]:
        path = self.options["path"].rstrip("/")
        store, inside = store_of(path)
        if store.get_file_info(inside).type != fs.FileType.Directory:
            return [path]
        names = sorted(x.base_name for x in store.get_file_info(fs.FileSelector(inside)))
        return [f"{path}/{x}" for x in names if not x.startswith(("_", "."))]

    def schema(self) -> str:
        files = self._files()
        if not files:
            raise ValueError(f"no vector files in {self.options['path']}")
        info = matrix_info(files[0], self.options.get("layout", ""))
        kind = "bigint" if np.dtype(info.dtype).kind in "iu" and (_suffix(files[0]) in INTEGER or _suffix(files[0]) == ".npy") else "float"
        return f"vec_id bigint, embedding array<{kind}>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self._files(), schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(schema, overwrite, dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, files: list[str], schema: StructType, options: dict):
        self.infos = [matrix_info(f, options.get("layout", "")) for f in files]
        if len({i.width for i in self.infos if i.rows}) > 1:
            raise ValueError("shards of different widths")
        self.most = options.get("rows")
        self.step = int(options.get("rowspartition") or options.get("rowsPerPartition") or 262_144)
        self.whole = "bigint" in schema.simpleString().split("embedding")[1]
        if self.most is not None and int(self.most) > sum(i.rows for i in self.infos):
            raise ValueError(f"{self.most} rows are wanted, {sum(i.rows for i in self.infos)} are there")

    def partitions(self) -> list[RowRange]:
        out, first = [], 0
        left = int(self.most) if self.most is not None else None
        for info in self.infos:
            n = info.rows if left is None else min(left, info.rows)
            out += [RowRange(info, a, min(n, a + self.step), first + a) for a in range(0, n, self.step)]
            first, left = first + info.rows, None if left is None else left - n
        return out or [RowRange(self.infos[0], 0, 0, 0)]

    def read(self, part: RowRange) -> Iterator[pa.RecordBatch]:
        kind = pa.int64() if self.whole else pa.float32()
        for a in range(part.start, part.stop, 8192):
            b = min(part.stop, a + 8192)
            m = read_rows(part.info, a, b)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(0, m.size + 1, max(1, m.shape[1]), dtype=np.int32)), pa.array(m.ravel().astype(np.int64 if self.whole else np.float32), kind)
            )
            ids = pa.array(np.arange(part.first_id + a - part.start, part.first_id + b - part.start), pa.int64())
            yield pa.RecordBatch.from_arrays([ids, lists], names=["vec_id", "embedding"])


@dataclass
class Shards(WriterCommitMessage):
    names: list[str]


#: Bytes of a shard: a task holds no more than that of its partition at once.
SHARD_BYTES = 64 << 20


class _Writer(DataSourceArrowWriter):
    """Each task writes shards under hidden names of its own; the commit renames those of the attempts that count.

    A shard's header tells its rows, so a task gathers Arrow batches up to ``SHARD_BYTES`` before it writes them."""

    def __init__(self, schema: StructType, overwrite: bool, options: dict):
        self.suffix = options.get("suffix", ".fbin")
        if self.suffix not in HEADED and self.suffix not in ROWWISE:
            raise ValueError(f"can't write {self.suffix!r}")
        self.target = options["path"].rstrip("/")
        self.most = int(options.get("shardbytes") or options.get("shardBytes") or SHARD_BYTES)
        store, inside = store_of(self.target)
        if store.get_file_info(inside).type != fs.FileType.NotFound and not overwrite:
            raise FileExistsError(self.target)
        store.create_dir(inside, recursive=True)
        self.run = uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Shards:
        from pyspark import TaskContext

        task = TaskContext.get()
        dtype = np.dtype(HEADED.get(self.suffix) or ROWWISE[self.suffix])
        names: list[str] = []
        held: list[np.ndarray] = []
        width = None

        def flush() -> None:
            name = f"_{self.run}-{task.taskAttemptId()}.part-{task.partitionId():05d}-{len(names):04d}{self.suffix}"
            store, inside = store_of(self.target)
            with store.open_output_stream(f"{inside}/{name}") as f:
                if self.suffix in HEADED:
                    f.write(struct.pack("<ii", sum(map(len, held)), width))
                for m in held:
                    f.write(m.tobytes() if self.suffix in HEADED else np.hstack([np.full((len(m), 1), width, "<i4"), m.view("<i4")]).tobytes())
            names.append(name)
            held.clear()

        for b in batches:
            lists = b.column(b.schema.get_field_index("embedding"))
            sizes = lists.value_lengths()
            widths = {*sizes.unique().to_pylist(), *([] if width is None else [width])}
            if lists.null_count or len(widths) > 1:
                raise ValueError(f"vectors must all have one width, and none may be null: {sorted(map(str, widths))}")
            if b.num_rows:
                width = widths.pop()
                step = max(1, self.most // max(1, width * dtype.itemsize))
                m = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(b.num_rows, width))
                while len(m):
                    room = step - sum(map(len, held))  # a batch fills the shard begun before
                    held.append(m[:room])
                    m = m[room:]
                    if len(held[-1]) == room:
                        flush()
        if held:
            flush()
        return Shards(names)

    def commit(self, messages: list) -> None:
        store, inside = store_of(self.target)
        written = {name for m in messages if m is not None for name in m.names}
        for old in store.get_file_info(fs.FileSelector(inside)):
            if old.base_name not in written:
                (store.delete_dir if old.type == fs.FileType.Directory else store.delete_file)(old.path)
        for name in sorted(written):
            store.move(f"{inside}/{name}", f"{inside}/{name.split('.', 1)[1]}")

    def abort(self, messages: list) -> None:
        store, inside = store_of(self.target)
        for mine in store.get_file_info(fs.FileSelector(inside, allow_not_found=True)):
            if mine.base_name.startswith(f"_{self.run}"):
                store.delete_file(mine.path)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VectorSource)


def read_vectors(spark: SparkSession, path: str, rows: int | None = None, layout: str = "") -> DataFrame:
    """(vec_id, embedding) of a vector file or folder; HDF5 needs h5py."""
    if _suffix(path) in (".h5", ".hdf5"):
        return read_hdf5(spark, path, rows=rows)
    register(spark)
    reader = spark.read.format("vectors")
    if rows is not None:
        reader = reader.option("rows", str(rows))
    return reader.option("layout", layout).load(path)


def write_vectors(vectors: DataFrame, path: str, suffix: str = ".fbin", mode: str = "append") -> None:
    """Shards in the order of ``vec_id``."""
    register(vectors.sparkSession)
    vectors.select("vec_id", "embedding").repartitionByRange("vec_id").sortWithinPartitions("vec_id").write.format("vectors").option("suffix", suffix).mode(mode).save(path)


def read_hdf5(spark: SparkSession, path: str, key: str | None = None, rows: int | None = None) -> DataFrame:
    """A matrix of an HDF5 file: ``key``, else ``emb``, ``knns``, ``neighbors`` or the only one."""
    try:
        import h5py
    except ImportError as e:
        raise ImportError("reading HDF5 needs h5py, which isn't installed") from e
    with h5py.File(path, "r") as f:
        names = list(f)
        name = key or next((k for k in ("emb", "knns", "neighbors") if k in names), names[0] if len(names) == 1 else None)
        if name is None or name not in names:
            raise ValueError(f"{path}: which of {', '.join(names)}?")
        n, width = f[name].shape
    if rows is not None and rows > n:
        raise ValueError(f"{rows} rows are wanted, {n} are there")
    n, step = n if rows is None else rows, 65_536

    def load(batches):
        for pdf in batches:
            for a in pdf["id"]:
                with h5py.File(path, "r") as f:
                    m = f[name][a : min(n, a + step)]
                yield pdf.__class__({"vec_id": np.arange(a, a + len(m)), "embedding": list(m.astype(np.float32))})

    return spark.range(0, n, step).mapInPandas(load, "vec_id long, embedding array<float>")


def first_existing(spark: SparkSession, candidates: list[str]) -> str:
    """The first of a list of paths that is there."""
    for path in candidates:
        if exists(spark, path):
            return path
    raise FileNotFoundError(f"none of {', '.join(candidates)}")


def truth_long(wide: DataFrame) -> DataFrame:
    """(query_id, rank, vec_id) of a neighbour matrix read as vectors."""
    return wide.select(F.col("vec_id").alias("query_id"), F.posexplode("embedding").alias("rank", "vec_id"))


def normalise_truth(truth: DataFrame, n_queries: int) -> DataFrame:
    """Neighbour lists that may be transposed (rows aren't queries) or count from 1."""
    ends = truth.agg(F.max("query_id").alias("q"), F.min("vec_id").alias("v")).first()
    if ends["q"] is None:
        return truth
    if ends["q"] + 1 != n_queries:
        truth = truth.select(F.col("rank").cast("long").alias("query_id"), F.col("query_id").cast("int").alias("rank"), "vec_id")
    return truth.withColumn("vec_id", F.col("vec_id") - 1) if ends["v"] >= 1 else truth
