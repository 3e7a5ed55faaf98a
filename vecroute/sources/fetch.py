"""The first vectors of a large remote file, copied by ranges of bytes and resumed after a break.

The file's (rows, width) header tells how many bytes the wanted rows take; they are cut into pieces, each
fetched by a task of its own and written as a vector file of its own. When a piece is whole, a line of the
ledger says so, with its bytes and checksum. A later call fetches only the pieces that the ledger lacks, or
whose file has another length or checksum than it says. Sources are HTTP(S) addresses that serve ranges, or
paths in any store that ``vectors`` opens; the target folder reads as one table of vectors.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import urllib.request
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecroute.functions.storage import materialise
from vecroute.sources.vectors import HEADED, store_of

HEADER = 8
LEDGER = "_ledger"  # readers of the folder pass over names that begin so


def read_range(source: str, start: int, length: int, tries: int = 4, wait: float = 1.0) -> bytes:
    """Exactly ``length`` bytes from ``start``; less is an error, and so is an address that gives other bytes."""
    for left in range(tries - 1, -1, -1):
        try:
            if source.startswith(("http://", "https://")):
                ask = urllib.request.Request(source, headers={"Range": f"bytes={start}-{start + length - 1}"})
                with urllib.request.urlopen(ask, timeout=60) as answer:
                    if answer.status != 206 and start:
                        raise ValueError(f"{source} doesn't serve ranges")
                    data = answer.read(length)
            else:
                store, inside = store_of(source)
                with store.open_input_file(inside) as f:
                    data = f.read_at(length, start)
            if len(data) != length:
                raise EOFError(f"{source} ends after {start + len(data)} bytes, {start + length} are wanted")
            return data
        except OSError:
            if not left:
                raise
            time.sleep(wait)
            wait *= 2
    raise AssertionError


def _piece_files(target: str, piece: int, suffix: str) -> tuple[fs.FileSystem, str, str]:
    store, inside = store_of(target)
    return store, f"{inside}/piece-{piece:06d}{suffix}", f"{inside}/{LEDGER}/piece-{piece:06d}.json"


def _known(store: fs.FileSystem, path: str, line: str, rows: int) -> dict | None:
    """The ledger's entry of a piece, if its file is what the entry says."""
    if store.get_file_info(line).type == fs.FileType.NotFound or store.get_file_info(path).type == fs.FileType.NotFound:
        return None
    with store.open_input_file(line) as f:
        entry = json.loads(f.read())
    if entry["rows"] != rows or store.get_file_info(path).size != entry["bytes"]:
        return None
    with store.open_input_file(path) as f:
        return entry if hashlib.sha256(f.read()).hexdigest() == entry["sha256"] else None


def _put(store: fs.FileSystem, path: str, data: bytes) -> None:
    """Written under another name first, so that what has the name is whole."""
    folder, name = path.rsplit("/", 1)
    own = f"{folder}/_{uuid.uuid4().hex}-{name}"
    with store.open_output_stream(own) as f:
        f.write(data)
    store.move(own, path)


def fetch_slice(spark: SparkSession, source: str, target: str, rows: int, piece_rows: int = 262_144, suffix: str = ".u8bin") -> DataFrame:
    """(piece, rows, bytes, sha256, fetched): the pieces of the first ``rows`` vectors, all in place."""
    size = np.dtype(HEADED[suffix]).itemsize
    there, width = struct.unpack("<ii", read_range(source, 0, HEADER))
    if not 0 < rows <= there:
        raise ValueError(f"{rows} rows are wanted, {source} has {there}")
    store, inside = store_of(target)
    store.create_dir(f"{inside}/{LEDGER}", recursive=True)
    n = -(-rows // piece_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in b.column(0).to_pylist():
                first, last = piece * piece_rows, min(rows, (piece + 1) * piece_rows)
                files, path, line = _piece_files(target, piece, suffix)
                entry = _known(files, path, line, last - first)
                fetched = entry is None
                if entry is None:
                    body = read_range(source, HEADER + first * width * size, (last - first) * width * size)
                    data = struct.pack("<ii", last - first, width) + body
                    entry = {"piece": piece, "rows": last - first, "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()}
                    _put(files, path, data)
                    _put(files, line, json.dumps(entry).encode())
                yield pa.RecordBatch.from_pylist([entry | {"fetched": fetched}])

    pieces = spark.range(0, n, 1, n).select("id").mapInArrow(run, "piece long, rows long, bytes long, sha256 string, fetched boolean")
    done = materialise(pieces, "pieces")
    if done.agg(F.sum("rows")).first()[0] != rows:
        raise ValueError(f"{target} holds other rows than the {rows} wanted")
    return done
