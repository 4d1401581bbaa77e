"""Arrays as files that every executor's tasks map into memory.

Rows of packed arrays are written to the shared folder and handed to the executors as
files of the session, each fetched once a machine. The first task there lays the arrays
of all rows of a file end to end; tasks map the result, so what they share is the page
cache, and neither the driver nor a worker holds the arrays.
"""

from __future__ import annotations

import functools
import json
import os
import struct
import uuid

import numpy as np
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from .shared import Shared


def pack(**arrays: np.ndarray) -> bytes:
    """Named arrays as bytes."""
    head = json.dumps([(k, a.dtype.str, len(a)) for k, a in arrays.items()]).encode()
    return struct.pack("<I", len(head)) + head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays.values())


def unpack(raw: bytes) -> dict[str, np.ndarray]:
    (n,) = struct.unpack_from("<I", raw)
    at, out = 4 + n, {}
    for name, kind, size in json.loads(raw[4:at]):
        out[name] = np.frombuffer(raw, kind, size, at)
        at += out[name].nbytes
    return out


def deliver(shared: Shared, rows: DataFrame, files: int) -> list[str]:
    """Hands rows of (key int, bytes) to the executors; the names that ``mapped`` takes. Keys ascend within a file.

    The files stay in the shared folder as long as the session: executors that come later fetch them too.
    """
    path, spark = shared.path(), shared.spark
    rows.select("key", "bytes").repartitionByRange(max(1, files), "key").sortWithinPartitions("key").write.option("compression", "none").parquet(path)
    found = spark.read.schema("key int, bytes binary").parquet(path).inputFiles()
    for f in found:
        spark.sparkContext.addFile(f)
    return [f.rsplit("/", 1)[1] for f in found]


class Mapped:
    """The arrays of one file: by name those of all rows end to end, and where each row's begin."""

    def __init__(self, path: str):
        if not os.path.exists(f"{path}.json"):
            self._lay_out(path)
        with open(f"{path}.json") as f:
            head = json.load(f)
        self.keys = np.array(head["keys"], np.int64)
        self.starts = {k: np.array(x, np.int64) for k, x in head["starts"].items()}
        self.arrays = {k: np.memmap(f"{path}.{head['run']}.{k}", kind, "r") if self.starts[k][-1] else np.empty(0, kind) for k, kind in head["kinds"].items()}

    @staticmethod
    def _lay_out(path: str) -> None:
        """Several workers may do so at once: each writes files of its own, and the last to name them wins."""
        run = uuid.uuid4().hex
        keys: list[int] = []
        starts: dict[str, list[int]] = {}
        kinds: dict[str, str] = {}
        files: dict[str, object] = {}
        for batch in pq.ParquetFile(path).iter_batches(batch_size=1):
            keys += batch.column("key").to_pylist()
            for name, a in unpack(batch.column("bytes")[0].as_py()).items():
                if name not in files:
                    files[name] = open(f"{path}.{run}.{name}", "wb")  # noqa: SIM115
                    starts[name], kinds[name] = [0], a.dtype.str
                files[name].write(a.tobytes())
                starts[name].append(starts[name][-1] + len(a))
        for f in files.values():
            f.close()
        with open(f"{path}.{run}", "w") as f:
            json.dump({"keys": keys, "starts": starts, "kinds": kinds, "run": run}, f)
        os.replace(f"{path}.{run}", f"{path}.json")


@functools.lru_cache(64)
def _mapped(path: str) -> Mapped:
    return Mapped(path)


def mapped(names: list[str]) -> list[Mapped]:
    """On an executor: the files of ``deliver`` that have rows."""
    found = [_mapped(SparkFiles.get(n)) for n in names]
    return [m for m in found if len(m.keys)]
