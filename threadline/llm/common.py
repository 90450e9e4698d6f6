"""Helpers that the training-data operators share."""

from __future__ import annotations

import hashlib
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a fresh one, but only in
    local mode: on a cluster executors would not see each other's files."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.conf.get("spark.master", "local").startswith("local") or spark.conf.get("spark.master", "local").startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="spark-shared-")
    return _OWN["dir"]


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def deleted(df: DataFrame) -> None:
    """Deletes the files of a table of written() that nothing reads any more."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df.written_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """The texts of a column as UTF-8 bytes, without a decode to str."""
    return column.cast(pa.binary()).to_pylist()


def slices(batch: pa.RecordBatch, texts: int, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of about ``most`` bytes of the column ``texts``, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(texts)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def by_batch(make: Callable[[pa.RecordBatch], dict], schema: pa.Schema, most: int = 8 << 20) -> Callable:
    """A mapInArrow function that turns runs of rows of each batch, of about ``most`` bytes, into the
    columns that make() returns; so a worker never holds more than one batch and the work on a run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, batch.num_rows * most // max(batch.nbytes, most))
            for at in range(0, batch.num_rows, step):
                columns = make(batch.slice(at, step))
                yield pa.RecordBatch.from_arrays(
                    [columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in schema], schema=schema
                )

    return run


class Recent:
    """What was looked up lately, in about ``max_bytes``: of a younger and an older half, the older
    one goes when the younger is full, so that what is asked often stays."""

    def __init__(self, max_bytes: int):
        self.young: dict = {}
        self.old: dict = {}
        self.half, self.used = max_bytes // 2, 0

    def get(self, keys: Sequence, make: Callable[[list], Sequence]) -> list:
        """The values of distinct keys; ``make`` gives those of the keys that aren't known."""
        out = list(map(self.young.get, keys))
        missing = [i for i, v in enumerate(out) if v is None]
        asked = [keys[i] for i in missing]
        found = list(map(self.old.get, asked))
        if None in found:
            new = iter(make([k for k, v in zip(asked, found, strict=True) if v is None]))
            found = [next(new) if v is None else v for v in found]
        for i, v in zip(missing, found, strict=True):
            out[i] = v
        self.young.update(zip(asked, found, strict=True))
        self.used += 100 * len(asked) + sum(map(sys.getsizeof, asked)) + sum(map(sys.getsizeof, found))
        if self.used > self.half:
            self.old, self.young, self.used = self.young, {}, 0
        return out


_BUILT: dict[tuple, Any] = {}


def built_once(kind: type, model: bytes | str, *how: Any) -> Any:
    """kind(model, *how), built once in a Python worker: Spark gives a worker many tasks, and what one
    has looked up serves the next. The last few are kept."""
    key = (kind, hashlib.blake2b(model if isinstance(model, bytes) else model.encode()).digest(), *how)
    if key not in _BUILT:
        while len(_BUILT) >= 4:
            _BUILT.pop(next(iter(_BUILT)))
        _BUILT[key] = kind(model, *how)
    return _BUILT[key]
