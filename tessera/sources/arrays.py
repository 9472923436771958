"""zstd-compressed npy files: a batch reader, a listing, and a Python data source `npyzst` with pushdown and a transactional writer."""

from __future__ import annotations

import re
import shutil
import time
import uuid
from contextlib import contextmanager
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

from tessera.functions.kernels import decode_array, encode_array

SCHEMA = "stem string, height int, width int, channels int, dtype string, data binary"
STEM = r"([^/]+?)(\.[A-Za-z0-9_]+)*$"


def described(stem: str, array: np.ndarray) -> tuple:
    shape = (*array.shape, 1, 1, 1)[:3]
    return stem, shape[0], shape[1], shape[2], str(array.dtype), np.ascontiguousarray(array).tobytes()


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file: stem, shape, dtype and raw bytes.  Spark lists and reads the files, so any store does."""

    def run(batches):
        for batch in batches:
            yield pd.DataFrame([described(s, decode_array(c)) for s, c in zip(batch["stem"], batch["content"], strict=True)], columns=[c.split()[0] for c in SCHEMA.split(", ")])

    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", STEM, 1).alias("stem"), "content")
    return files.mapInPandas(run, SCHEMA)


def with_encoded(df: DataFrame, data: str, dtype: str, out: str) -> DataFrame:
    """df with the raw bytes of `data` as compressed npy bytes; Parquet keeps them."""

    def encode(raw: pd.Series, kind: pd.Series) -> pd.Series:
        return pd.Series([encode_array(np.frombuffer(r, dtype=k)) for r, k in zip(raw, kind, strict=True)])

    return df.withColumn(out, F.pandas_udf(encode, T.BinaryType())(F.col(data), F.col(dtype)))


def listed(spark: SparkSession, path: str, pattern: str = "*.zst") -> DataFrame:
    """stem, name, bytes of the files under path, from their metadata alone: no file is opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("_metadata")
    return files.select(F.regexp_extract("_metadata.file_path", STEM, 1).alias("stem"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_size").alias("bytes"))


@contextmanager
def pushed_filters(spark: SparkSession):
    """Filters reach Python data sources in actions inside; the session's own setting comes back."""
    name = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def _mounted(path: str) -> Path:
    """A folder that driver and executors mount; other stores are read by `read_arrays`."""
    if re.match(r"[a-z0-9+.-]+:", path) and not path.startswith("file:"):
        raise ValueError(f"npyzst needs a mounted folder, not {path}")
    return Path(re.sub(r"^file:/*", "/", path))


class NpyZst(DataSource):
    """format("npyzst"): one row a file `<stem>.npy.zst`, read and written, in folders that driver and executors mount.

    With option("pushdown", "true"), inside `pushed_filters`, equality and IN
    filters on stem are pushed down: only the wanted stems' files are opened.
    Load anew for each filter: Spark plans a loaded source once, and what was
    pushed into it stays.  A write puts its files in place at its commit; a
    failed one leaves nothing.
    """

    @classmethod
    def name(cls) -> str:
        return "npyzst"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return (_PushReader if self.options.get("pushdown", "false") == "true" else _Reader)(self.options["path"])

    def writer(self, schema, overwrite: bool):
        missing = {c.split()[0] for c in SCHEMA.split(", ")} - set(schema.fieldNames())
        if missing:
            raise ValueError(f"npyzst rows lack {sorted(missing)}")
        return _Writer(self.options["path"], overwrite)


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.stems = path, None

    def partitions(self):
        folder = _mounted(self.path)
        if self.stems is None:
            return [InputPartition(str(p)) for p in sorted(folder.glob("*.zst"))]
        return [InputPartition(str(p)) for p in sorted(folder / f"{s}.npy.zst" for s in self.stems if s is not None and "/" not in s) if p.exists()]

    def read(self, partition):
        p = Path(partition.value)
        yield described(p.name.split(".")[0], decode_array(p.read_bytes()))


class _PushReader(_Reader):
    def pushFilters(self, filters):
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if wanted is not None and f.attribute == ("stem",):
                self.stems = wanted if self.stems is None else self.stems & wanted
            else:
                yield f


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.waiting = f"_writing-{uuid.uuid4().hex}"  # hidden from readers until the commit
        (_mounted(path) / self.waiting).mkdir(parents=True)  # by the driver: a task that outlives an abort finds no place to write to

    def write(self, rows):
        at = _mounted(self.path) / self.waiting / uuid.uuid4().hex  # of this attempt
        at.mkdir()
        files = []
        for r in rows:
            if not r.stem or "/" in r.stem:
                raise ValueError(f"no file can be named {r.stem!r}")
            shape = (r.height, r.width, r.channels) if r.channels > 1 else (r.height, r.width)
            file = at / f"{r.stem}.npy.zst"
            if file.exists():
                raise ValueError(f"two arrays are named {r.stem}")
            file.write_bytes(encode_array(np.frombuffer(r.data, dtype=r.dtype).reshape(shape)))
            files.append(str(file))
        return _Written(files)

    def commit(self, messages):
        folder, moved = _mounted(self.path), [Path(f) for m in messages if m is not None for f in m.files]
        names = [f.name for f in moved]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two arrays have one name")
        if self.overwrite:
            for old in folder.glob("*.zst"):
                old.unlink()
        for f in moved:
            f.replace(folder / f.name)
        self._clear()

    def abort(self, messages):
        self._clear()

    def _clear(self) -> None:
        at = _mounted(self.path) / self.waiting
        for _ in range(100):  # tasks that are being stopped may still write
            shutil.rmtree(at, ignore_errors=True)
            if not at.exists():
                return
            time.sleep(0.1)
