"""What the text operators share: shipping code to executors, Arrow maps, hashes, written tables."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from throughline.session import shared_dir, stage

__all__ = ["append", "arrow_map", "held_out", "read", "shared_dir", "ship", "stage", "texts"]

#: Bytes of text that an Arrow map works on at a time, one text at least.
SLICE = 16 << 20
#: The same for steps that make many hashes of each byte.
THIN = 4 << 20


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, as --py-files would."""
    sc = spark.sparkContext
    if getattr(sc, "_throughline_shipped", None) == sc.applicationId:
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="ship-")) / "throughline_llm.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in [root / "__init__.py", root / "session.py", *sorted((root / "llm").glob("*.py"))]:
            z.write(p, f"throughline/{p.relative_to(root)}")
    sc.addPyFile(str(target))
    sc._throughline_shipped = sc.applicationId


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def slices(batch: pa.RecordBatch, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about `limit` bytes, one row at least."""
    if batch.num_rows == 0:
        return
    rows = max(1, int(batch.num_rows * limit / max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def arrow_map(df: DataFrame, schema: str | T.StructType,
              start: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]], limit: int = SLICE) -> DataFrame:
    """mapInArrow over bounded slices. `start` runs once in a task and gives the function for a slice."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for batch in batches:
            for part in slices(batch, limit):
                yield from step(part)

    return df.mapInArrow(run, schema)


def append(df: DataFrame, new: str, start: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]],
           keep: list[str] | None = None, limit: int = SLICE) -> DataFrame:
    """The columns `keep` (default: all) of `df` and the new ones, row by row.

    A column of `df` with the name of a new one is replaced, as withColumn() would do; the
    function still sees it.
    """
    added = T._parse_datatype_string(new)
    names = set(added.names)
    fields = [f for f in df.schema.fields if f.name not in names and (keep is None or f.name in keep)]
    kept = [f.name for f in fields]

    def begin():
        step = start()

        def one(part: pa.RecordBatch) -> list[pa.RecordBatch]:
            made = step(part)
            return [pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), *made], names=[*kept, *added.names])]
        return one

    return arrow_map(df, T.StructType([*fields, *added.fields]), begin, limit)


def texts(part: pa.RecordBatch, name: str) -> list[str]:
    """The texts of a column; null counts as empty."""
    return [t or "" for t in part.column(name).to_pylist()]


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """True where crc32 of the id as text leaves `fold`; a null id is in no held-out fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def lists(values: np.ndarray, lengths: Iterable[int], kind: pa.DataType) -> pa.ListArray:
    """Arrow lists of the given lengths over one flat array."""
    ends = np.concatenate([[0], np.cumsum(np.fromiter(lengths, np.int64))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))
