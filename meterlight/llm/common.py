"""Helpers shared by the operators: tables, shipping the package, working through Arrow batches."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, MapType, StructField, StructType

from meterlight.session import materialize, shared_folder  # noqa: F401  (used by the operators)

#: Bytes of text that a Python task works on at a time.
SLICE = 2 << 20
#: Characters between words in the contracts of the queries: space, and 9 to 13.
WHITE = b" \t\n\x0b\x0c\r"


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once a session, so that tasks can import it."""
    context = spark.sparkContext
    if getattr(context, "_meterlight_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="meterlight-")) / "meterlight.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._meterlight_shipped = True


def text_bytes(name: str = "text") -> Column:
    """A text column as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


#: Timestamps to the microsecond, as Spark holds them.
JSON_OPTIONS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def _is_map(docs: DataFrame, column: str) -> bool:
    return isinstance(docs.schema[column].dataType, MapType)


def as_json(docs: DataFrame, columns: list[str], *more: Column) -> Column:
    """The columns as one JSON text that ``out_of_json`` restores. Maps go as arrays of entries, as their keys need
    not be strings; only maps inside of other values must have keys that are."""
    parts = [
        (F.map_entries(F.col(f"`{c}`")) if _is_map(docs, c) else F.col(f"`{c}`")).alias(f"c{i}")
        for i, c in enumerate(columns)
    ]
    return F.to_json(F.struct(*parts, *more, F.lit(0).alias("_")), JSON_OPTIONS)


def out_of_json(docs: DataFrame, columns: list[str], text: Column) -> dict[str, Column]:
    """The columns that ``as_json`` made a text of."""
    kinds = []
    for i, c in enumerate(columns):
        kind = docs.schema[c].dataType
        if _is_map(docs, c):
            kind = ArrayType(StructType([StructField("key", kind.keyType), StructField("value", kind.valueType)]))
        kinds.append(StructField(f"c{i}", kind))
    row = F.from_json(text, StructType([*kinds, StructField("_", IntegerType())]), JSON_OPTIONS)
    out = {}
    for i, c in enumerate(columns):
        out[c] = F.map_from_entries(row[f"c{i}"]) if _is_map(docs, c) else row[f"c{i}"]
    return out


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def slices(values, limit: int = SLICE) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive runs of ``values`` of about ``limit`` bytes, with where each begins."""
    first, held, size = 0, [], 0
    for i, value in enumerate(values):
        held.append(b"" if value is None else bytes(value))
        size += len(held[-1])
        if size >= limit:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads the values of ``x`` over all bits."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each start on, ``lengths`` many of each, one after the other."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
