"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corundum.sources.folders import remove, scratch, settled

#: Rows and bytes of an Arrow batch: texts may be long, so batches are kept short in both.
ARROW_ROWS, ARROW_BYTES = 256, 16 << 20


_held: dict[str, Callable[[], None]] = {}


def claim(owner: str, clear: Callable[[], None]) -> None:
    """Called in a Python worker by the operator that is about to fill its caches. Workers outlive a
    stage; the caches of the operator before are emptied and their memory given back."""
    if owner not in _held:
        for other in _held.values():
            other()
        if _held:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):
                pass  # another C library
        _held.clear()
        _held[owner] = clear


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with batches bounded in rows and bytes, so that a worker holds some MB of text at a
    time, or one longer text. The bounds are settings of the session, read when the plan runs: they
    are lowered here where they are higher, and stay."""
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        if not 0 < _number(conf.get(key)) <= most:
            conf.set(key, str(most))
    return df.mapInArrow(fn, schema)


def _number(setting: str) -> int:
    """A setting in rows or bytes; 0 if it has a unit, or none is set."""
    return int(setting.removesuffix("b")) if setting.removesuffix("b").lstrip("-").isdigit() else 0


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once per row: Catalyst may copy an expression into a
    lambda and evaluate it for each element; a lambda variable can't be copied."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: A new folder that all executors share; it goes when it is dropped, or when the session's JVM ends.
work_dir, drop_dir = scratch, remove


def written(df: DataFrame, path: str, name: str) -> DataFrame:
    """df written as Parquet below path and read again: its lineage ends in files that all
    executors can read, so a lost executor costs no recomputation."""
    return settled(df, f"{path}/{name}")


def drop_all(spark: SparkSession, folder: str, *names: str) -> None:
    """Remove tables below folder that nothing reads any more."""
    for name in names:
        remove(spark, f"{folder}/{name}")


def free_name(df: DataFrame, base: str) -> str:
    """base, with underscores before it until no column of df is called so (in any case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base


def free_names(taken: list[str], names: list[str]) -> list[str]:
    """names, each with underscores before it until none of taken or of those before is called so."""
    seen, out = {t.lower() for t in taken}, []
    for n in names:
        while n.lower() in seen:
            n = f"_{n}"
        seen.add(n.lower())
        out.append(n)
    return out


#: The characters that end a word: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = " \t\n\x0b\f\r"


def words_of(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text; null has none."""
    bare = F.btrim(text, F.lit(WHITE))
    return F.when(bare != "", F.split(bare, "[ \\t\\n\\x0B\\f\\r]+")).otherwise(F.array().cast("array<string>"))


def map_texts(df: DataFrame, column: str, fn: Callable[[list], list], fields: list[tuple[str, str]], keep: list[str]) -> DataFrame:
    """keep and fields, computed batch by batch in Arrow: fn gets a list of the column's values and
    gives a list of values for each field (name, Spark type). Columns travel under numbers, so no
    name of the input can clash; a field whose name is among keep gets underscores before it."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    types = [to_arrow_type(_parse_datatype_string(t)) for _, t in fields]
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [pa.array(x, t) for x, t in zip(fn(batch.column(n).to_pylist()), types)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *out], names=[*(f"k{i}" for i in range(n)), *(f"f{i}" for i in range(len(out)))])

    source = df.select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)), F.col(f"`{column}`").alias("text"))
    schema = ", ".join([*(f"k{i} {type_of(df, c)}" for i, c in enumerate(keep)), *(f"f{i} {t}" for i, (_, t) in enumerate(fields))])
    names = [*((f"k{i}", c) for i, c in enumerate(keep)), *((f"f{i}", c) for i, c in enumerate(free_names(keep, [n for n, _ in fields])))]
    return map_arrow(source, run, schema).select(*(F.col(a).alias(b) for a, b in names))
