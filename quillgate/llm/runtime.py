"""What every operator here needs from the session: a shared scratch folder, workers that can
import this package, and bounded Arrow batches."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that an operator's Python code handles at a time, and texts.
SLICE_CHARS, SLICE_TEXTS = 2_000_000, 4096
#: Bytes of a batch that travels to a Python worker, where the session has Spark's default of 64 MB.
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package, and make sure that checkpoint() has a folder.

    The folder is the one that the cluster names in ``spark.checkpoint.dir``.  Only where that is
    unset and the master is local, as in tests, a temporary one is made.
    """
    sc = spark.sparkContext
    root = str(Path(__file__).resolve().parents[2])
    have = sc.environment.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, have) if x)
    if spark.conf.get(_BATCH) == _DEFAULT:  # it bounds little, and long texts fill memory
        spark.conf.set(_BATCH, f"{BATCH_BYTES}b")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quillgate-"))


_BATCH, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder, so that a lost executor loses nothing."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


#: Tables stored while a `scratch` is open, by scratch.
_open: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that `stored` writes meanwhile are removed at the end; what reads them must be written by then."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            remove(spark, path)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet into the shared checkpoint folder and read again: what carries whole texts is smaller so
    than as a checkpoint.  Within a `scratch` the table goes when that ends."""
    prepare(df.sparkSession)
    spark = df.sparkSession
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stored-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(sizes: Sequence[int | None], limit: int = SLICE_CHARS, most: int = SLICE_TEXTS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` characters each, `most` texts at most; a longer text is alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        n = n or 0
        if i > start and (total + n > limit or i - start >= most):
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def map_texts(
    df: DataFrame, keep: Iterable[str], text: str, schema: str, work: Callable[[list[str]], dict[str, list]]
) -> DataFrame:
    """Give `work` the texts of whole rows, a slice at a time, and put the lists that it returns beside
    the columns named in `keep`.  Null texts reach `work` as they are.  No shuffle."""
    prepare(df.sparkSession)
    keep = list(keep)
    own = text in keep and dict(df.dtypes)[text] == "string"  # then the text need not travel twice
    kept = df.select(*[df[c] for c in keep], *([] if own else [df[text].cast("string").alias("__text")]))
    at = keep.index(text) if own else len(keep)
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[: len(keep)])
    full = f"{head}, {schema}" if head else schema
    names = [x.strip().split()[0].strip("`") for x in _top_level(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            for a, b in slices(pc.binary_length(texts).to_pylist()):
                out = work(texts.slice(a, b - a).to_pylist())
                cols = [batch.column(i).slice(a, b - a) for i in range(len(keep))]
                cols += [pa.array(out[n]) if not isinstance(out[n], pa.Array) else out[n] for n in names]
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, *names])

    return kept.mapInArrow(run, full)


def _top_level(schema: str) -> list[str]:
    """Split a DDL list at the commas that stand outside angle brackets."""
    parts, depth, last = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(schema[last:i])
            last = i + 1
    return [*parts, schema[last:]]


#: Rows up to which a table of figures by group goes to every executor.  Beyond it a join shuffles.
SMALL_ROWS = 10_000


def look_up(df: DataFrame, small: DataFrame, on: list[str], rows: int, how: str = "left") -> DataFrame:
    """Join with a table of `rows` rows: broadcast only if their number is small."""
    return df.join(F.broadcast(small) if rows <= SMALL_ROWS else small, on, how)


#: A key with more than this share of all rows is hot; there are fewer hot keys than its inverse.
HOT_KEYS = 1000


def join_skewed(rows: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """rows joined with a table that has each key once, and in `weight` the number of rows with it (dropped).

    Rows of hot keys stay where they are, as the table's rows for these, fewer than HOT_KEYS, are broadcast; only
    the rest is shuffled by key.  Both sides should be cheap to read twice.  Null keys match nothing.
    """
    total, top = table.agg(F.sum(weight), F.max(weight)).first()
    limit = (total or 0) // HOT_KEYS
    if (top or 0) <= max(limit, 1):
        return rows.join(table.drop(weight), key)
    hot = F.broadcast(table.filter(F.col(weight) > limit).drop(weight))
    cold = rows.join(F.broadcast(table.filter(F.col(weight) > limit).select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(cold.join(table.filter(F.col(weight) <= limit).drop(weight), key))
