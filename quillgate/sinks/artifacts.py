"""Artifacts: one JSON, JSON Lines or text file each, byte for byte the same whenever its rows are.

A DataFrame is cut into ranges of a stated order, every task writes its range into a staging folder under a name of its
attempt's own, and the commit joins the ranges of those attempts that Spark counts, in order, and puts the file in its
place in one move.  An attempt that fails, runs twice or is lost leaves at most a file that the commit does not know.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from quillgate.session import prepare

#: jsonl: an object a line, keys sorted; json: a list of objects, within an envelope if a field is named; object: the
#: only row; text: the only column, a line a row.
KINDS = ("jsonl", "json", "object", "text")
CHUNK = 1 << 20


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI, or of a local path that driver and executors share."""
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def _plain(value):
    """A value as JSON can hold it."""
    if isinstance(value, Row):
        return {k: _plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value if value is None or isinstance(value, (bool, int, float, str)) else str(value)


def _pretty(value, depth: int) -> str:
    """Indented by two, as if it stood at that depth of a document."""
    return json.dumps(value, ensure_ascii=False, indent=2).replace("\n", "\n" + "  " * depth)


@dataclass
class Part(WriterCommitMessage):
    at: int
    name: str
    rows: int


class ArtifactWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.kind, self.field = options["path"], options.get("kind", "jsonl"), options.get("field", "")
        self.head = json.loads(options.get("head", "{}"))
        if self.kind not in KINDS:
            raise ValueError(f"kind is one of {', '.join(KINDS)}")
        self.names = schema.names
        self.staging = f"{self.path}.staging-{uuid.uuid4().hex}"
        self.depth = 0 if self.kind != "json" else 2 if self.field else 1

    def _line(self, row: Row) -> str:
        if self.kind == "text":
            return row[0] or ""
        record = _plain(row)
        return json.dumps(record, ensure_ascii=False, sort_keys=True) if self.kind == "jsonl" else _pretty(record, self.depth)

    def _joint(self) -> str:
        return ",\n" + "  " * self.depth if self.kind == "json" else "\n"

    def write(self, rows: Iterator[Row]) -> Part:
        task = TaskContext.get()
        name = f"{self.staging}/part-{task.partitionId():06d}-{task.taskAttemptId()}"
        store, place = _place(name)
        store.create_dir(place.rpartition("/")[0], recursive=True)
        n = 0
        with store.open_output_stream(place) as out:
            for row in rows:
                out.write(((self._joint() if n else "") + self._line(row)).encode())
                n += 1
        return Part(task.partitionId(), name, n)

    def _around(self, rows: int) -> tuple[str, str]:
        """What stands before the first row and after the last one."""
        if self.kind != "json":
            return "", "\n" if rows else ""
        if not self.field:
            return ("[\n  ", "\n]\n") if rows else ("[]", "\n")
        lead = json.dumps({**self.head, self.field: []}, ensure_ascii=False, indent=2)[: -len("[]\n}")]
        return (lead + "[\n    ", "\n  ]\n}\n") if rows else (lead + "[]", "\n}\n")

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted((m for m in messages if m and m.rows), key=lambda m: m.at)
        rows = sum(p.rows for p in parts)
        if self.kind == "object" and rows != 1:
            self.abort(messages)
            raise ValueError(f"{self.path}: an object has one row, not {rows}")
        store, place = _place(self.path)
        if "/" in place:
            store.create_dir(place.rpartition("/")[0] or "/", recursive=True)
        first, last = self._around(rows)
        whole = _place(f"{self.staging}/whole")[1]
        store.create_dir(whole.rpartition("/")[0], recursive=True)
        with store.open_output_stream(whole) as out:
            out.write(first.encode())
            for i, part in enumerate(parts):
                out.write(self._joint().encode() if i else b"")
                with store.open_input_stream(_place(part.name)[1]) as held:
                    while chunk := held.read(CHUNK):
                        out.write(chunk)
            out.write(last.encode())
        store.move(whole, place)
        store.delete_dir(_place(self.staging)[1])

    def abort(self, messages: list[Part | None]) -> None:
        store, place = _place(self.staging)
        if store.get_file_info(place).type == fs.FileType.Directory:
            store.delete_dir(place)


class ArtifactSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quillgate-artifact"

    def writer(self, schema: StructType, overwrite: bool) -> ArtifactWriter:
        return ArtifactWriter(dict(self.options), schema)


def write_artifact(
    df: DataFrame, path: str, order: Sequence[str | Column] = (), kind: str = "jsonl", head: dict | None = None, field: str = "", columns: Sequence[str] | None = None
) -> str:
    """df as one file at `path`, in a folder that driver and executors share; an earlier one is replaced at once, when the
    new one is whole.

    Rows lie in the order of `order` and then of their own values, so that neither ties nor the number of tasks show.  Of
    the columns those named are written, or all.  No rows give an empty file, an empty list, or for an object an error.
    """
    spark: SparkSession = df.sparkSession
    prepare(spark)
    spark.dataSource.register(ArtifactSource)
    by = [*order, F.to_json(F.struct(*[df[c] for c in sorted(df.columns)]))]
    rows = df.repartitionByRange(*by).sortWithinPartitions(*by).select(*(columns or df.columns))
    rows.write.format(ArtifactSource.name()).mode("append").options(path=path, kind=kind, head=json.dumps(head or {}), field=field).save()
    return path
