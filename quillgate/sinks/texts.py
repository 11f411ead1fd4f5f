"""Text files, one a row, each written by the task that has the row."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quillgate.session import prepare

from .artifacts import _place


def write_texts(df: DataFrame, path: str = "path", text: str = "text") -> int:
    """Write each row's text to the file that it names, in a folder that driver and executors share; how many were written.
    A file appears whole, by a move, so that a task which runs again leaves the same."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for to, held in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                store, place = _place(to)
                store.create_dir(place.rpartition("/")[0], recursive=True)
                part = f"{place}.part-{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write((held or "").encode())
                store.move(part, place)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    return sum(r.n for r in df.select(path, text).mapInArrow(run, "n long").collect())
