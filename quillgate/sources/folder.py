"""Text files of a folder, or those named, as a table: a group of files is a partition."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillgate.session import prepare
from quillgate.sinks.artifacts import _place

SUFFIXES = (".txt", ".md")
#: Bytes of files that one partition reads, where the option `group` names no number of files.
GROUP_BYTES = 32 << 20
SCHEMA = "at long, path string, name string, text string, problem string"


@dataclass
class Files(InputPartition):
    found: list[tuple[int, str]]


def decoded(content: bytes) -> tuple[str | None, str | None]:
    """The text without a byte order mark, or what is wrong: the first byte that is no UTF-8, and where."""
    try:
        return content.decode("utf-8-sig"), None
    except UnicodeDecodeError as e:
        # Offsets count from the file's first byte; the codec counts from behind the mark.
        mark = 3 if content.startswith(b"\xef\xbb\xbf") and e.object is not content and len(e.object) < len(content) else 0
        return None, f"not UTF-8: byte 0x{e.object[e.start]:02x} at offset {e.start + mark}"


def is_link(path: str) -> bool:
    return os.path.islink(path.removeprefix("file://"))


class FolderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[Files]:
        """Planned once, on the driver: names and sizes only."""
        named = self.options.get("files")
        if named is None:
            store, place = _place(self.options["path"].rstrip("/"))
            found = [i for i in store.get_file_info(fs.FileSelector(place)) if i.type == fs.FileType.File and i.path.lower().endswith(SUFFIXES)]
            local = isinstance(store, fs.LocalFileSystem)
            kept = [(i.path, i.size or 0) for i in found if not (local and is_link(i.path))]
            kept.sort(key=lambda x: (os.path.basename(x[0]).lower(), x[0]))
        else:
            kept = [(p, (s.get_file_info(q).size or 0)) for p in json.loads(named) for s, q in [_place(p)]]
        group, limit = int(self.options.get("group", "0")), GROUP_BYTES
        out, held = [], 0
        for at, (path, size) in enumerate(kept, 1):
            full = not out or (len(out[-1].found) >= group if group else held + size > limit)
            if full:
                out.append(Files([]))
                held = 0
            out[-1].found.append((at, path))
            held += size
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        for at, path in partition.found:
            store, place = _place(path)
            name = os.path.basename(place)
            if isinstance(store, fs.LocalFileSystem) and is_link(place):
                yield at, path, name, None, "symbolic link"
                continue
            try:
                with store.open_input_stream(place) as f:
                    text, problem = decoded(f.read())
            except (FileNotFoundError, IsADirectoryError):
                text, problem = None, "file not found"
            yield at, path, name, text, problem


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quillgate-texts"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        return FolderReader(dict(self.options))


def read_folder(spark: SparkSession, path: str, group: int = 0) -> DataFrame:
    """at (from 1, in the order of lower-case names), path, name, text and problem of a folder's .txt and .md files.

    Symbolic links are left out.  A byte order mark is no text.  A file that is no UTF-8 has a null text, and its problem
    names the byte and its offset.  A folder without such files gives no rows.
    """
    prepare(spark)
    spark.dataSource.register(FolderSource)
    return spark.read.format(FolderSource.name()).option("group", str(group)).load(path)


def read_files(spark: SparkSession, paths: Sequence[str], group: int = 0) -> DataFrame:
    """As `read_folder`, of the files named, in their order; a link or a file that is missing has its problem."""
    prepare(spark)
    spark.dataSource.register(FolderSource)
    return spark.read.format(FolderSource.name()).options(files=json.dumps(list(paths)), group=str(group)).load()


def problems(rows: DataFrame) -> list[str]:
    """What is wrong with the files, each named; twenty at most, as a message shows them."""
    return [f"{r.path}: {r.problem}" for r in rows.filter("problem is not null").orderBy("at").select("path", "problem").limit(20).collect()]
