"""Text files of blocks that blank lines separate, as a Spark data source.

``spark.read.format("text_blocks")`` after ``register(spark)``; options: ``suffix`` of the file names,
``domain`` (a folder that must be on the path; files elsewhere are not opened), ``splitBytes``. Rows:
``value`` (the block's lines, joined by a line feed) and ``file``. Lines may end in LF or CRLF.

A file is read in splits of bytes, and a task takes as many splits as keep the tasks of a large input few. A block belongs to the split in which the blank line before it starts,
so a reader skips to its first blank line and reads on over its end to the next one. Splits need no look
at other splits, and a long file spreads over many tasks whatever its line ends.
"""

from __future__ import annotations

import io
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLIT_BYTES = 64 << 20
#: Tasks that an input of short splits is dealt over; a task reads no more than SPLIT_BYTES (or one split) for it.
MOST_TASKS = 512
BATCH_BYTES = 1 << 20
WHITE = b" \t\r\n"


@dataclass
class Split:
    file: str
    start: int
    end: int


@dataclass
class Splits(InputPartition):
    """What one task reads, one split after the other."""

    splits: list[Split]


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if urlsplit(path).scheme else (fs.LocalFileSystem(), path)


def blocks_of(file, start: int, end: int) -> Iterator[bytes]:
    """Blocks whose blank line before lies in [start, end); the file's first block belongs to the split at 0."""
    file.seek(max(start - 1, 0))
    at = max(start - 1, 0)
    if start > 0:  # to the first line that starts at or after ``start``
        at += len(file.readline())
    inside = start == 0
    held: list[bytes] = []
    for line in file:
        if not line.strip(WHITE):
            if held:
                yield b"\n".join(held)
                held = []
            inside = at < end
            if not inside:
                return
        elif inside:
            held.append(line.rstrip(b"\r\n"))
        at += len(line)
    if held:
        yield b"\n".join(held)


class BlockReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.suffix, self.domain = options.get("suffix", ""), options.get("domain")
        self.size = int(options.get("splitbytes", options.get("splitBytes", SPLIT_BYTES)))

    def partitions(self) -> list[Splits]:
        system, path = file_system(self.path)
        found = system.get_file_info(path)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
        # As Spark's own readers do, names that start with a dot or underscore are passed over.
        wanted = lambda f: f.type == fs.FileType.File and f.path.endswith(self.suffix) and posixpath.basename(f.path)[0] not in "._"
        chosen = sorted((f.path, f.size) for f in files if wanted(f) and (not self.domain or f"/{self.domain}/" in f.path))
        splits = [Split(name, start, min(start + self.size, size)) for name, size in chosen for start in range(0, size, self.size)]
        share = min(SPLIT_BYTES, sum(size for _, size in chosen) // MOST_TASKS)
        tasks: list[Splits] = []
        held = share
        for split in splits:
            if held >= share:
                tasks.append(Splits([]))
                held = 0
            tasks[-1].splits.append(split)
            held += split.end - split.start
        return tasks

    def read(self, task: Splits) -> Iterator[pa.RecordBatch]:
        if task is None:  # no file: Spark asks once without a split
            return
        for split in task.splits:
            yield from self.read_split(split)

    def read_split(self, split: Split) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.path)
        with io.BufferedReader(system.open_input_file(split.file), BATCH_BYTES) as file:
            held: list[bytes] = []
            size = 0
            for block in blocks_of(file, split.start, split.end):
                held.append(block)
                size += len(block)
                if size > BATCH_BYTES:
                    yield self.batch(held, split.file)
                    held, size = [], 0
            if held:
                yield self.batch(held, split.file)

    @staticmethod
    def batch(blocks: list[bytes], file: str) -> pa.RecordBatch:
        values = pa.array([b.decode("utf-8", "replace") for b in blocks], pa.string())
        return pa.RecordBatch.from_arrays([values, pa.array([file] * len(blocks), pa.string())], names=["value", "file"])


class TextBlocks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "text_blocks"

    def schema(self) -> str:
        return "value string, file string"

    def reader(self, schema) -> BlockReader:
        return BlockReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TextBlocks)
