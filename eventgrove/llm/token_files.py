"""Token files: one concatenated id array per file, document boundaries and ids as Elias-Fano lists.

A file is ``MAGIC``, a header (documents, ids, documents without id, first document id, bytes of an id),
the list of boundaries (where each document's ids end), the list of document ids less the first one, and
the ids as little-endian integers of 2 or 4 bytes. Documents lie in ascending order of their id, null ids
first, through all files in the order of (part, number). No table of 64-bit offsets is written: the select
structure of the boundary list gives a document's place.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventgrove.llm import elias_fano
from eventgrove.llm.byte_pieces import pieces_of
from eventgrove.llm.columns import sub_batches
from eventgrove.plans.scratch import freeze, scratch_path

MAGIC = b"EGTOKEN1"
HEADER = struct.Struct("<QQQqB7x")
#: Bytes of ids after which a file is closed, and of ids that a reader holds at once.
FILE_BYTES = 16 << 20
READ_BYTES = 4 << 20
MANIFEST = "part int, number int, file string, n_docs bigint, n_ids bigint"


def open_folder(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder given as a plain path or as a URI."""
    return fs.FileSystem.from_uri(folder) if urlsplit(folder).scheme else (fs.LocalFileSystem(), folder)


def file_bytes(doc_ids: list[int | None], counts: np.ndarray, ids: list[np.ndarray], width: int) -> bytes:
    """Content of one file; null ids come first, the others ascend."""
    n_null = sum(d is None for d in doc_ids)
    known = np.array([d for d in doc_ids if d is not None], dtype=np.int64)
    first = int(known[0]) if len(known) else 0
    ends = np.cumsum(counts)
    n_ids = int(ends[-1]) if len(ends) else 0
    # Differences of signed ids as unsigned numbers: right for the whole range.
    above = known.view(np.uint64) - np.array([first], dtype=np.int64).view(np.uint64)
    head = MAGIC + HEADER.pack(len(doc_ids), n_ids, n_null, first, width)
    lists = elias_fano.encode(ends.astype(np.uint64), n_ids) + elias_fano.encode(above, int(above[-1]) if len(above) else 0)
    return head + lists + b"".join(part.astype(f"<u{width}").tobytes() for part in ids)


class TokenFile:
    """Random access to one file. ``read(at, n)`` gives n bytes of it, so only what is asked for is held."""

    def __init__(self, size: int, read) -> None:
        at = len(MAGIC) + HEADER.size
        head = read(0, at)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token file")
        self.n_docs, self.n_ids, self.n_null, self.first, self.width = HEADER.unpack_from(head, len(MAGIC))
        self.body = size - self.n_ids * self.width
        lists = read(at, self.body - at)
        self.ends = elias_fano.EliasFano(lists)
        self.names = elias_fano.EliasFano(lists, self.ends.end)
        if self.ends.n != self.n_docs or self.names.n != self.n_docs - self.n_null:
            raise ValueError("lists of a token file differ from its header")
        self.read = read

    def starts(self, docs: np.ndarray) -> np.ndarray:
        """Ids of the file before each of the documents number ``docs``."""
        out = np.zeros(len(docs), dtype=np.int64)
        out[docs > 0] = self.ends.get(docs[docs > 0] - 1).astype(np.int64)
        return out

    def doc_ids(self, docs: np.ndarray) -> list[int | None]:
        known = docs >= self.n_null
        values = (self.names.get(docs[known] - self.n_null) + np.array([self.first], dtype=np.int64).view(np.uint64)).view(np.int64)
        return [None] * int((~known).sum()) + values.tolist()

    def ids(self, start: int, end: int) -> np.ndarray:
        return np.frombuffer(self.read(self.body + start * self.width, (end - start) * self.width), dtype=f"<u{self.width}")

    def blocks(self, limit: int = READ_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(documents, their bounds in the file) in stretches of about ``limit`` bytes of ids."""
        bounds = np.concatenate([[0], self.ends.all().astype(np.int64)])
        at = 0
        while at < self.n_docs:
            to = int(np.searchsorted(bounds, bounds[at] + max(limit // self.width, 1), side="right")) - 1
            to = min(max(to, at + 1), self.n_docs)
            yield np.arange(at, to), bounds[at : to + 1]
            at = to


def open_token_file(folder: str, file: str) -> TokenFile:
    system, path = open_folder(folder)
    handle = system.open_input_file(posixpath.join(path, file))

    def read(at: int, n: int) -> bytes:
        handle.seek(at)
        return handle.read(n)

    return TokenFile(handle.size(), read)


def write_token_files(df: DataFrame, folder: str, tokenizer: str, end_id: int, id: str = "doc_id", text: str = "text", file_limit: int = FILE_BYTES) -> DataFrame:
    """Encode every text, append ``end_id``, and write token files to ``folder``; the frozen list of files comes back.

    ``tokenizer`` is the JSON of a tokenizer, ``id`` a column of integers. Files lie in ascending order of
    the id (nulls first); rows with equal ids are ordered by text. A null text is empty, so it has the end
    id only; a text longer than ``file_limit`` makes a file of its own. An empty table makes no file. Other
    columns are not read. ``folder`` must be one that all executors reach.

    One range shuffle sorts the texts; each task codes its rows as they come and holds one file at most. A
    file is written beside its place and then moved, and its name follows from the task, so a task that
    runs again replaces it; what counts is the list.
    """
    rows = df.select(F.col(id).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    order = [F.col("id").asc_nulls_first(), F.col("hash")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = pieces_of(tokenizer)
        width = 2 if max(coder.vocabulary, end_id + 1) <= 1 << 16 else 4
        system, path = open_folder(folder)
        part, written = TaskContext.get().partitionId(), []
        names: list[int | None] = []
        counts: list[int] = []
        held: list[np.ndarray] = []
        size = 0

        def close() -> None:
            nonlocal size
            file = f"{part:06d}-{len(written):06d}.tokens"
            beside = posixpath.join(path, f".{file}-{uuid.uuid4().hex}")
            with system.open_output_stream(beside) as out:
                out.write(file_bytes(names, np.array(counts, dtype=np.int64), held, width))
            system.move(beside, posixpath.join(path, file))
            written.append((part, len(written), file, len(names), sum(counts)))
            names.clear(), counts.clear(), held.clear()
            size = 0

        for batch in sub_batches(batches, "text"):
            ids, lengths = coder.encode(batch.column("text").to_pylist())
            upto = np.cumsum(lengths)
            ended = np.insert(ids, upto, end_id).astype(f"<u{width}")
            # Documents up to the one with which the file is full.
            at, bounds = 0, np.concatenate([[0], upto + np.arange(1, len(upto) + 1)])
            doc_ids = batch.column("id").to_pylist()
            while at < len(doc_ids):
                to = int(np.searchsorted(bounds, bounds[at] + (file_limit - size) // width, side="right")) - 1
                to = min(max(to, at if names else at + 1), len(doc_ids))
                if to > at:
                    names.extend(doc_ids[at:to])
                    counts.extend(np.diff(bounds[at : to + 1]).tolist())
                    held.append(ended[bounds[at] : bounds[to]])
                    size += int(bounds[to] - bounds[at]) * width
                    at = to
                if at < len(doc_ids):
                    close()
        if names:
            close()
        if written:
            yield pa.RecordBatch.from_pylist([dict(zip(("part", "number", "file", "n_docs", "n_ids"), w)) for w in written], schema=schema)

    schema = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
    open_folder(folder)[0].create_dir(open_folder(folder)[1], recursive=True)
    return freeze(rows.mapInArrow(run, MANIFEST), "token_files")


def with_bases(files: DataFrame) -> DataFrame:
    """The list of files with ``base``, the ids in all files before each. Windows hold one task's files, and one row per task."""
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(before(Window.orderBy("part"))), zero).alias("_before"))
    inside = F.coalesce(F.sum("n_ids").over(before(Window.partitionBy("part").orderBy("number"))), zero)
    return files.withColumn("_inside", inside).join(parts, "part").withColumn("base", F.col("_before") + F.col("_inside")).drop("_before", "_inside")


def read_token_files(files: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, and its ``ids`` if asked for.

    ``start`` counts the ids of all documents before it. A task reads whole files, a stretch at a time.
    """
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.LongType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                source = open_token_file(folder, row["file"])
                if (source.n_docs, source.n_ids) != (row["n_docs"], row["n_ids"]):
                    raise ValueError(f"{row['file']} is not the file of the list")
                for docs, bounds in source.blocks():
                    ids = source.ids(int(bounds[0]), int(bounds[-1]))
                    as_bytes = memoryview(ids.astype("<u4").tobytes())
                    local = ((bounds - bounds[0]) * 4).tolist()
                    crcs = [zlib.crc32(as_bytes[a:b]) for a, b in zip(local, local[1:])]
                    made = [
                        pa.array(source.doc_ids(docs), pa.int64()),
                        pa.array(source.starts(docs) + row["base"], pa.int64()),
                        pa.array(np.diff(bounds), pa.int64()),
                        pa.array(crcs, pa.int64()),
                    ]
                    if with_ids:
                        made.append(pa.ListArray.from_arrays(pa.array(bounds - bounds[0], pa.int32()), pa.array(ids.astype(np.int64))))
                    yield pa.RecordBatch.from_arrays(made, names=[f.name for f in fields])

    spread = max(files.sparkSession.sparkContext.defaultParallelism, 1) * 4
    return with_bases(files).repartition(spread, "file").mapInArrow(run, T.StructType(fields))


def token_folder(spark) -> str:
    """A new folder for token files in the shared folder."""
    return scratch_path(spark, "tokens")
