"""Which word shingles of a corpus occur in several documents, without a row per shingle.

A task hashes the shingles of its documents and deals the hashes of a batch to buckets, as packed sorted
arrays. A bucket finds the hashes that several documents share and sends each batch back what it holds of
them, with a frequency class. The batch then has, for every document, its ordered list of shared shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventgrove.llm.anchors import BYTE_CODES, FACTORS, mixed, span_hashes
from eventgrove.llm.columns import sub_batches

#: Text of a batch, and of what one bucket counts, about.
BATCH_TEXT, BUCKET_TEXT = 8 << 20, 16 << 20
BATCH_DOCS = 60_000
#: A shingle is a bucket number (16 bits at most) and a remainder of 40 bits; its token puts the frequency class in front.
REST_BITS, BUCKET_BITS = 40, 16
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def document_shingles(texts: list[bytes | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of all word shingles, repeats included; a shorter text is one shingle."""
    data = b" ".join(t or b"" for t in texts)
    raw = FOLD[np.frombuffer(data, dtype=np.uint8)]
    bounds = np.cumsum([0, *(len(t or b"") + 1 for t in texts)])
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edges = np.flatnonzero(np.diff(np.r_[False, inside, False].view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    codes = span_hashes(BYTE_CODES[raw], starts, ends) if len(raw) else np.zeros(0, dtype=np.uint64)
    text = np.searchsorted(bounds, starts, side="right") - 1
    if not len(codes):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    words = np.bincount(text, minlength=len(texts))
    whole = np.zeros(0, dtype=np.uint64)
    if len(codes) >= n:
        total = np.zeros(len(codes) - n + 1, dtype=np.uint64)
        for k in range(n):
            total += codes[k : len(codes) - n + 1 + k] * FACTORS[k]
        same = text[: len(total)] == text[n - 1 :]
        whole, of = mixed(total[same]), text[: len(total)][same]
    else:
        of = np.zeros(0, dtype=np.int64)
    short = np.flatnonzero((words > 0) & (words < n))
    if len(short):
        first = np.searchsorted(text, short)
        parts = []
        for a, k in zip(first, words[short]):
            value = FACTORS[10 + int(k)]
            for j in range(int(k)):
                value = value ^ mixed(codes[a + j : a + j + 1] * FACTORS[j])[0]
            parts.append(value)
        whole, of = np.r_[whole, np.array(parts, dtype=np.uint64)], np.r_[of, short]
    return whole, of


def packed(rest: np.ndarray, doc: np.ndarray, level: np.ndarray | None = None) -> bytes:
    """Sorted 40-bit numbers, document numbers and levels, byte plane by byte plane, compressed."""
    planes = [((rest >> np.uint64(8 * k)) & np.uint64(255)).astype(np.uint8).tobytes() for k in range(5)]
    levels = b"" if level is None else level.astype(np.uint8).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(b"".join([*planes, doc.astype("<u2").tobytes(), levels]))


def unpacked(data: bytes, leveled: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = len(raw) // (8 if leveled else 7)
    rest = np.zeros(n, dtype=np.uint64)
    for k in range(5):
        rest |= np.frombuffer(raw, dtype=np.uint8, count=n, offset=k * n).astype(np.uint64) << np.uint64(8 * k)
    return rest, np.frombuffer(raw, dtype="<u2", count=n, offset=5 * n), np.frombuffer(raw, dtype=np.uint8, offset=7 * n)


def shared_shingles(df: DataFrame, n: int, percent: int, id: str, text: str) -> DataFrame:
    """(id, n_shingles, tokens): one row per row of ``df``.

    ``tokens`` has the shingles that occur in other documents too, rarest first, as numbers in one global
    order. It is null where they are less than ``percent`` of the set, because then no other set is similar
    enough, and where the set is empty.
    """
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0  # one number: it sets the count of buckets
    buckets = int(min(1 << BUCKET_BITS, max(8, size // BUCKET_TEXT)))
    rows = df.select(F.col(id).cast("bigint").alias("id"), F.col(text).cast("binary").alias("data"))
    batch_schema = "batch bigint, bucket int, shingles binary, ids array<bigint>, sizes array<int>"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        tokens: list[np.ndarray] = []
        docs: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = 0

        def send() -> pa.RecordBatch:
            token = np.concatenate(tokens) if tokens else np.zeros(0, dtype=np.uint64)
            doc = np.concatenate(docs) if docs else np.zeros(0, dtype=np.int64)
            order = np.argsort(token, kind="stable")
            token, doc = token[order], doc[order]
            cuts = np.searchsorted(token >> np.uint64(REST_BITS), np.arange(buckets + 1, dtype=np.uint64))
            mask = np.uint64((1 << REST_BITS) - 1)
            batch = (part << 32) | number
            filled = [b for b in range(buckets) if cuts[b] < cuts[b + 1]] or [0]
            home = filled[batch % len(filled)]  # the bucket whose row carries the documents of the batch
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([batch] * len(filled), type=pa.int64()),
                    pa.array(filled, type=pa.int32()),
                    pa.array([packed(token[cuts[b] : cuts[b + 1]] & mask, doc[cuts[b] : cuts[b + 1]]) for b in filled], type=pa.binary()),
                    pa.array([ids if b == home else None for b in filled], type=pa.list_(pa.int64())),
                    pa.array([np.concatenate(sizes).tolist() if b == home else None for b in filled], type=pa.list_(pa.int32())),
                ],
                names=["batch", "bucket", "shingles", "ids", "sizes"],
            )

        for piece in sub_batches(batches, "data", 1 << 20):
            for piece in (piece.slice(k, BATCH_DOCS) for k in range(0, piece.num_rows, BATCH_DOCS)):
                hashes, of = document_shingles(piece.column(1).to_pylist(), n)
                # Distinct per document, on the whole hash.
                order = np.argsort(hashes, kind="stable")
                hashes, of = hashes[order], of[order]
                new = np.r_[True, (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])] if len(hashes) else np.zeros(0, dtype=bool)
                hashes, of = hashes[new], of[new]
                low = np.uint64((1 << 24) - 1)
                bucket = ((hashes & low) * np.uint64(buckets)) >> np.uint64(24)
                if len(ids) and (len(ids) + piece.num_rows > BATCH_DOCS or held > BATCH_TEXT):
                    yield send()
                    number, held = number + 1, 0
                    ids, tokens, docs, sizes = [], [], [], []
                tokens.append((bucket << np.uint64(REST_BITS)) | (hashes >> np.uint64(24)))
                docs.append(of + len(ids))
                names = piece.column(0).to_pylist()
                size = np.bincount(of, minlength=piece.num_rows)
                sizes.append(np.where([i is None for i in names], -1 - size, size))  # negative: the id is null
                ids.extend(0 if i is None else i for i in names)
                held += piece.column(1).nbytes
        if ids:
            yield send()

    def count(bucket: pd.DataFrame) -> pd.DataFrame:
        parts = [unpacked(x) for x in bucket["shingles"]]
        sizes = np.array([len(p[0]) for p in parts])
        rest = np.concatenate([p[0] for p in parts])
        order = np.argsort(rest, kind="stable")
        new = np.r_[True, rest[order][1:] != rest[order][:-1]] if len(rest) else np.zeros(0, dtype=bool)
        run = np.cumsum(new) - 1
        often = np.bincount(run, minlength=1)
        many = np.empty(len(rest), dtype=np.int64)
        many[order] = often[run]
        del order, run
        out = []
        ends = np.cumsum(sizes)
        for (r, d, _), a, b in zip(parts, ends - sizes, ends):
            shared = np.flatnonzero(many[a:b] > 1)
            # Four classes per doubling, so that the order is a fixed function of the shingle.
            level = np.minimum(127, np.floor(4 * np.log2(many[a:b][shared])))
            out.append(packed(r[shared], d[shared], level))
        return pd.DataFrame({"batch": bucket["batch"], "bucket": bucket["bucket"], "shingles": out, "ids": bucket["ids"], "sizes": bucket["sizes"]})

    def assemble(batch: pd.DataFrame) -> pd.DataFrame:
        home = [i for i, x in enumerate(batch["ids"]) if x is not None][0]
        ids, sizes = np.asarray(batch["ids"].iloc[home], dtype=np.int64), np.asarray(batch["sizes"].iloc[home], dtype=np.int64)
        missing, sizes = sizes < 0, np.where(sizes < 0, -1 - sizes, sizes)
        parts = [unpacked(x, leveled=True) for x in batch["shingles"]]
        front = [(l.astype(np.uint64) << np.uint64(REST_BITS + BUCKET_BITS)) | np.uint64(b << REST_BITS) for (_, _, l), b in zip(parts, batch["bucket"].tolist())]
        token = np.concatenate([f | r for f, (r, _, _) in zip(front, parts)]).view(np.int64)
        doc = np.concatenate([d for _, d, _ in parts]).astype(np.int64)
        order = np.lexsort((token, doc))
        token, doc = token[order], doc[order]
        found = np.bincount(doc, minlength=len(sizes))
        ends = np.cumsum(found)
        enough = (found > 0) & (100 * found >= percent * sizes)
        lists = [token[e - f : e] if ok else None for e, f, ok in zip(ends.tolist(), found.tolist(), enough.tolist())]
        return pd.DataFrame({"id": pd.arrays.IntegerArray(ids.copy(), missing), "n_shingles": sizes, "tokens": lists})

    dealt = rows.mapInArrow(deal, batch_schema)
    back = dealt.groupBy("bucket").applyInPandas(count, batch_schema)
    return back.groupBy("batch").applyInPandas(assemble, "id bigint, n_shingles bigint, tokens array<bigint>")
