"""Removal of repeated byte strings by suffix sorting with bucket-pointer refinement.

Fragments that may repeat come from the anchors module. The suffixes of a shard are put into buckets by
their first eight bytes; a bucket's identifier is its place in the sorted order. Each bucket with several
suffixes is then refined by sorting on the identifiers of the buckets at a later offset, which doubles
the compared depth; the updated identifiers serve the next refinement, until windows are compared whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventgrove.llm.anchors import Symbols, covered, intervals, key_columns

WINDOW_BYTES = 400
#: Bytes of the strings that serve as anchors.
ANCHOR_BYTES = 64
FIRST_BYTES = 8


def first_buckets(keys: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Bucket identifiers: for each valid position, the place of the first equal key in sorted order; -1 elsewhere."""
    at = np.flatnonzero(valid)
    pointers = np.full(len(keys), -1, dtype=np.int64)
    order = np.argsort(keys[at])
    held = keys[at][order]
    new = np.r_[True, held[1:] != held[:-1]] if len(held) else np.zeros(0, dtype=bool)
    pointers[at[order]] = np.flatnonzero(new)[np.cumsum(new) - 1]
    return pointers


def refined(pointers: np.ndarray, room: np.ndarray, depth: int, deeper: int) -> np.ndarray:
    """Identifiers for ``deeper`` symbols from those for ``depth``: buckets are sorted by the identifiers at a later offset.

    ``room`` has the symbols from each position to the end of its fragment. Positions without room keep
    their old identifier, which no longer matters, and single suffixes need no more sorting.
    """
    sizes = np.bincount(pointers[pointers >= 0], minlength=1)
    active = np.flatnonzero((room >= deeper) & (pointers >= 0))
    active = active[sizes[pointers[active]] > 1]
    out = pointers.copy()
    if len(active):
        bucket, later = pointers[active], pointers[active + (deeper - depth)]
        order = np.argsort((bucket << 32) | later)
        bucket, later = bucket[order], later[order]
        new_bucket = np.r_[True, bucket[1:] != bucket[:-1]]
        new = new_bucket | np.r_[True, later[1:] != later[:-1]]
        start = np.flatnonzero(new_bucket)[np.cumsum(new_bucket) - 1]
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        out[active[order]] = bucket + first - start
    return out


def search_by_buckets(data: list[bytes], own: np.ndarray, copies: np.ndarray, symbols: Symbols) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of the fragments that start twice or more in the shard, counting copies of a fragment."""
    window = symbols.window
    text = np.frombuffer(b"".join(data), dtype=np.uint8)
    sizes = np.array([len(d) for d in data])
    ends = np.cumsum(sizes)
    room = np.repeat(ends, sizes) - np.arange(len(text))
    depth = min(FIRST_BYTES, window)
    padded = np.r_[text, np.zeros(depth, dtype=np.uint8)].astype(np.uint64)
    keys = np.zeros(len(text), dtype=np.uint64)
    for k in range(depth):
        keys = (keys << np.uint64(8)) | padded[k : k + len(text)]
    pointers = first_buckets(keys, room >= depth)
    while depth < window:
        deeper = min(2 * depth, window)
        pointers = refined(pointers, room, depth, deeper)
        depth = deeper
    starts = np.flatnonzero(room >= window)
    owner = np.repeat(np.arange(len(data)), own)
    place = starts - (ends - sizes)[owner]
    total = np.bincount(pointers[starts], weights=copies[owner], minlength=1)
    return intervals(total[pointers[starts]] > 1, owner, place)


def kept_bytes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, list[int], list[int]]:
    """The bytes outside the removed stretches, and those stretches."""
    edges = [0, *(x for pair in zip(starts.tolist(), ends.tolist()) for x in pair), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])), starts.tolist(), ends.tolist()


def repeated_strings(df: DataFrame, length: int = WINDOW_BYTES, anchor: int = ANCHOR_BYTES, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(k1, k2, kept binary, starts, ends) of each text that loses bytes; ``key_columns`` finds the row it belongs to.

    A byte goes if a string of ``length`` bytes that covers it starts anywhere else, in the same row or
    another; overlapping strings count, and all are judged on the input. Null texts count as empty.
    Repeated rows are occurrences of their own and share one result. An empty table gives an empty one.
    """
    symbols = Symbols("bytes", length, anchor)
    return covered(df, symbols, search_by_buckets, kept_bytes, "kept binary, starts array<bigint>, ends array<bigint>", id, text)


def strip_repeated_strings(df: DataFrame, length: int = WINDOW_BYTES, anchor: int = ANCHOR_BYTES, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with the bytes of repeated strings cut out of ``text``; a character that loses a byte goes as a whole.

    A text that loses nothing, a null one included, stays as it is.
    """

    def kept_text(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[str]:
        return (kept_bytes(data, starts, ends)[0].decode("utf-8", "ignore"),)

    symbols = Symbols("bytes", length, anchor)
    changed = covered(df, symbols, search_by_buckets, kept_text, "kept string", id, text).toDF("_k1", "_k2", "_kept")
    k1, k2 = key_columns(F.col(id), F.col(text))
    marked = df.select(F.struct("*").alias("row"), k1, k2)
    joined = marked.join(changed, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")), "left")
    return joined.select(
        *(F.coalesce("_kept", F.col(f"row.`{c}`")).alias(c) if c.lower() == text.lower() else F.col(f"row.`{c}`").alias(c) for c in df.columns)
    )
