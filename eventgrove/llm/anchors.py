"""Repeated windows of a fixed number of symbols, found through anchors.

Every window of ``window`` symbols has one anchor: of the ``gram``-symbol strings inside it, the leftmost
with the smallest hash. The choice depends on the window's symbols alone, so equal windows have equal
anchors at the same place. Consecutive windows with one anchor make a run; a run's fragment is what its
windows cover. Windows can be equal only if their anchors are, which leaves fragments whose anchor
occurs again. Equal fragments are counted and kept once, so that thousands of copies are one fragment.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventgrove.llm.columns import sub_batches
from eventgrove.plans.scratch import freeze

#: Bytes of fragments that are indexed together; an anchor that has more is split by longer anchors.
SHARD_BYTES = 1 << 19
#: A split deals the windows of an anchor to so many classes, by the place of the anchor in the window.
CLASSES = 4
#: Symbols of a long text that are hashed at once; windows across the cut belong to the earlier part.
PIECE = 1 << 19
PLACE_BITS = 24
_random = np.random.default_rng(20_240_607)
BYTE_CODES = _random.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FACTORS = _random.integers(0, 1 << 63, 40, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a fixed odd factor modulo 2**64, and of its inverse."""
    held = _powers.get(which)
    if held is None or len(held[0]) < n:
        size = max(n, 1 << 16)
        factor = int(FACTORS[30 + which])
        inverse = pow(factor, -1, 1 << 64)
        made = []
        for f in (factor, inverse):
            out = np.full(size, f, dtype=np.uint64)
            out[0] = 1
            made.append(np.multiply.accumulate(out))
        held = _powers[which] = (made[0], made[1])
    return held[0][:n], held[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of each stretch codes[start:end], whatever stands around it."""
    up, down = powers(len(codes) + 1, which)
    total = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(codes * up[:-1], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * FACTORS[20 + which])


@dataclass(frozen=True)
class Symbols:
    """How a text is cut: "bytes" of its UTF-8 form, or "words" (stretches without ASCII white space)."""

    kind: str
    window: int
    gram: int

    def cut(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(codes, starts, ends) of the symbols of one text."""
        raw = np.frombuffer(data, dtype=np.uint8)
        if self.kind == "bytes":
            at = np.arange(len(raw) + 1)
            return BYTE_CODES[raw], at[:-1], at[1:]
        inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
        edges = np.flatnonzero(np.diff(np.r_[False, inside, False].view(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        return span_hashes(BYTE_CODES[raw], starts, ends), starts, ends

    def joined(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
        """Consecutive symbols as they are stored in a fragment."""
        if self.kind == "bytes":
            return data[int(starts[0]) : int(ends[-1])] if len(starts) else b""
        return b" ".join(data[a:b] for a, b in zip(starts.tolist(), ends.tolist()))


def gram_hashes(codes: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` symbols from each place on; ``gram`` is a power of two."""
    hashed, size, step = codes, 1, 0
    while size < gram:
        hashed = hashed[:-size] * FACTORS[step] + hashed[size:]
        size, step = 2 * size, step + 1
    return mixed(hashed)


PLACE_MASK = np.uint64((1 << PLACE_BITS) - 1)


def runs(codes: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(start, windows, anchor hash, fragment hash) of each run; texts lie between consecutive ``bounds``."""
    n = len(codes)
    if n < window:
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    hashed = gram_hashes(codes, gram)
    least = (hashed & ~PLACE_MASK) | np.arange(len(hashed), dtype=np.uint64)
    width, size = window - gram + 1, 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    valid = np.zeros(n + 1, dtype=np.int8)
    lengths = np.diff(bounds)
    whole = lengths >= window
    np.add.at(valid, bounds[:-1][whole], 1)
    np.add.at(valid, bounds[1:][whole] - window + 1, -1)
    at = np.flatnonzero(np.cumsum(valid[: len(least)], dtype=np.int8) > 0)
    if not len(at):
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    anchor = (least[at] & PLACE_MASK).astype(np.int64)
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)]
    # A run also ends where a text does: neighbouring texts leave a gap in ``at``, as windows do not cross.
    first = np.flatnonzero(new)
    own = np.diff(np.r_[first, len(at)])
    start, anchor = at[first], anchor[first]
    fragment = span_hashes(codes, start, start + own + window - 1, 1)
    return start, own, hashed[anchor], mixed(fragment + (anchor - start).astype(np.uint64) * FACTORS[25])


def pieces(texts: list[bytes | None], symbols: Symbols) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(codes, bounds, row of each part, first symbol of each part) of texts with a window, in bounded portions."""
    codes, bounds, rows, bases, held = [], [0], [], [], 0
    for row, data in enumerate(texts):
        if not data or len(data) < symbols.window:
            continue
        cut = symbols.cut(data)[0]
        for base in range(0, max(0, len(cut) - symbols.window + 1), PIECE):
            part = cut[base : base + PIECE + symbols.window - 1]
            if held and held + len(part) > PIECE:
                yield np.concatenate(codes), np.array(bounds), np.array(rows), np.array(bases)
                codes, bounds, rows, bases, held = [], [0], [], [], 0
            codes.append(part)
            held += len(part)
            bounds.append(held)
            rows.append(row)
            bases.append(base)
    if codes:
        yield np.concatenate(codes), np.array(bounds), np.array(rows), np.array(bases)


def keyed(df: DataFrame, id: str, text: str) -> DataFrame:
    """(k1, k2, data): a key from id and text, and the text as bytes. Rows that are equal in both share a key."""
    return df.select(*key_columns(F.col(id), F.col(text)), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data"))


def key_columns(id: Column, text: Column) -> tuple[Column, Column]:
    return F.xxhash64(id).alias("k1"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("k2")


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def occurrences(texts: DataFrame, symbols: Symbols) -> DataFrame:
    """(k1, k2, start, own, anchor, fragment): one row per run of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "data", PIECE):
            k1, k2 = (np.asarray(batch.column(i)) for i in (0, 1))
            for codes, bounds, rows, bases in pieces(batch.column(2).to_pylist(), symbols):
                start, own, anchor, fragment = runs(codes, bounds, symbols.window, symbols.gram)
                part = np.searchsorted(bounds, start, side="right") - 1
                row = rows[part]
                columns = [pa.array(k1[row]), pa.array(k2[row]), pa.array(start - bounds[part] + bases[part]), pa.array(own.astype(np.int32)), signed(anchor), signed(fragment)]
                yield pa.RecordBatch.from_arrays(columns, names=["k1", "k2", "start", "own", "anchor", "fragment"])

    return texts.mapInArrow(run, "k1 bigint, k2 bigint, start bigint, own int, anchor bigint, fragment bigint")


#: Repeated windows of the given fragments: (fragment index, first window, end) from (data, windows, copies, symbols).
ShardSearch = Callable[[list[bytes], np.ndarray, np.ndarray, Symbols], tuple[np.ndarray, np.ndarray, np.ndarray]]


def intervals(flags: np.ndarray, owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal stretches of flagged windows: (owner, first, end); entries are ordered by owner and place."""
    at = np.flatnonzero(flags)
    if not len(at):
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(3))
    o, p = owner[at], place[at]
    new = np.r_[True, (o[1:] != o[:-1]) | (p[1:] != p[:-1] + 1)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(at)] - 1
    return o[first], p[first], p[last] + 1


def window_classes(own: int, place: int, slack: int) -> Iterator[tuple[int, int, int, int]]:
    """(first window, end, place of the longer anchor, its slack) of each class of the windows of a fragment.

    ``place`` is where the anchor starts in the fragment and ``slack`` how many symbols of a window lie outside
    it. A class has the windows in which the anchor starts at ``low`` to ``high``; all of them hold the anchor
    and ``low`` symbols before and ``slack - high`` behind it, which is the longer anchor.
    """
    for j in range(CLASSES):
        low, high = j * (slack + 1) // CLASSES, (j + 1) * (slack + 1) // CLASSES - 1
        first, end = max(0, place - high), min(own, place - low + 1)
        if low <= high and first < end:
            yield first, end, place - low, high - low


FRAGMENT = "anchor bigint, fragment bigint, own int, copies bigint, place int, slack int, data binary"


def split_anchors(fragments: DataFrame, symbols: Symbols) -> DataFrame:
    """(of_anchor, of_fragment, base, and the columns of ``FRAGMENT``): the fragments cut by longer anchors.

    Equal windows have the anchor at the same place, so they are of one class and have equal longer anchors.
    ``base`` is the first window of the part in its fragment.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "data", 1 << 18):
            out: list[tuple] = []
            for anchor, fragment, own, copies, place, slack, data in zip(*(batch.column(n).to_pylist() for n in range(7))):
                codes, starts, ends = symbols.cut(data)
                if place < 0:
                    place = int(np.argmin(gram_hashes(codes[: symbols.window], symbols.gram) & ~PLACE_MASK))
                for first, end, longer, left in window_classes(own, place, slack):
                    a, b = first, end + symbols.window - 1
                    at, size = np.array([longer, a]), np.array([symbols.window - left, b - a])
                    key, whole = span_hashes(codes, at, at + size, 2)
                    # The first anchor and the class stay part of the key, the place part of the fragment's name.
                    key = mixed(np.array([key ^ np.uint64(anchor % (1 << 64))]) + np.array([longer - place + slack], dtype=np.uint64) * FACTORS[26])
                    whole = mixed(np.array([whole]) + np.array([longer - a]).astype(np.uint64) * FACTORS[25])
                    out.append((anchor, fragment, first, int(key.view(np.int64)[0]), int(whole.view(np.int64)[0]), end - first, copies, longer - a, left, symbols.joined(data, starts[a:b], ends[a:b])))
            columns = list(zip(*out)) if out else [()] * 10
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(columns, kinds)], names=names)

    names = ["of_anchor", "of_fragment", "base", *(f.split()[0] for f in FRAGMENT.split(", "))]
    return fragments.mapInArrow(run, f"of_anchor bigint, of_fragment bigint, base int, {FRAGMENT}")


def settled(fragments: DataFrame, symbols: Symbols, search: ShardSearch) -> DataFrame:
    """(anchor, fragment, first, end): repeated windows of the fragments (columns of ``FRAGMENT``).

    A shard holds whole anchors. An anchor with more bytes than a shard is cut by longer anchors, again and
    again: what does not surround it everywhere in the same way falls apart, and what does is one fragment with its copies
    counted. A cut leaves a quarter of the slack, so there are few rounds; without slack an anchor is one window.
    """
    spark = fragments.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sizes = fragments.groupBy("anchor").agg(F.sum(F.octet_length("data")).alias("bytes"), F.max("slack").alias("left"))
    hot = freeze(sizes.where((F.col("bytes") > SHARD_BYTES) & (F.col("left") > 0)).select("anchor"), "hot")
    result = "anchor bigint, fragment bigint, first int, end int"

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def settle() -> pa.RecordBatch:
            anchor, fragment, own, copies, data = zip(*held)
            who, first, end = search(list(data), np.array(own), np.array(copies), symbols)
            parts = [np.array(anchor)[who], np.array(fragment)[who], first.astype(np.int32), end.astype(np.int32)]
            return pa.RecordBatch.from_arrays([pa.array(p) for p in parts], names=["anchor", "fragment", "first", "end"])

        for batch in sub_batches(batches, "data", 1 << 20):
            for row in zip(*(batch.column(n).to_pylist() for n in ("anchor", "fragment", "own", "copies", "data"))):
                if held and row[:2] == held[-1][:2]:  # the same fragment from an equal text
                    continue
                if held and size + len(row[4]) > SHARD_BYTES and row[0] != last:
                    yield settle()
                    held, size = [], 0
                held.append(row)
                size, last = size + len(row[4]), row[0]
        if held:
            yield settle()

    any_hot = not hot.isEmpty()
    cold = fragments.join(hot, "anchor", "left_anti") if any_hot else fragments
    cold = cold.select("anchor", "fragment", "own", "copies", "data")
    whole = cold.repartition(parts, "anchor").sortWithinPartitions("anchor", "fragment").mapInArrow(shard, result)
    if not any_hot:
        return whole
    rest = fragments.join(hot, "anchor", "left_semi").repartition(parts, "fragment").dropDuplicates(["anchor", "fragment"])
    cut = freeze(split_anchors(rest.select(*(f.split()[0] for f in FRAGMENT.split(", "))), symbols), "cut")
    one = cut.groupBy("anchor", "fragment").agg(
        F.first("own").alias("own"), F.sum("copies").alias("copies"), F.first("place").alias("place"), F.first("slack").alias("slack"), F.first("data").alias("data")
    )
    again = cut.groupBy("anchor").agg(F.sum("copies").alias("n")).where("n > 1").select("anchor")
    found = settled(freeze(one.join(again, "anchor", "left_semi"), "parts"), symbols, search)
    links = cut.select("of_anchor", "of_fragment", "base", "anchor", "fragment")
    mapped = links.join(found, ["anchor", "fragment"]).select(
        F.col("of_anchor").alias("anchor"), F.col("of_fragment").alias("fragment"), (F.col("base") + F.col("first")).alias("first"), (F.col("base") + F.col("end")).alias("end")
    )
    return whole.unionByName(mapped)


def repeated_windows(df: DataFrame, symbols: Symbols, search: ShardSearch, id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts with a repeated anchor: k1, k2, data; their repeated windows: k1, k2, first, end).

    Window numbers count symbols from the start of the text; rows of the second table may touch or overlap.
    """
    texts = keyed(df, id, text)
    found = freeze(occurrences(texts, symbols), "runs")
    again = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    again = freeze(again, "again")  # with both sides read from tables, a hot anchor's part of the join can be split
    found = freeze(found.join(again, "anchor", "left_semi"), "repeated")
    distinct = freeze(
        found.groupBy("anchor", "fragment").agg(
            F.count(F.lit(1)).alias("copies"),
            F.min("k1").alias("k1"),
            F.min_by("k2", "k1").alias("k2"),
            F.min_by("start", "k1").alias("start"),
            F.max("own").alias("own"),
        ),
        "fragments",
    )
    wanted = distinct.groupBy("k1", "k2").agg(F.collect_list(F.struct("anchor", "fragment", "start", "own", "copies")).alias("wanted"))
    # One row per text that has a repeated anchor, with the fragments to take from it (for most copies: none).
    holders = found.select("k1", "k2").distinct().join(wanted, ["k1", "k2"], "left")
    candidates = freeze(texts.join(holders, ["k1", "k2"]), "candidates")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "data", 1 << 18):
            out: list[tuple] = []
            for data, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                _, starts, ends = symbols.cut(data)
                for w in wanted:
                    a, b = w["start"], w["start"] + w["own"] + symbols.window - 1
                    out.append((w["anchor"], w["fragment"], w["own"], w["copies"], symbols.joined(data, starts[a:b], ends[a:b])))
            columns = list(zip(*out)) if out else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(columns, kinds)], names=["anchor", "fragment", "own", "copies", "data"])

    # Rows with one key are equal texts; each gives the same fragments, of which one is kept below.
    given = candidates.where(F.col("wanted").isNotNull()).select("data", "wanted")
    fragments = freeze(given.mapInArrow(take, "anchor bigint, fragment bigint, own int, copies bigint, data binary"), "texts")
    unplaced = fragments.withColumns({"place": F.lit(-1), "slack": F.lit(symbols.window - symbols.gram)})  # the place is found if it is needed
    repeated = freeze(settled(unplaced, symbols, search), "windows")
    places = found.join(repeated, ["anchor", "fragment"]).select(
        "k1", "k2", (F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("end")).alias("end")
    )
    return candidates.select("k1", "k2", "data"), places


def covered(df: DataFrame, symbols: Symbols, search: ShardSearch, finish: Callable, fields: str, id: str, text: str) -> DataFrame:
    """(k1, k2, *fields) for each text that loses something: ``finish(data, starts, ends)`` of its maximal removed stretches.

    ``starts`` and ``ends`` count symbols. Equal rows give one result.
    """
    candidates, places = repeated_windows(df, symbols, search, id, text)
    by_text = places.groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "end")).alias("spans"))
    # Equal rows lie side by side after the join, so keeping one of them needs no further shuffle.
    joined = candidates.join(by_text, ["k1", "k2"]).select("k1", "k2", "data", "spans").dropDuplicates(["k1", "k2"])
    names = [f.split()[0] for f in fields.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "data"):
            rows = []
            for data, spans in zip(batch.column(2).to_pylist(), batch.column(3)):
                first, end = (np.asarray(spans.values.field(i)) for i in (0, 1))
                order = np.argsort(first, kind="stable")
                first, end = first[order], np.maximum.accumulate(end[order]) + symbols.window - 1
                new = np.r_[True, first[1:] > end[:-1]]
                rows.append(finish(data, first[new], end[np.r_[np.flatnonzero(new)[1:] - 1, len(end) - 1]]))
            made = [pa.array(list(c)) for c in zip(*rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["k1", "k2", *names])

    return joined.mapInArrow(run, f"k1 bigint, k2 bigint, {fields}")
