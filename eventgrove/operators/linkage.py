"""Ward tree by rounds of reciprocal nearest neighbours.

Ward linkage is reducible, so merging every pair of mutual nearest neighbours in a round gives the
tree of one-by-one merging. A cluster is (size, centroid); two clusters A, B are
``sqrt(2|A||B| / (|A|+|B|)) * ||cA - cB||`` apart. A neighbour found in one round stays valid until it
is merged itself, so later rounds search only for the clusters that lost theirs.

The search is exact without visiting all pairs: clusters are packed into blocks of neighbours, and a
block is visited only if the triangle inequality lets it hold something nearer than what is known. A
visited block is tested by products of matrices in single precision; only what rounding could make the
nearest is measured, by plain differences in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from eventgrove.functions.vectors import as_double
from eventgrove.plans.ordering import dense_index, group_rank
from eventgrove.plans.scratch import freeze, scratch_path, temporary_tables

# What fits one search block is searched by one task. Clusters per pivot (and per packed block, as long as the pivots
# suffice), most of them in a packed block, most that ask in one task, most pivots.
BLOCK_ROWS = 1024
CELL_ROWS = 512
MOST_BLOCK_ROWS = 8192
MOST_ASKING_ROWS = 16384
MAX_PIVOTS = 2048
# Clusters that one task sorts and packs; pairs that make a task of a search worth its start.
PACKED_ROWS = 8192
TASK_PAIRS = 1 << 24
# What one task merges to the end, in rows and in numbers of its vectors.
TAIL_ROWS = 32768
TAIL_NUMBERS = TAIL_ROWS * 64

# Provisional ids: a leaf is its own id, the merge of a round is (round + 1) * LEAVES + a leaf of it.
LEAVES = 1 << 40

# What a state row carries beside its cluster: the cached neighbour, and the merge that made it.
_HISTORY = (("left", "bigint"), ("right", "bigint"), ("round", "int"), ("nearest", "bigint"), ("distance", "double"))
_MERGES = "merge bigint, left bigint, right bigint, height double, size bigint, round int"


def _ward(size_a, size_b, squared):
    return np.sqrt(2.0 * (size_a * size_b) / (size_a + size_b) * squared)


def _squared_gaps(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Squared distances by plain differences, so that d(a, b) and d(b, a) are the same number."""
    out = np.empty((len(points), len(others)))
    step = max(1, (1 << 21) // max(1, others.size))
    for at in range(0, len(points), step):
        gap = points[at : at + step, None, :] - others[None, :, :]
        out[at : at + step] = (gap * gap).sum(axis=-1)
    return out


#: Numbers of a matrix that a search holds at a time.
MATRIX_NUMBERS = 1 << 19


def _paired_gaps(points: np.ndarray, row: np.ndarray, others: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Squared distances of ``points[row]`` and ``others[other]``, the same numbers as those of ``_squared_gaps``."""
    gaps, width = np.empty(len(row)), max(1, MATRIX_NUMBERS // max(1, points.shape[1]))
    for k in range(0, len(row), width):
        gap = points[row[k : k + width]] - others[other[k : k + width]]
        gaps[k : k + width] = (gap * gap).sum(axis=-1)
    return gaps


def _closest(points: np.ndarray, others: np.ndarray, own_sizes, sizes, own_ids, ids) -> tuple[np.ndarray, np.ndarray]:
    """(distance, place among ``others``) of the nearest other cluster of each point, the first of equal ones.

    Products of matrices give squared distances up to rounding; only what rounding could make the nearest is
    measured by plain differences. Values that are not finite are all measured so.
    """
    distance, place = np.full(len(points), np.inf), np.zeros(len(points), dtype=np.int64)
    norms = np.einsum("ij,ij->i", others, others)
    step = max(1, MATRIX_NUMBERS // max(1, len(others)))
    for at in range(0, len(points), step):
        rows = slice(at, at + step)
        own = np.einsum("ij,ij->i", points[rows], points[rows])
        scale = own[:, None] + norms[None, :]
        weight = 2.0 * (own_sizes[rows, None] * sizes[None, :]) / (own_sizes[rows, None] + sizes[None, :])
        near = weight * (scale - 2.0 * (points[rows] @ others.T))
        slack = weight * scale * (1e-15 * (points.shape[1] + 16))
        same = own_ids[rows, None] == ids[None, :]
        least = np.where(same, np.inf, near + slack).min(axis=1)
        # Not "less or equal": what is not finite stays a candidate.
        row, other = np.nonzero(~(near - slack > least[:, None]) & ~same)
        if len(row) == 0:
            continue
        gaps = _ward(own_sizes[rows][row], sizes[other], _paired_gaps(points[rows], row, others, other))
        order = np.lexsort((other, gaps, row))
        first = order[np.diff(row[order], prepend=-1) != 0]
        distance[at + row[first]], place[at + row[first]] = gaps[first], other[first]
    return distance, place


def _nearest_in_block(batch: pd.DataFrame) -> pd.DataFrame:
    """Best member for every asking cluster of one block; ties go to the smaller id."""
    asking, members = batch[batch["asks"]], batch[~batch["asks"]].sort_values("cluster")
    if asking.empty or members.empty:
        return pd.DataFrame({"cluster": [], "distance": [], "nearest": []})
    points, others = np.stack(asking["centroid"].to_numpy()), np.stack(members["centroid"].to_numpy())
    ids = members["cluster"].to_numpy()
    sizes = lambda rows: rows["size"].to_numpy().astype(np.float64)
    distance, place = _closest(points, others, sizes(asking), sizes(members), asking["cluster"].to_numpy(), ids)
    found = pd.DataFrame({"cluster": asking["cluster"].to_numpy(), "distance": distance, "nearest": ids[place]})
    return found[np.isfinite(found["distance"])]


def _batches(frames: Iterator[pd.DataFrame], rows: int | None = None) -> Iterator[pd.DataFrame]:
    """Frames with rows, cut to at most ``rows`` of them."""
    for frame in frames:
        for at in range(0, len(frame), rows or max(1, len(frame))):
            yield frame.iloc[at : at + rows] if rows else frame


def _regions(points: np.ndarray, counts: np.ndarray, rows: int) -> list[np.ndarray]:
    """Cells in groups of neighbours that hold up to ``rows`` members each, or a single cell with more."""
    done, todo = [], [np.arange(len(counts))]
    while todo:
        cells = todo.pop()
        if len(cells) == 1 or counts[cells].sum() <= rows:
            done.append(np.sort(cells))
            continue
        axis = points[cells].var(axis=0).argmax()
        cells = cells[np.argsort(points[cells, axis], kind="stable")]
        cut = int(np.searchsorted(np.cumsum(counts[cells]), counts[cells].sum() / 2)) + 1
        cut = min(max(cut, 1), len(cells) - 1)
        todo += [cells[:cut], cells[cut:]]
    return done


def _nearest_in_blocks(blocks: GroupedData) -> DataFrame:
    return blocks.applyInPandas(_nearest_in_block, _FOUND)


def _best_of(found: DataFrame) -> DataFrame:
    """The best answer of each cluster, whatever the number of its rows."""
    return (
        found.groupBy("cluster")
        .agg(F.min(F.struct("distance", "nearest")).alias("_best"))
        .select("cluster", F.col("_best.nearest").alias("nearest"), F.col("_best.distance").alias("distance"))
    )


class _Search:
    """The best known neighbour of the clusters that ask, while blocks of others come one at a time.

    For sizes s and m, ``2sm/(s+m) |x-y|^2 <= t`` is ``|y|^2 - 2xy - t/(2m) <= t/(2s) - |x|^2``, whose left side is one
    product of matrices. It is taken in single precision on vectors around ``middle``, multiplied by ``scale`` to have
    lengths of about 1; a scale of 0 says that they have none, and all is searched in double precision.
    """

    def __init__(self, ids, sizes, points, middle, scale, distance=None, nearest=None):
        self.ids, self.sizes, self.points, self.middle, self.scale = ids, sizes, points, middle, scale
        self.distance = np.full(len(ids), np.inf) if distance is None else distance
        self.nearest = np.zeros(len(ids), dtype=np.int64) if nearest is None else nearest
        self.norms = np.einsum("ij,ij->i", points, points)
        if scale:
            near = (points - middle) * scale
            self.squares = np.einsum("ij,ij->i", near, near)
            self.lengths, self.far = np.sqrt(self.squares), scale * np.sqrt(middle @ middle)
            self.left = np.empty((len(ids), near.shape[1] + 2), dtype=np.float32)
            self.left[:, :-2], self.left[:, -2] = -2.0 * near, 1.0
            self.half = np.empty(len(ids))
            self._know(slice(None))

    def _know(self, rows) -> None:
        self.half[rows] = 0.5 * (self.distance[rows] * self.scale) ** 2
        self.left[rows, -1] = -self.half[rows]

    def visit(self, ids, sizes, points) -> None:
        """Take a block of others, in ascending order of their ids."""
        center, radius = _ball(points)
        possible = ~(_least_ward(self.points, self.norms, self.sizes, center[None, :], np.array([radius]), sizes.min())[:, 0] > self.distance)
        plain = possible & ~np.isfinite(self.distance) if self.scale else possible
        if plain.any():
            rows = np.flatnonzero(plain)
            found, place = _closest(self.points[rows], points, self.sizes[rows], sizes, self.ids[rows], ids)
            self._take(rows, found, ids[place])
            possible &= ~plain
        asks = np.flatnonzero(possible)
        if len(asks) == 0:
            return
        near = (points - self.middle) * self.scale
        squares = np.einsum("ij,ij->i", near, near)
        right = np.vstack([near.T, squares, 1.0 / sizes]).astype(np.float32)
        longest, most = np.sqrt(squares.max()), 1.0 / sizes.min()
        step = max(1, MATRIX_NUMBERS // 2 // len(ids))
        for at in range(0, len(asks), step):
            rows = asks[at : at + step]
            if rows[-1] - rows[0] == len(rows) - 1:
                rows = slice(rows[0], rows[-1] + 1)  # all of them: no copy
            own, length = self.half[rows] / self.sizes[rows], self.lengths[rows] + longest
            # Twice what single precision can be off by, then what the shift to the middle can, then underflow.
            slack = 2.0**-23 * (points.shape[1] + 16) * (length**2 + own + self.half[rows] * most) + 1e-14 * (self.far + length) * length + 1e-30
            limit = (own - self.squares[rows] + slack).astype(np.float32)
            reached = self.left[rows] @ right
            row = np.flatnonzero(~(reached.min(axis=1) > limit))
            if len(row) == 0:
                continue
            which, other = np.nonzero(~(reached[row] > limit[row, None]))
            row = asks[at + row[which]]
            apart = self.ids[row] != ids[other]
            row, other = row[apart], other[apart]
            gaps = _ward(self.sizes[row], sizes[other], _paired_gaps(self.points, row, points, other))
            order = np.lexsort((other, gaps, row))
            order = order[np.diff(row[order], prepend=-1) != 0]
            self._take(row[order], gaps[order], ids[other[order]])

    def _take(self, rows, distance, nearest) -> None:
        better = (distance < self.distance[rows]) | ((distance == self.distance[rows]) & (nearest < self.nearest[rows]))
        rows = rows[better]
        self.distance[rows], self.nearest[rows] = distance[better], nearest[better]
        if self.scale:
            self._know(rows)


def _ball(points: np.ndarray) -> tuple[np.ndarray, float]:
    """Mean of the points and the radius around it that holds them all."""
    center = points.mean(axis=0)
    gaps = points - center
    return center, float(np.sqrt(np.einsum("ij,ij->i", gaps, gaps).max()))


def _least_ward(points, norms, sizes, centers, radii, least) -> np.ndarray:
    """No member of a ball (center, radius, size of ``least`` or more) can be nearer to a point than this."""
    own = np.einsum("ij,ij->i", centers, centers)
    scale = norms[:, None] + own[None, :]
    # The margins keep rounding from shutting out a ball that ties with what is known.
    squared = np.maximum(scale - 2.0 * (points @ centers.T) - scale * (4e-16 * (points.shape[1] + 16)), 0.0)
    gap = np.maximum(np.sqrt(squared) - radii * (1 + 1e-9), 0.0)
    return _ward(sizes[:, None], least, gap * gap) * (1 - 1e-9) - 1e-12


def _scale_of(reach: float) -> float:
    """The power of two that brings vectors of up to this length to about 1, or 0 if none does."""
    with np.errstate(divide="ignore", invalid="ignore"):
        scale = 2.0 ** -np.round(np.log2(reach))
    return float(scale) if 1e-140 < scale < 1e140 else 0.0


def _vectors(column: pa.Array) -> np.ndarray:
    """Rows of equally long vectors; a null number is nan."""
    lengths = np.unique(np.diff(column.offsets.to_numpy()))
    if column.null_count or len(lengths) > 1:
        raise ValueError("vectors must not be null and must have one length")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), int(lengths.sum()))


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.float64)


def _pack(rows: int):
    """Rows of a sorted partition as blocks of ``rows`` neighbours, with the best answer that each who asks finds in its own."""

    def block(number: int, batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column("cluster").fill_null(_UNKNOWN).to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, sizes = ids[order], _numbers(batch.column("size"))[order]
        points = _vectors(batch.column("centroid"))[order]
        asks = batch.column("asks").to_numpy(zero_copy_only=False)[order]
        distance, place = _closest(points[asks], points, sizes[asks], sizes, ids[asks], ids)
        center, radius = _ball(points)
        whole = {"block": number, "n": len(ids), "n_asks": int(asks.sum()), "least": sizes.min(), "radius": radius}
        parts = {"center": center, "ids": ids, "sizes": sizes, "points": points, "asks": asks, "nearest": ids[place]}
        parts["distance"] = np.where(np.isnan(distance), np.inf, distance)
        row = whole | {name: part.tobytes() for name, part in parts.items()}
        return pa.RecordBatch.from_pylist([row], schema=pa.schema(_PACKED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, n = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                held.append(batch.slice(at, rows))
                n += held[-1].num_rows
                while n >= rows:
                    table = pa.Table.from_batches(held).combine_chunks()
                    yield block(number, table.slice(0, rows).to_batches()[0])
                    held, n, number = table.slice(rows).to_batches(), n - rows, number + 1
        if n:
            yield block(number, pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return run


#: Stands for a cluster without an id.
_UNKNOWN = -(1 << 63)
_FOUND = "cluster bigint, distance double, nearest bigint"
_PACKED = [
    *[("block", pa.int64()), ("n", pa.int32()), ("n_asks", pa.int32()), ("least", pa.float64()), ("radius", pa.float64())],
    *[(name, pa.binary()) for name in ("center", "ids", "sizes", "points", "asks", "nearest", "distance")],
]
_PACKED_TYPES = "block bigint, n int, n_asks int, least double, radius double" + "".join(
    f", {name} binary" for name, kind in _PACKED if kind == pa.binary()
)


def _unpacked(batch: pa.RecordBatch, i: int, width: int) -> dict[str, np.ndarray]:
    read = lambda name, kind: np.frombuffer(batch.column(name)[i].as_py(), dtype=kind)
    ids, points = read("ids", np.int64), read("points", np.float64).reshape(-1, width)
    return {"ids": ids, "sizes": read("sizes", np.float64), "points": points} | {
        name: read(name, kind) for name, kind in (("asks", bool), ("nearest", np.int64), ("distance", np.float64)) if name in batch.schema.names
    }


def _pivots(state: DataFrame, n_clusters: int) -> np.ndarray:
    """Points of up to MAX_PIVOTS clusters, near ones beside each other."""
    n_pivots = min(MAX_PIVOTS, max(1, n_clusters // CELL_ROWS))
    # A hash order picks the same pivots on every read; at most MAX_PIVOTS rows reach the driver.
    rows = state.select("cluster", "centroid").orderBy(F.xxhash64("cluster"), "cluster").limit(n_pivots).collect()
    points = np.array([row["centroid"] for row in rows])
    return points[np.concatenate(_regions(points, np.ones(len(points), dtype=np.int64), 1))]


def _packed(state: DataFrame, n_clusters: int, pivots: np.ndarray) -> DataFrame:
    """``state`` (cluster, size, centroid, asks) as blocks of neighbours, of bounded size whatever crowds in one place."""
    middle = pivots.mean(axis=0)
    points = pivots - middle
    with np.errstate(over="ignore", invalid="ignore"):
        right = np.vstack([points.T, np.einsum("ij,ij->i", points, points)]).astype(np.float32)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, MATRIX_NUMBERS // right.shape[1])
        for batch in batches:
            if batch.num_rows == 0:
                continue
            near, cell = _vectors(batch.column("centroid")), np.empty(batch.num_rows, dtype=np.int32)
            for at in range(0, len(near), step):
                rows = near[at : at + step] - middle
                with np.errstate(over="ignore", invalid="ignore"):
                    left = np.hstack([-2.0 * rows, np.ones((len(rows), 1))]).astype(np.float32)
                    cell[at : at + step] = (left @ right).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    columns = "cluster bigint, size bigint, centroid array<double>, asks boolean"
    placed = state.select("cluster", F.col("size").cast("bigint"), "centroid", "asks").mapInArrow(place, f"{columns}, cell int")
    order = [F.col("cell"), F.xxhash64("cluster")]
    dealt = placed.repartitionByRange(max(1, n_clusters // PACKED_ROWS), *order).sortWithinPartitions(*order).drop("cell")
    rows = min(max(CELL_ROWS, n_clusters // MAX_PIVOTS), MOST_BLOCK_ROWS)
    return freeze(dealt.mapInArrow(_pack(rows), _PACKED_TYPES), "packed")


def nearest_clusters(state: DataFrame, asks: Column, n_clusters: int, pivots: np.ndarray | None = None) -> DataFrame:
    """(cluster, nearest, distance) for each cluster of ``state`` that ``asks``, by exact search over all of them.

    ``pivots`` may be those of an earlier state: what they are decides how much is searched, not what is found.
    """
    flagged = state.select("cluster", "size", "centroid", F.coalesce(asks, F.lit(False)).alias("asks"))
    if n_clusters <= BLOCK_ROWS:
        # What is left fits one block: no cells to choose from.
        both = flagged.where("asks").unionByName(flagged.withColumn("asks", F.lit(False)))
        return _best_of(_nearest_in_blocks(both.groupBy(F.lit(0).alias("block"))))
    packed = _packed(flagged, n_clusters, _pivots(flagged, n_clusters) if pivots is None else pivots)
    # A few numbers per block: there are MAX_PIVOTS of them, and more only where each has MOST_BLOCK_ROWS.
    known = packed.select("block", "n", "n_asks", "least", "radius", "center").collect()
    known.sort(key=lambda k: k["block"])
    numbers, n_asks = np.array([k["block"] for k in known]), np.array([k["n_asks"] for k in known])
    if n_asks.sum() == 0:
        return state.sparkSession.createDataFrame([], "cluster bigint, nearest bigint, distance double")
    radii, least, counts = (np.array([k[name] for k in known], dtype=np.float64) for name in ("radius", "least", "n"))
    centers = np.stack([np.frombuffer(k["center"]) for k in known])
    width = centers.shape[1]
    middle = counts @ centers / counts.sum()
    scale = _scale_of(float((np.sqrt(((centers - middle) ** 2).sum(axis=1)) + radii).max()))

    # A task searches one of ``n_parts`` shares of all blocks for one group of blocks that ask. What moves is least if there are as
    # many groups to a share as who ask are to all; a group is neighbours and of bounded size.
    total = int(n_asks.sum())
    tasks = min(3 * state.sparkSession.sparkContext.defaultParallelism, max(1, total * n_clusters // TASK_PAIRS))
    n_groups = max(-(-total // MOST_ASKING_ROWS), round(math.sqrt(tasks * total / n_clusters)), 1)
    n_parts = max(1, -(-tasks // n_groups))
    groups, index = np.unique(((np.cumsum(n_asks) - n_asks) * n_groups // total)[n_asks > 0], return_inverse=True)
    group_of = np.full(len(numbers), -1)
    group_of[n_asks > 0] = index

    def needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per block that asks, one bit for each block that may hold something nearer than its own does."""
        step = max(1, MATRIX_NUMBERS // len(numbers))
        for batch in batches:
            for i in range(batch.num_rows):
                rows = _unpacked(batch, i, width)
                points, sizes = rows["points"][rows["asks"]], rows["sizes"][rows["asks"]]
                norms, needed = np.einsum("ij,ij->i", points, points), np.zeros(len(numbers), dtype=bool)
                for at in range(0, len(sizes), step):
                    some = slice(at, at + step)
                    bound = _least_ward(points[some], norms[some], sizes[some], centers, radii, least)
                    needed |= (~(bound > rows["distance"][some, None])).any(axis=0)
                yield pa.RecordBatch.from_pydict({"block": batch.column("block").slice(i, 1), "bits": [np.packbits(needed).tobytes()]})

    bits = np.zeros((len(groups), -(-len(numbers) // 8)), dtype=np.uint8)
    for row in packed.where("n_asks > 0").mapInArrow(needs, "block bigint, bits binary").collect():  # one row per block
        bits[group_of[np.searchsorted(numbers, row["block"])]] |= np.frombuffer(row["bits"], dtype=np.uint8)
    hearts = np.stack([centers[group_of == g].mean(axis=0) for g in range(len(groups))])

    def targets(block: int) -> list[dict]:
        """The tasks that a block goes to: to ask (away < 0), or to be searched, near ones first."""
        k = int(np.searchsorted(numbers, block))
        mine = np.flatnonzero((bits[:, k // 8] >> (7 - k % 8)) & 1)
        away = np.sqrt(((hearts[mine] - centers[k]) ** 2).sum(axis=1))
        found = [{"task": int(g) * n_parts + k % n_parts, "away": float(x)} for g, x in zip(mine, away, strict=True)]
        return found + [{"task": int(group_of[k]) * n_parts + part, "away": -1.0} for part in range(n_parts) if n_asks[k]]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("task", pa.int32()), ("away", pa.float64())]))
        for batch in batches:
            found = pa.array([targets(block) for block in batch.column("block").to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, "targets"])

    parts = ["ids", "sizes", "points", "asks", "nearest", "distance"]
    layout = ", ".join(f"{name} binary" for name in parts)
    dealt = packed.select("block", *parts).mapInArrow(deal, f"block bigint, {layout}, targets array<struct<task: int, away: double>>")
    # Answers so far go only with the rows that ask.
    sent = dealt.select(F.explode("targets").alias("t"), *parts).select(
        "t.*", *parts[:3], *[F.when(F.col("t.away") < 0, F.col(name)).alias(name) for name in parts[3:]]
    )
    ordered = sent.repartitionById(len(groups) * n_parts, "task").sortWithinPartitions("task", "away")

    def search_of(asking: list[dict[str, np.ndarray]]) -> _Search:
        whole = {name: np.concatenate([rows[name] for rows in asking]) for name in asking[0]}
        return _Search(whole["ids"], whole["sizes"], whole["points"], middle, scale, whole["distance"], whole["nearest"])

    def answers(search: _Search) -> pa.RecordBatch:
        known = np.isfinite(search.distance)
        ids = lambda of: pa.array(of[known], mask=of[known] == _UNKNOWN)
        return pa.RecordBatch.from_pydict({"cluster": ids(search.ids), "distance": search.distance[known], "nearest": ids(search.nearest)})

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come task by task: those of its blocks that ask, then the blocks to be searched."""
        task, asking, search = None, [], None
        for batch in batches:
            of, away = batch.column("task").to_numpy(), batch.column("away").to_numpy()
            for i in range(batch.num_rows):
                if of[i] != task:
                    if asking:
                        yield answers(search or search_of(asking))
                    task, asking, search = of[i], [], None
                rows = _unpacked(batch if away[i] < 0 else batch.select(parts[:3]), i, width)
                if away[i] < 0:
                    asks = rows["asks"]
                    asking.append({name: rows[name][asks] for name in parts[:3]} | {name: rows[name] for name in parts[4:]})
                else:
                    search = search or search_of(asking)
                    search.visit(*(rows[name] for name in parts[:3]))
        if asking:
            yield answers(search or search_of(asking))

    return _best_of(ordered.mapInArrow(visits, _FOUND))


def mutual_pairs(neighbours: DataFrame) -> DataFrame:
    """(left, right, distance) of clusters that are each other's nearest; both rows meet on the pair as key."""
    pair = [F.least("cluster", "nearest").alias("left"), F.greatest("cluster", "nearest").alias("right")]
    return (
        neighbours.where(F.col("nearest").isNotNull())
        .groupBy(*pair)
        .agg(F.count(F.lit(1)).alias("n"), F.min("distance").alias("distance"))
        .where("n = 2")
        .drop("n")
    )


def merge_pairs(state: DataFrame) -> DataFrame:
    """One round on a fresh state (cluster, size, centroid): the pairs it merges and their distances."""
    n = state.count()
    return mutual_pairs(nearest_clusters(state, F.lit(True), n))


def _copy_merges(leaves: DataFrame, groups: DataFrame) -> DataFrame:
    """Balanced trees of height 0 over equal vectors: the copy of rank r > 0 owns one merge.

    It joins the ``step`` copies before r to the up to ``step`` copies from r on, step being the
    lowest set bit of r, so m copies make a tree of log2(m) levels without gathering them.
    """
    copied = groups.where("size > 1").select("centroid", F.col("leaf").alias("root"))
    members = leaves.join(copied, "centroid").select("root", "leaf")
    ranked = freeze(group_rank(members, ["root"], [F.col("leaf")], "r", "m"), "copies")
    step = F.col("r").bitwiseAND(-F.col("r"))
    rest = F.least(step, F.col("m") - F.col("r"))
    exponent = lambda n: F.length(F.bin(n)) - 1
    # The largest power of two below n.
    top = lambda n: F.call_function("shiftleft", F.lit(1).cast("bigint"), exponent(n - 1))
    merges = ranked.where("r > 0").select(
        "root",
        "leaf",
        F.when(step == 1, F.col("r") - 1).otherwise(F.col("r") - F.shiftright(step, 1)).alias("left_rank"),
        (step == 1).alias("left_is_leaf"),
        F.when(rest == 1, F.col("r")).otherwise(F.col("r") + top(rest)).alias("right_rank"),
        (rest == 1).alias("right_is_leaf"),
        (step + rest).alias("size"),
        (exponent(step) - 63).alias("round"),  # before the rounds of different vectors, from 1 on
    )
    at = lambda side: ranked.select("root", F.col("r").alias(f"{side}_rank"), F.col("leaf").alias(f"{side}_leaf"))
    name = lambda side: F.when(F.col(f"{side}_is_leaf"), F.col(f"{side}_leaf")).otherwise(LEAVES + F.col(f"{side}_leaf"))
    return (
        merges.join(at("left"), ["root", "left_rank"])
        .join(at("right"), ["root", "right_rank"])
        .select(
            (LEAVES + F.col("leaf")).alias("merge"),
            name("left").alias("left"),
            name("right").alias("right"),
            F.lit(0.0).alias("height"),
            "size",
            "round",
        )
    )


def _copy_roots(leaves: DataFrame, groups: DataFrame, merges: DataFrame) -> DataFrame:
    """Start state when vectors repeat: a group of copies is the cluster its last merge made."""
    below = merges.select(F.explode(F.array("left", "right")).alias("merge"))
    tops = merges.join(below, "merge", "left_anti").select(
        F.col("merge").alias("cluster"), (F.col("merge") - LEAVES).alias("leaf")
    )
    vectors = leaves.select("leaf", "centroid")
    grown = tops.join(vectors, "leaf").join(groups.select("centroid", "size"), "centroid")
    single = groups.where("size = 1").select(F.col("leaf").alias("cluster"), "size", "centroid")
    return single.unionByName(grown.select("cluster", "size", "centroid"))


def _thin(ids, sizes, heights, points, turn: int) -> Iterator[tuple]:
    """Rounds in one task: per round (turn, ids, sizes, heights, points) of what is left and the merges of the round."""
    nearest, distance = np.full(len(ids), -1), np.full(len(ids), np.inf)
    while len(ids) > BLOCK_ROWS:
        asks = np.flatnonzero(nearest < 0)
        middle = points.mean(axis=0)
        scale = _scale_of(float(np.sqrt(((points - middle) ** 2).sum(axis=1).max())))
        search = _Search(ids[asks], sizes[asks], points[asks], middle, scale)
        for at in range(0, len(ids), CELL_ROWS):
            some = slice(at, at + CELL_ROWS)
            search.visit(ids[some], sizes[some], points[some])
        nearest[asks], distance[asks] = np.searchsorted(ids, search.nearest), search.distance
        every = np.arange(len(ids))
        a = np.flatnonzero((nearest[nearest] == every) & (every < nearest))
        b = nearest[a]
        if len(a) == 0:
            if len(asks) == len(ids):
                raise ValueError("no two vectors have a finite distance")
            nearest[:] = -1  # rounding left no mutual pair: search all afresh
            continue
        total = sizes[a] + sizes[b]
        made = (turn + 1) * LEAVES + np.minimum(ids[a] % LEAVES, ids[b] % LEAVES)
        height = np.maximum(np.maximum(distance[a], heights[a]), heights[b])
        center = (points[a] * sizes[a, None] + points[b] * sizes[b, None]) / total[:, None]
        done = (made, ids[a], ids[b], height, total.astype(np.int64), np.full(len(a), turn))
        alive = np.ones(len(ids), dtype=bool)
        alive[a] = alive[b] = False
        left = np.where(alive[nearest], ids[nearest], -1)[alive]
        # Later rounds have larger ids, so all stay in order once the new ones are.
        order = np.argsort(made)
        ids, sizes = np.append(ids[alive], made[order]), np.append(sizes[alive], total[order])
        heights, points = np.append(heights[alive], height[order]), np.concatenate([points[alive], center[order]])
        distance = np.append(distance[alive], np.full(len(a), np.inf))
        nearest = np.append(np.where(left < 0, -1, np.searchsorted(ids, left)), np.full(len(a), -1))
        turn += 1
        yield turn, ids, sizes, heights, points, done


def _finish(first_round: int):
    """The last clusters (TAIL_ROWS at most) in a single task: by rounds down to BLOCK_ROWS, then one by one."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [frame for frame in _batches(frames)]
        if not rows:
            return
        given = pd.concat(rows).sort_values("cluster")
        turn, columns = first_round, ["merge", "left", "right", "height", "size", "round"]
        if len(given) > BLOCK_ROWS:
            points = np.stack(given["centroid"].to_numpy())
            own = (given["cluster"].to_numpy(), given["size"].to_numpy().astype(np.float64), given["height"].to_numpy(), points)
            for turn, *own, done in _thin(*own, turn):  # noqa: B020
                yield pd.DataFrame(dict(zip(columns, done, strict=True)))
            ids, sizes, heights, points = own
            given = pd.DataFrame({"cluster": ids, "size": sizes.astype(np.int64), "centroid": list(points), "height": heights})
        yield from one_by_one(given, turn)

    def one_by_one(left: pd.DataFrame, first_round: int) -> Iterator[pd.DataFrame]:
        n = len(left)
        slots = 2 * n - 1  # the clusters given, then each merge as it is made
        ids, sizes, heights = np.zeros(slots, dtype=np.int64), np.zeros(slots, dtype=np.int64), np.zeros(slots)
        ids[:n], sizes[:n], heights[:n] = left["cluster"], left["size"], left["height"]
        points = np.zeros((slots, len(left["centroid"].iloc[0])))
        points[:n] = np.stack(left["centroid"].to_numpy())
        # Distances to later slots, and the nearest of them: a merge changes one column and the rows that pointed to its parts.
        gaps = np.full((slots, slots), np.inf)
        size = sizes[:n].astype(np.float64)
        gaps[:n, :n] = _ward(size[:, None], size[None, :], _squared_gaps(points[:n], points[:n]))
        gaps[np.tril_indices(slots)] = np.inf
        nearest = gaps.argmin(axis=1)
        distance = gaps[np.arange(slots), nearest]
        alive = np.arange(slots) < n
        done = []
        for new in range(n, slots):
            i = int(distance.argmin())
            j = int(nearest[i])
            turn = first_round + len(done)
            ids[new] = (turn + 1) * LEAVES + min(ids[i] % LEAVES, ids[j] % LEAVES)
            sizes[new], heights[new] = sizes[i] + sizes[j], max(gaps[i, j], heights[i], heights[j])
            points[new] = (points[i] * sizes[i] + points[j] * sizes[j]) / sizes[new]
            done.append((ids[new], ids[i], ids[j], heights[new], sizes[new], turn))
            alive[[i, j]] = False
            gaps[[i, j]] = gaps[:, [i, j]] = np.inf
            distance[[i, j]] = np.inf
            others = np.flatnonzero(alive)
            found = _ward(sizes[others].astype(np.float64), float(sizes[new]), _squared_gaps(points[others], points[new : new + 1])[:, 0])
            gaps[others, new] = found
            closer = found < distance[others]
            lost = (nearest[others] == i) | (nearest[others] == j)
            nearest[others[closer]], distance[others[closer]] = new, found[closer]
            for row in others[lost]:
                nearest[row] = gaps[row].argmin()
                distance[row] = gaps[row, nearest[row]]
            alive[new] = True
        yield pd.DataFrame(done, columns=["merge", "left", "right", "height", "size", "round"])

    return run


def ward_linkage(features: DataFrame, id_col: str = "id", vector: str = "features", tail_rows: int = TAIL_ROWS) -> DataFrame:
    """Merges (merge, left, right, height, size) over leaves 0..n-1; merges are n..2n-2 by height.

    Equal heights are ordered by round, and a merge is never lower than its parts, so a parent's id
    is always larger than its children's.
    """
    leaves = freeze(
        features.select(F.col(id_col).cast("bigint").alias("leaf"), as_double(F.col(vector)).alias("centroid")), "leaves"
    )
    n, low, high, width = leaves.agg(F.count(F.lit(1)), F.min("leaf"), F.max("leaf"), F.max(F.size("centroid"))).first()
    if n and (low, high) != (0, n - 1):
        raise ValueError("leaf ids must be 0..n-1; number them with dense_index")
    groups = freeze(leaves.groupBy("centroid").agg(F.min("leaf").alias("leaf"), F.count(F.lit(1)).alias("size")), "groups")
    n_clusters = groups.count()
    parts = []
    if n_clusters < n:
        copies = freeze(_copy_merges(leaves, groups), "copy-merges")
        start = _copy_roots(leaves, groups, copies)
        parts.append(copies)
    else:
        start = groups.select(F.col("leaf").alias("cluster"), "size", "centroid")
    searched = freeze(
        start.select(
            "*",
            F.lit(0.0).alias("height"),
            *[F.lit(None).cast(kind).alias(name) for name, kind in _HISTORY],
        ),
        "state",
    )
    tail_rows = min(tail_rows, max(BLOCK_ROWS, TAIL_NUMBERS // max(1, width or 0)))
    spark, turn, gone, pivots, n_pivoted = leaves.sparkSession, 1, None, None, 0
    while n_clusters > max(1, tail_rows):
        if n_clusters > BLOCK_ROWS and (pivots is None or n_clusters < n_pivoted / 2):
            pivots, n_pivoted = _pivots(searched, n_clusters), n_clusters
        path = scratch_path(spark, "state")
        with temporary_tables(spark):  # the blocks of a round are of no use to the next
            following = _round(searched, turn, n_clusters, gone, pivots)
            following.write.parquet(path)
        searched = spark.read.schema(following.schema).parquet(path)
        merged = freeze(
            searched.where(F.col("round") == turn).select(F.col("cluster").alias("merge"), "left", "right", "height", "size", "round"), "merges"
        )
        n_merged = merged.count()
        parts.append(merged)
        if n_merged == 0 and gone is None:
            raise ValueError("no two vectors have a finite distance")
        n_clusters -= n_merged
        # Rounding may leave neighbours found in different rounds without a mutual pair: search all afresh then.
        gone = merged.select(F.explode(F.array("left", "right")).alias("nearest")) if n_merged else None
        turn += 1
    if n_clusters > 1:
        rest = searched.select("cluster", "size", "centroid", "height").coalesce(1)
        parts.append(freeze(rest.mapInPandas(_finish(turn), _MERGES), "tail"))
    if not parts:
        return leaves.sparkSession.createDataFrame([], "merge bigint, left bigint, right bigint, height double, size bigint")
    return _number_merges(reduce(DataFrame.unionByName, parts), n)


def _round(state: DataFrame, turn: int, n_clusters: int, gone: DataFrame | None, pivots: np.ndarray | None) -> DataFrame:
    """State after one round; ``gone`` is what the round before merged, None if all are to search.

    Clusters whose neighbour is gone search again; then all are grouped on the unordered pair
    (cluster, neighbour). Two rows in a group are mutual and become one cluster, a single row stays.
    """
    if gone is None:
        flagged = state.withColumn("asks", F.lit(True))
    else:
        # What has no neighbour stays out of the join: as one key it would be one task.
        without = state.where(F.col("nearest").isNull()).withColumn("asks", F.lit(True))
        joined = state.where(F.col("nearest").isNotNull()).join(gone.withColumn("_gone", F.lit(True)), "nearest", "left")
        flagged = joined.withColumn("asks", F.col("_gone").isNotNull()).drop("_gone").unionByName(without)
    found = nearest_clusters(flagged, F.col("asks"), n_clusters, pivots)
    lost = flagged.where("asks").drop("asks", "nearest", "distance")
    complete = flagged.where(~F.col("asks")).drop("asks").unionByName(lost.join(found, "cluster"))

    side = F.struct("cluster", "size", "centroid", "height", "left", "right", "round", "nearest", "distance")
    met = complete.groupBy(F.least("cluster", "nearest"), F.greatest("cluster", "nearest")).agg(
        F.count(F.lit(1)).alias("n"), F.min(side).alias("a"), F.max(side).alias("b")
    )
    total = F.col("a.size") + F.col("b.size")
    merged = F.struct(
        (F.lit((turn + 1) * LEAVES) + F.least(F.col("a.cluster") % LEAVES, F.col("b.cluster") % LEAVES)).alias("cluster"),
        total.alias("size"),
        F.zip_with(
            "a.centroid", "b.centroid", lambda x, y: (x * F.col("a.size") + y * F.col("b.size")) / total
        ).alias("centroid"),
        F.greatest("a.distance", "a.height", "b.height").alias("height"),
        F.col("a.cluster").alias("left"),
        F.col("b.cluster").alias("right"),
        F.lit(turn).alias("round"),
        F.lit(None).cast("bigint").alias("nearest"),
        F.lit(None).cast("double").alias("distance"),
    )
    return met.select(F.when(F.col("n") == 2, merged).otherwise(F.col("a")).alias("_row")).select("_row.*")


def _number_merges(merges: DataFrame, n: int) -> DataFrame:
    """Provisional ids to n..2n-2 in merge order."""
    numbered = dense_index(merges, [F.col("height"), F.col("round"), F.col("merge")], "_rank").withColumn(
        "_id", F.col("_rank") + n
    )
    numbered = freeze(numbered, "numbered")
    names = lambda side: numbered.select(F.col("merge").alias(side), F.col("_id").alias(f"_{side}"))
    final = lambda side: F.coalesce(F.col(f"_{side}"), F.col(side))
    return (
        numbered.join(names("left"), "left", "left")
        .join(names("right"), "right", "left")
        .select(
            F.col("_id").alias("merge"),
            F.least(final("left"), final("right")).alias("left"),
            F.greatest(final("left"), final("right")).alias("right"),
            "height",
            "size",
        )
    )
