"""Exact nearest neighbours in Euclidean space, without comparing every block with every other.

A hash sample of the points (at most MAX_PIVOTS) are pivots; every point belongs to the cell of its
nearest pivot. A query first visits its nearest cells until they hold k points, which bounds the distance of
its k-th neighbour; then only cells that can still hold a nearer point are visited: the triangle
inequality bounds the distance to a cell by its radii and by the plane between two pivots. Best lists are
merged between rounds, so a later round visits less. Cells beside each other share a block, large ones are split
into several, and busy blocks serve their queries in parts, so no task holds more than a block of points and a part of
queries. A block is met by one product of matrices; what comes near the k-th distance is measured from the differences.

Of points with the same vector only the first k (by key) can be neighbours; the others leave before
the join, so a vector in a third of all rows costs nothing. The work follows the intrinsic dimension of the
points: where no cell can be excluded (high-dimensional noise) every cell is visited, as in a block join. Visits are
counted before they are shuffled: beyond SHIPPED a query, blocks of queries stay where they are and read the blocks of
points one after the other, so the disk that a search takes grows with the rows, not with the visits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.hashing import unit_hash
from tabloom.functions.tiles import packed, streamed
from tabloom.session import cut, remove, scratch_dir, stored

CELL_ROWS = 1024
BLOCK_ROWS = 8192
MAX_PIVOTS = 2048
#: Cells visited in the rounds after the first; the last round visits all that are left.
ROUNDS = (4, None)
#: Doubles of one array of distances, and columns of one product.
CHUNK, WIDTH = 500_000, 2048
#: Queries planned at once.
PLAN_ROWS = 1024
#: Visits a query (their mean in a round) up to which they are shuffled, and queries of a block that stays in its task.
SHIPPED, QUERY_ROWS = 4, 4096
#: Lower bounds give way by this much, so that rounding never excludes a neighbour.
SLACK = 1e-9
#: Squares of distances below this share of the squared lengths are measured from the differences.
NEAR = 1e-4


def stacked(series: pd.Series) -> np.ndarray:
    return np.asarray(series.tolist(), dtype=float).reshape(len(series), -1)


def direct(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances between the i-th rows of two arrays, from their differences."""
    gap = x - y
    return np.sqrt(np.einsum("ij,ij->i", gap, gap))


def hits(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the true cells, which are few."""
    return np.divmod(np.flatnonzero(mask), mask.shape[1])


class Rough:
    """Squared distances to a block of points in single precision, and how far they can be off."""

    def __init__(self, points: np.ndarray):
        self.middle = points.mean(axis=0)
        b = points - self.middle
        bb = np.einsum("ij,ij->i", b, b)
        self.right = np.column_stack([b, np.ones(len(b)), bb]).T.astype(np.float32)
        self.most, self.unit = float(bb.max()), 4 * (points.shape[1] + 8) * float(np.finfo(np.float32).eps)

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = x - self.middle
        aa = np.einsum("ij,ij->i", a, a)
        left = np.column_stack([-2.0 * a, aa, np.ones(len(a))]).astype(np.float32)
        return left @ self.right, self.unit * (aa + self.most)


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances between the rows of two blocks. They come from one product of matrices; pairs
    so near that it would lose digits are measured again from their differences."""
    out = np.empty((len(x), len(y)))
    if not out.size:
        return out
    middle = y.mean(axis=0)
    a, b = x - middle, y - middle
    aa, bb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    left = np.column_stack([-2.0 * a, aa, np.ones(len(a))])
    right = np.column_stack([b, np.ones(len(b)), bb]).T
    step = max(1, CHUNK // min(len(y), WIDTH))
    for at in range(0, len(x), step):
        for to in range(0, len(y), WIDTH):
            part = left[at : at + step] @ right[:, to : to + WIDTH]
            bound = NEAR * (aa[at : at + step] + bb[to : to + WIDTH].max())
            i, j = hits(part < bound[:, None])
            for some in range(0, len(i), step):
                pick = slice(some, some + step)
                part[i[pick], j[pick]] = direct(x[at + i[pick]], y[to + j[pick]]) ** 2
            out[at : at + step, to : to + WIDTH] = part
    return out


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances between the rows of two blocks, to about eleven digits."""
    out = squares(x, y)
    return np.sqrt(out, out=out)


def nearest_row(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every row of x the nearest row of y, the first of equally near ones, and its distance."""
    pick, best = np.zeros(len(x), np.int64), np.zeros(len(x))
    step = max(1, CHUNK // max(1, len(y)))
    for at in range(0, len(x), step):
        part = x[at : at + step]
        d = distances(part, y)
        i, j = hits(d <= d.min(axis=1)[:, None] * (1 + SLACK))
        exact = direct(part[i], y[j])
        order = np.lexsort((j, exact, i))
        first = order[np.unique(i, return_index=True)[1]]
        pick[at : at + step], best[at : at + step] = j[first], exact[first]
    return pick, best


def _first_copies(points: DataFrame, most: int) -> DataFrame:
    """At most `most` points, those with the smallest ids, of each group and vector."""
    w = Window.partitionBy("g", "v").orderBy("id")
    return points.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= most).drop("__n")


def _walk(vectors: np.ndarray) -> np.ndarray:
    """An order of the rows that goes from each to the nearest one left."""
    d = distances(vectors, vectors)
    at, out = 0, [0]
    for _ in range(len(vectors) - 1):
        d[:, at] = np.inf
        at = int(d[at].argmin())
        out.append(at)
    return np.array(out)


class _Cells:
    """Pivots by group, with the size and radii of their cells."""

    def __init__(self, pivots: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.pivots = pivots  # group: (cell numbers, vectors)
        self.count = np.zeros(sum(len(c) for c, _ in pivots.values()), np.int64)
        self.near, self.far = np.zeros(len(self.count)), np.zeros(len(self.count))
        self.first, self.parts = self.count.copy(), self.count + 1

    def measure(self, stats: list) -> None:
        """Sizes and radii; small cells that lie beside each other share a block, large ones have several."""
        for r in stats:
            self.count[r["cell"]], self.near[r["cell"]], self.far[r["cell"]] = r["n"], r["near"], r["far"]
        self.parts = np.maximum(1, -(-self.count // BLOCK_ROWS))
        block = -1
        for cells, vectors in self.pivots.values():
            room = 0
            for c in cells[_walk(vectors)]:
                if self.parts[c] > 1 or self.count[c] > room:
                    self.first[c], room = block + 1, BLOCK_ROWS
                    block += int(self.parts[c])
                else:
                    self.first[c] = block
                room = 0 if self.parts[c] > 1 else room - self.count[c]
        self.blocks = block + 1

    def bounds(self, g: int, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell numbers, distances to their pivots, and lower bounds of the distances to their points."""
        cells, vectors = self.pivots[g]
        d = distances(v, vectors)
        low = np.maximum(np.maximum(d - self.far[cells], self.near[cells] - d), 0.0)
        own = d.argmin(axis=1)
        apart = distances(vectors, vectors)[own]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (d**2 - d[np.arange(len(d)), own][:, None] ** 2) / (2 * apart)
        low = np.maximum(low, np.where(apart > 0, plane, 0.0))
        low = np.where(self.count[cells] > 0, low, np.inf)
        return cells, d, low

    def visits(self, g: int, v: np.ndarray, limit: np.ndarray, visited: pa.ListArray, some: int | None, k: int | None):
        """(row, block) of the cells to visit: with `k` the nearest cells up to more than k points, else the `some`
        best (all) cells that can hold a point within the limit and whose blocks were not visited."""
        cells, d, low = self.bounds(g, v)
        kept, first = self.count[cells] > 0, self.first[cells]
        gone = np.zeros((len(v), self.blocks), bool)
        gone[np.repeat(np.arange(len(v)), visited.value_lengths().to_numpy()), visited.flatten().to_numpy()] = True
        if k is not None:
            order = np.argsort(d, axis=1, kind="stable")
            points = self.count[cells][order]
            take = np.zeros(d.shape, bool)
            np.put_along_axis(take, order, np.cumsum(points, axis=1) - points <= k, axis=1)
            take &= kept
        else:
            take = kept & ~gone[:, first] & (low * (1 - SLACK) - SLACK <= limit[:, None])
            if some is not None and some < len(cells):
                order = np.lexsort((d, np.where(take, low, np.inf)), axis=1)
                best = np.zeros(d.shape, bool)
                np.put_along_axis(best, order[:, :some], True, axis=1)
                take &= best
        row, c = np.nonzero(take)
        parts = self.parts[cells[c]]
        block = np.repeat(first[c], parts) + np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        pairs = np.unique(np.repeat(row, parts) * np.int64(self.blocks) + block)
        return pairs // self.blocks, (pairs % self.blocks).astype("int32")


def _pivots(points: DataFrame, sizes: dict[int, int]) -> _Cells:
    """A hash sample of each group, about one pivot for CELL_ROWS points."""
    wanted = {g: math.ceil(n / CELL_ROWS) for g, n in sizes.items()}
    total = sum(wanted.values())
    if total > MAX_PIVOTS:
        wanted = {g: max(1, n * MAX_PIVOTS // total) for g, n in wanted.items()}
    w = Window.partitionBy("g").orderBy(unit_hash("id", seed="pivots"), "id")
    top = points.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= max(wanted.values()))
    found: dict[int, list] = {}
    for r in top.select("g", "v", "__n").collect():
        if r["__n"] <= wanted[r["g"]]:
            found.setdefault(r["g"], []).append((r["__n"], r["v"]))
    cells, at = {}, 0
    for g in sorted(found):
        vectors = [v for _, v in sorted(found[g], key=lambda p: p[0])]
        cells[g] = (np.arange(at, at + len(vectors)), np.asarray(vectors, float).reshape(len(vectors), -1))
        at += len(vectors)
    return _Cells(cells)


def nearest(
    queries: DataFrame, points: DataFrame, key: str, vector: str, k: int, *, skip_self: bool, by: str | None = None,
) -> DataFrame:
    """Exact k nearest points of every query: (key, neighbour, distance, place 1..k). `by` names an int
    column of both sides; only points of the same group are neighbours, and it is returned too. Vectors
    of one group have one length and no gaps. Ties go to the smaller key."""
    kind = queries.schema[key].dataType.simpleString()
    group = F.col(by) if by else F.lit(0)
    q = queries.select(group.cast("int").alias("g"), F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").alias("v"))
    p = points.select(group.cast("int").alias("g"), F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").alias("v"))
    held = scratch_dir(q.sparkSession, "points")
    p = stored(_first_copies(p, k + 1 if skip_self else k), held)
    sizes = {r["g"]: r["count"] for r in p.groupBy("g").count().collect()}
    columns = [F.col("id").alias(key), *([F.col("g").alias(by)] if by else [])]
    empty = f"id {kind}, g int, best array<struct<distance: double, neighbour: {kind}>>"
    if not sizes:
        state = q.sparkSession.createDataFrame([], empty)
    else:
        state = _search(q.filter(F.col("g").isin(*sizes)), p, _pivots(p, sizes), k, skip_self, kind, held)
    return state.select(*columns, F.posexplode("best").alias("at", "near")).select(
        key, *([by] if by else []), F.col("near.neighbour").alias("neighbour"),
        F.col("near.distance").alias("distance"), (F.col("at") + 1).alias("place"))


def _search(q: DataFrame, p: DataFrame, cells: _Cells, k: int, skip_self: bool, kind: str, held: str) -> DataFrame:
    """`held` is the folder of `p`. Folders of what a later step has taken over are deleted."""
    context = q.sparkSession.sparkContext
    pivots = context.broadcast(cells.pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, part in _by_group(batch):
                numbers, vectors = pivots.value[g]
                own, r = nearest_row(_rows(part["v"]), vectors)
                yield pa.RecordBatch.from_arrays(
                    [part["g"], part["id"], part["v"], pa.array(numbers[own].astype("int32")), pa.array(r)],
                    ["g", "id", "v", "cell", "r"])

    placed = cut(p.mapInArrow(place, f"g int, id {kind}, v array<double>, cell int, r double"))
    remove(q.sparkSession, held)
    cells.measure(placed.groupBy("cell").agg(
        F.count("*").alias("n"), F.min("r").alias("near"), F.max("r").alias("far")).collect())
    shared = context.broadcast(cells)
    blocks = q.sparkSession.createDataFrame(
        [(c, int(f), int(n)) for c, (f, n) in enumerate(zip(cells.first, cells.parts))], "cell int, first int, parts int")
    stock = placed.join(F.broadcast(blocks), "cell").select(
        (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("block"), "id", "v")

    def plan(some: int | None, first: bool, only_count: bool = False):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for g, group in _by_group(batch):
                    for at in range(0, len(group), PLAN_ROWS):
                        part = group.slice(at, PLAN_ROWS)
                        row, block = shared.value.visits(
                            g, _rows(part["v"]), part["limit"].to_numpy(), part["visited"], some, k if first else None)
                        if only_count:
                            yield pa.RecordBatch.from_arrays([pa.array([len(row)]), pa.array([len(part)])], ["visits", "rows"])
                            continue
                        row = pa.array(row)
                        yield pa.RecordBatch.from_arrays(
                            [part["id"].take(row), part["g"].take(row), pa.array(block)], ["id", "g", "block"])
        return run

    near = f"array<struct<distance: double, neighbour: {kind}>>"

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        ids, others = _whole(x["id"]), _whole(y["id"])
        row, j, d = _within(ids, _rows(_whole(x["v"])), x["limit"].to_numpy(), others, _rows(_whole(y["v"])), k, skip_self)
        return _told(ids, _whole(x["g"]), row, d, others.take(pa.array(j)))

    def start(x: pa.Table):
        ids, vectors, g, listed = _whole(x["id"]), _rows(_whole(x["v"])), x["g"][0].as_py(), _whole(x["best"])
        told = listed.flatten()
        best = _Best(np.repeat(np.arange(len(x)), listed.value_lengths().to_numpy()),
                     told.field("distance").to_numpy(), told.field("neighbour"), len(x), k)
        todo, visited = np.zeros((len(x), shared.value.blocks), bool), _whole(x["visited"])
        for at in range(0, len(x), PLAN_ROWS):
            row, block = shared.value.visits(
                g, vectors[at : at + PLAN_ROWS], best.limit[at : at + PLAN_ROWS], visited.slice(at, PLAN_ROWS), None, None)
            todo[at + row, block] = True

        def visit(block: int, opened) -> None:
            rows = np.flatnonzero(todo[:, block])
            if len(rows):
                y = opened()
                others = _whole(y["id"])
                row, j, d = _within(ids.take(pa.array(rows)), vectors[rows], best.limit[rows], others, _rows(_whole(y["v"])), k, skip_self)
                best.add(rows[row], d, others.take(pa.array(j)))

        return visit, lambda: _told(ids, _whole(x["g"]), *best.ordered())

    def stay(asked: DataFrame) -> DataFrame:
        """All that is left to visit, without a shuffle of visits."""
        asked = asked.filter(F.col("id").isNotNull())  # a missing key meets no other in the joins below
        count = {r["g"]: r["count"] for r in asked.groupBy("g").count().collect()}
        shares = {g: -(-n // QUERY_ROWS) for g, n in sorted(count.items())}
        first = np.cumsum([0, *shares.values()]).tolist()
        known = q.sparkSession.createDataFrame(list(zip(shares, first, shares.values())), "g int, first int, shares int")
        part = F.col("first") + F.pmod(F.xxhash64("id", "v"), F.col("shares"))
        blocks_of = packed(asked.join(F.broadcast(known), "g").select("id", "g", "v", "best", "visited", part.alias("part")), F.col("part"), first[-1])
        points = cut(packed(stock.select("id", "v", "block"), F.col("block"), cells.blocks))
        return streamed(blocks_of, points, start, f"id {kind}, g int, best {near}")

    state = q.select(
        "id", "g", "v", F.expr(f"CAST(array() AS {near})").alias("best"), F.expr("CAST(array() AS array<int>)").alias("visited"))
    single, held = cells.blocks == len(cells.pivots), None

    def kept(state: DataFrame) -> DataFrame:
        nonlocal held
        path, old = scratch_dir(q.sparkSession, "state"), held
        state, held = stored(state, path), path
        if old:
            remove(q.sparkSession, old)
        return state

    for n, some in enumerate((None, *ROUNDS)):
        if n and single:
            break
        limit = F.when(F.size("best") >= k, F.get("best", F.lit(k - 1))["distance"]).otherwise(F.lit(math.inf))
        asked = state.select("id", "g", "v", "visited", limit.alias("limit"))
        if cells.blocks > SHIPPED:
            met = asked.mapInArrow(plan(some, n == 0, only_count=True), "visits long, rows long").agg(
                F.sum("visits").alias("visits"), F.sum("rows").alias("rows")).first()
            if (met["visits"] or 0) > SHIPPED * (met["rows"] or 0):
                state = kept(stay(state))
                break
        visits = cut(asked.mapInArrow(plan(some, n == 0), f"id {kind}, g int, block int"))
        load = visits.groupBy("block").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("shares"))
        load = F.broadcast(load) if cells.blocks <= 100_000 else load
        going = visits.join(load, "block").join(asked.drop("visited"), ["id", "g"])
        going = going.withColumn("share", F.pmod(F.xxhash64("id"), F.col("shares")).cast("int")).select(
            "block", "share", "id", "g", "v", "limit")
        served = stock.join(load, "block").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
        found = going.groupBy("block", "share").cogroup(
            served.select("block", "share", "id", "v").groupBy("block", "share")).applyInArrow(
            meet, f"id {kind}, g int, best {near}")
        seen = visits.groupBy("id", "g").agg(F.collect_set("block").alias("more"))
        merged = found.groupBy("id", "g").agg(F.flatten(F.collect_list("best")).alias("new"))
        state = kept(state.join(merged, ["id", "g"], "left").join(seen, ["id", "g"], "left").select(
            "id", "g", "v",
            F.slice(F.array_sort(F.concat("best", F.coalesce("new", F.array()))), 1, k).alias("best"),
            F.concat("visited", F.coalesce("more", F.array())).alias("visited")))
    return state.select("id", "g", "best")


def _within(
    ids: pa.Array, queries: np.ndarray, limit: np.ndarray, others: pa.Array, points: np.ndarray, k: int, skip_self: bool,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, distance) of the best k points of a block that are within the limit of each query, by query and
    then best first."""
    names, values = (c.to_numpy(zero_copy_only=False) for c in (ids, others))
    order = np.argsort(values, kind="stable")
    rank_of = np.argsort(order, kind="stable")
    same = [np.searchsorted(values, names, side, sorter=order) for side in ("left", "right")]
    rows, found, far = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    rough = Rough(points) if len(points) else None
    step = max(1, CHUNK // max(1, len(points)))
    for at in range(0, len(queries) if len(points) else 0, step):
        part, most = queries[at : at + step], limit[at : at + step] * (1 + SLACK) + SLACK
        d, off = rough(part)
        if skip_self:
            start, stop = (s[at : at + step] for s in same)
            own = np.repeat(np.arange(len(part)), stop - start)
            inner = np.arange(len(own)) - np.repeat(np.cumsum(stop - start) - (stop - start), stop - start)
            d[own, order[np.repeat(start, stop - start) + inner]] = np.nan
        bound = most**2 + off
        if len(points) > k:
            open_ = np.flatnonzero(np.count_nonzero(d <= bound[:, None], axis=1) > 4 * k)
            # NaN, the row itself, comes last in a partition
            top = np.partition(d[open_], k - 1, axis=1)[:, k - 1]
            bound[open_] = np.fmin(bound[open_], top + 2 * off[open_])
        i, j = hits(d <= bound[:, None])
        exact = np.concatenate([np.zeros(0), *[
            direct(part[i[s : s + CHUNK // 50]], points[j[s : s + CHUNK // 50]]) for s in range(0, len(i), CHUNK // 50)]])
        best = np.lexsort((rank_of[j], exact, i))
        i, j, exact = i[best], j[best], exact[best]
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        keep = nth < k
        rows.append(at + i[keep])
        found.append(j[keep])
        far.append(exact[keep])
    return np.concatenate(rows), np.concatenate(found), np.concatenate(far)


def _told(ids: pa.Array, groups: pa.Array, row: np.ndarray, d: np.ndarray, others: pa.Array) -> pa.Table:
    """The lists of (distance, neighbour), given by row."""
    ends = np.searchsorted(row, np.arange(len(ids) + 1)).astype("int32")
    near = pa.StructArray.from_arrays([pa.array(d), others], ["distance", "neighbour"])
    return pa.table({"id": ids, "g": groups, "best": pa.ListArray.from_arrays(pa.array(ends), near)})


class _Best:
    """The k best (distance, neighbour) of each row of a block of queries, and the distance that a better one has at most."""

    def __init__(self, row: np.ndarray, d: np.ndarray, others: pa.Array, rows: int, k: int):
        self.k, self.limit = k, np.full(rows, np.inf)
        self.row, self.d, self.others = row[:0], d[:0], others[:0]
        self.add(row, d, others)

    def add(self, row: np.ndarray, d: np.ndarray, others: pa.Array) -> None:
        touched = np.zeros(len(self.limit), bool)
        touched[row] = True
        old = touched[self.row]
        pick, rest = pa.array(np.flatnonzero(old)), pa.array(np.flatnonzero(~old))
        row, d, others = _best_first(
            np.concatenate([self.row[old], row]), np.concatenate([self.d[old], d]), pa.concat_arrays([self.others.take(pick), others]))
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        last, keep = nth == self.k - 1, nth < self.k
        self.limit[row[last]] = d[last]
        self.row, self.d = np.concatenate([self.row[~old], row[keep]]), np.concatenate([self.d[~old], d[keep]])
        self.others = pa.concat_arrays([self.others.take(rest), others.filter(pa.array(keep))])

    def ordered(self) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        return _best_first(self.row, self.d, self.others)


def _best_first(row: np.ndarray, d: np.ndarray, others: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    order = pc.sort_indices(
        pa.table({"row": row, "d": d, "id": others}), null_placement="at_start",
        sort_keys=[(c, "ascending") for c in ("row", "d", "id")])
    return row[order.to_numpy()], d[order.to_numpy()], others.take(order)


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _rows(lists: pa.ListArray) -> np.ndarray:
    """Vectors of one length as the rows of an array."""
    values = lists.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(lists), len(values) // max(1, len(lists)))


def _by_group(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    g = batch["g"].to_numpy()
    for value in np.unique(g):
        yield int(value), batch.take(pa.array(np.flatnonzero(g == value)))
