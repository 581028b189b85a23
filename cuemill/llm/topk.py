"""Exact top-k inner products: pivot-table bounds, evaluated in bound order until none can win."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuemill.llm.common import bounded_batches, written

#: Candidates under one bound, and queries that meet them at once.
BLOCK, CHUNK = 512, 512
#: Numbers in a row that is shipped, so that 1024 rows are a small Arrow batch, and vectors in it at most.
PIECE, PIECE_ROWS = 1 << 13, 1 << 12
#: Numbers of candidates that a task holds at once, and bytes that the queries of a task may take.
HELD, QUERY_BYTES = 1 << 21, 48 << 20
#: Candidates of the first round, and growth of the rounds at most.
FIRST, GROWTH = 1 << 16, 16
#: Products of a task: fewer are not worth another task, more are too long for one.
LEAST_WORK, MOST_WORK = 1 << 32, 1 << 40
#: Below every score of 64 bits, and below those of two vectors of 64 bits.
LOWEST, LOWEST_WIDE = -(1 << 63) + 1, -(1 << 200)
NO_ID = (1 << 63) - 1
PACKED = "dim int, ids binary, vectors binary"
FLOORS = {"floor_at": "array<int>", "floors": "array<long>", "floor_ids": "array<long>"}


def choose_pivots(vectors: DataFrame, n_pivots: int) -> dict[int, np.ndarray]:
    """Per dimension ``n_pivots`` far-apart vectors of a hash-ordered pool of 32 times as many rows."""
    pool = (vectors.select("v", F.size("v").alias("dim")).orderBy(F.xxhash64("v"), "v")
            .limit(32 * n_pivots).collect())
    pivots = {}
    for dim in sorted({r.dim for r in pool}):
        rows = [r.v for r in pool if r.dim == dim]
        rows = np.array(rows, dtype=np.float64).reshape(len(rows), dim)
        chosen, far = [0], np.linalg.norm(rows - rows[0], axis=1)
        while len(chosen) < min(n_pivots, len(rows)):
            chosen.append(int(far.argmax()))
            far = np.minimum(far, np.linalg.norm(rows - rows[chosen[-1]], axis=1))
        pivots[dim] = rows[chosen]
    return pivots


def pivot_table(vectors: np.ndarray, pivots: np.ndarray | None) -> np.ndarray:
    """Distances of every vector to every pivot."""
    if pivots is None:  # a dimension that the pool has missed: one pivot at the origin
        pivots = np.zeros((1, vectors.shape[1]))
    return np.stack([lengths(vectors - p) for p in pivots], axis=1)


def lengths(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", vectors, vectors))


def _narrow(v: np.ndarray) -> np.ndarray:
    """``v`` in the shortest type that holds it."""
    least, most = v.min(initial=0), v.max(initial=0)
    return v.astype(next(t for t in (np.int16, np.int32, np.int64)
                         if np.iinfo(t).min <= least and most <= np.iinfo(t).max))


def _packer(numbers: int, most: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}

        def piece(dim: int, rows: list) -> pd.DataFrame:
            v = np.array([r[1] for r in rows], dtype=np.int64).reshape(len(rows), dim)
            ids = np.array([r[0] for r in rows], dtype=np.int64)
            return pd.DataFrame({"dim": [dim], "ids": [ids.tobytes()], "vectors": [_narrow(v).tobytes()]})

        for batch in batches:
            full = []
            for i, v in zip(batch["id"], batch["v"]):
                rows = held.setdefault(len(v), [])
                rows.append((i, v))
                if len(rows) >= most or len(rows) * len(v) >= numbers:
                    full.append(piece(len(v), held.pop(len(v))))
            if full:
                yield pd.concat(full)
        for dim, rows in held.items():
            yield piece(dim, rows)

    return pack


def _unpack(ids: bytes, vectors: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    width = len(vectors) // (len(i) * dim) if len(i) * dim else 2
    return i, np.frombuffer(vectors, f"<i{width}").reshape(len(i), dim)


class Search:
    """Queries of one dimension, and their best candidates among those of one cell.

    A query's best list begins as ``k`` copies of its floor, the k-th best of earlier rounds, or of
    a score below all; what is not better than the floor is never returned.
    """

    def __init__(self, dim: int, k: int, pivots: np.ndarray | None, block: int, chunk: int):
        self.dim, self.k, self.pivots, self.block, self.chunk = dim, k, pivots, block, chunk
        self.asked: list[tuple] = []
        self.held: list[tuple] = []
        self.n_held, self.n = 0, None
        self.room = {kind: np.empty(block * chunk, kind) for kind in (np.float32, np.float64)}

    def ask(self, piece: int, ids: np.ndarray, v: np.ndarray, at, floors, floor_ids) -> None:
        floor, floor_id = np.full(len(ids), LOWEST), np.full(len(ids), NO_ID)
        if at is not None and len(at):
            floor[at], floor_id[at] = floors, floor_ids
        wide = v.astype(np.float64)
        self.asked.append((piece * PIECE_ROWS + np.arange(len(ids)), ids, v, floor, floor_id,
                           lengths(wide), pivot_table(wide, self.pivots)))

    def offer(self, ids: np.ndarray, v: np.ndarray) -> None:
        if not self.asked and self.n is None:
            return  # no query of this dimension here
        self.held.append((ids, v))
        self.n_held += len(ids)
        if self.n_held * max(1, self.dim) >= HELD:
            self.search()

    def _ready(self) -> None:
        """The queries as arrays, those near the same pivot together."""
        columns, self.asked = [list(x) for x in zip(*self.asked)], []
        table = np.concatenate(columns.pop())
        order = np.lexsort((table.min(axis=1), table.argmin(axis=1)))
        self.n, self.table = len(order), table[order]
        del table
        self.norm, self.floor_id, self.floor, self.v, self.ids, self.row = (
            np.concatenate(columns.pop())[order] for _ in range(6))
        self.score = np.repeat(self.floor[:, None], self.k, axis=1)
        self.best = np.repeat(self.floor_id[:, None], self.k, axis=1)
        self.low = self.score[:, -1].astype(np.float64)

    def search(self) -> None:
        """All queries against the candidates held, which are let go of."""
        if self.n is None:
            self._ready()
        if not self.held:
            return
        ids, v = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.n_held = [], 0
        wide = v.astype(np.float64)
        norm, table = lengths(wide), pivot_table(wide, self.pivots)
        del wide
        order = np.lexsort((table.min(axis=1), table.argmin(axis=1)))
        ids, v, norm, table = ids[order], v[order], norm[order], table[order]
        starts = np.arange(0, len(ids), self.block)
        least, most = np.minimum.reduceat(table, starts), np.maximum.reduceat(table, starts)
        longest, cast = np.maximum.reduceat(norm, starts), {}
        for a in range(0, self.n, self.chunk):
            tile = np.arange(a, min(a + self.chunk, self.n))
            bound = self._bounds(tile, least, most, longest)
            top, own = bound.max(axis=0), {}
            for b in np.argsort(-top, kind="stable"):
                low = self.low[tile]
                if top[b] < low.min():
                    break  # bounds only fall from here: nothing left can win or tie
                some = bound[:, b] >= low
                if some.any():
                    at = slice(starts[b], starts[b] + self.block)
                    self._meet(tile, some, ids[at], v[at], longest[b], (b, cast), own)

    def _bounds(self, tile: np.ndarray, least: np.ndarray, most: np.ndarray, longest: np.ndarray) -> np.ndarray:
        """For each query and block a number that none of its scores exceeds."""
        # The triangle inequality: |q - c| is at least the largest difference of pivot distances.
        low = np.zeros((len(tile), len(least)))
        for p in range(least.shape[1]):
            t = self.table[tile, p, None]
            np.maximum(low, t * (1 - 1e-12) - most[None, :, p] * (1 + 1e-12), out=low)
            np.maximum(low, least[None, :, p] * (1 - 1e-12) - t * (1 + 1e-12), out=low)
        norm = self.norm[tile, None]
        squares = norm ** 2 + longest ** 2
        bound = np.minimum((squares - low * low) / 2, norm * longest)
        return bound + 1 + 1e-9 * squares  # for rounding

    def _meet(self, tile: np.ndarray, some: np.ndarray, ids: np.ndarray, v: np.ndarray, longest: float,
              block: tuple, own: dict) -> None:
        """Scores of some queries of a tile with a block, and the better ones into their lists."""
        # No sum of products, in whatever order, exceeds the product of the lengths.
        reach = float(self.norm[tile[some]].max() * longest) * (1 + 1e-9)
        kind = np.float32 if reach < 2 ** 24 else np.float64
        err = 0.0 if reach < 2 ** 53 else reach * (self.dim + 4) * 2.0 ** -52
        b, cast = block
        if (b, kind) not in cast:
            cast[b, kind] = v.astype(kind).T
        if kind not in own:
            own[kind] = self.v[tile].astype(kind)
        query = own[kind]
        if some.sum() * 4 < len(tile) * 3:
            tile, query = tile[some], query[some]
        room = self.room[kind][:len(query) * len(ids)].reshape(len(query), len(ids))
        found = np.matmul(query, cast[b, kind], out=room)
        with np.errstate(over="ignore"):
            low = (self.low[tile] - 2 * err).astype(kind)
        fresh = np.flatnonzero(self.low[tile] <= LOWEST)  # fewer than k so far
        if len(fresh) and len(ids) > self.k:
            part = found[fresh]
            for i in np.flatnonzero(np.isin(self.ids[tile[fresh]], ids)):
                part[i, ids == self.ids[tile[fresh[i]]]] = -np.inf
            low[fresh] = np.partition(part, len(ids) - self.k, axis=1)[:, len(ids) - self.k] - 2 * err
        reached = np.flatnonzero(found.max(axis=1) >= low)
        if not len(reached):
            return
        near, low = found[reached], low[reached, None]
        won = near >= low
        if not err and np.count_nonzero(won) > 8 * len(reached):  # ties: only smaller ids win
            won &= (near > low) | (ids <= self.best[tile[reached], -1, None])
        i, j = np.divmod(np.flatnonzero(won), len(ids))
        i = reached[i]
        other = self.ids[tile[i]] != ids[j]
        i, j = i[other], j[other]
        if reach >= 2 ** 62 and self.score.dtype != object:  # Python's integers, which do not wrap
            self.score, self.floor = (np.where(x == LOWEST, LOWEST_WIDE, x.astype(object))
                                      for x in (self.score, self.floor))
        if not err:
            score = found[i, j].astype(np.int64)
        else:
            exact = np.int64 if reach < 2 ** 62 else object
            score = np.concatenate([np.zeros(0, exact)] + [
                (self.v[tile[i[s:s + 4096]]].astype(exact) * v[j[s:s + 4096]].astype(exact)).sum(axis=1)
                for s in range(0, len(i), 4096)])
        self._keep(tile[i], ids[j], score)

    def _keep(self, at: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        last, last_id = self.score[at, -1], self.best[at, -1]
        better = ((score > last) | ((score == last) & (ids < last_id))).astype(bool)
        at, ids, score = at[better], ids[better], score[better]
        if not len(at):
            return
        own = np.unique(at)
        at = np.concatenate([at, np.repeat(own, self.k)])
        ids = np.concatenate([ids, self.best[own].ravel()])
        score = np.concatenate([score.astype(self.score.dtype), self.score[own].ravel()])
        if score.dtype == object:
            order = np.array(sorted(range(len(at)), key=lambda x: (at[x], -score[x], ids[x])))
        else:
            order = np.lexsort((ids, -score, at))
        first = np.flatnonzero(np.append(True, np.diff(at[order]) != 0))
        take = order[first[:, None] + np.arange(self.k)]
        self.score[own], self.best[own] = score[take], ids[take]
        self.low[own] = self.score[own, -1].astype(np.float64)

    def found(self) -> Iterator[pd.DataFrame]:
        if not self.asked and self.n is None:
            return
        self.search()
        for a in range(0, self.n, 1 << 14):
            at = slice(a, a + (1 << 14))
            score, best = self.score[at], self.best[at]
            floor, floor_id = self.floor[at, None], self.floor_id[at, None]
            new = ((score > floor) | ((score == floor) & (best < floor_id))).astype(bool)
            i, j = np.nonzero(new)
            if len(i):
                yield pd.DataFrame({"row": self.row[at][i], "query_id": self.ids[at][i], "vec_id": best[i, j],
                                    "score": np.array(score[i, j].tolist(), dtype=np.int64)})


def _searcher(k: int, pivots: dict[int, np.ndarray], block: int, chunk: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, search = None, None
        for batch in batches:
            for r in batch.itertuples(index=False):
                if (r.of, r.cell, r.dim) != cell:
                    if search:
                        yield from search.found()
                    cell, search = (r.of, r.cell, r.dim), Search(r.dim, k, pivots.get(r.dim), block, chunk)
                ids, v = _unpack(r.ids, r.vectors, r.dim)
                if r.asks == 0:
                    search.ask(int(r.piece), ids, v, r.floor_at, r.floors, r.floor_ids)
                else:
                    search.offer(ids, v)
        if search:
            yield from search.found()

    return run


def slices(n: int) -> list[float]:
    """Shares of the candidates that are searched after each round."""
    steps = math.ceil(math.log(max(1.0, n / FIRST)) / math.log(GROWTH))
    return [(FIRST / n) ** (1 - s / steps) for s in range(steps)] + [1.0]


def grid(n_queries: int, n_candidates: int, dim: float, query_bytes: int, parallel: int) -> tuple[int, int]:
    """Groups of queries and of candidates; every pair of groups is a cell."""
    work = int(n_queries * n_candidates * dim)
    cells = max(1, min(8 * parallel, work // LEAST_WORK), work // MOST_WORK)
    # Each group of queries takes all candidates once, and the reverse: least is moved at this ratio.
    of = round(math.sqrt(cells * n_queries / max(1, n_candidates)))
    of = max(1, min(of, cells), -(-query_bytes // QUERY_BYTES))
    return of, -(-cells // of)


def partition_keys(spark: SparkSession, n: int) -> list[int]:
    """For each of ``n`` partitions a number that hashing deals to it."""
    first: dict[int, int] = {}
    for i, r in enumerate(spark.range(0, 32 * n, 1, 1).select(F.pmod(F.hash("id"), F.lit(n))).collect()):
        first.setdefault(r[0], i)
    return [first.get(x, x) for x in range(n)]


def exact_topk(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id",
               vec_col: str = "embedding", k: int = 5, scale: float = 256.0,
               n_pivots: int = 16) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` highest integer inner products.

    Components are floor(scale * x). Vectors that are null or hold a null or non-finite component
    take no part; only vectors of a query's dimension are its candidates, and never rows with the
    query's id. Ties go to the smaller id; a repeated candidate row counts again; equal query rows
    are one query. Queries without a candidate give no row.

    Every candidate meets every query once, in one of several rounds over growing parts of the
    candidates, cut by hash; the k-th score of a round is the floor of the next, so that little but
    the result is shipped. A round deals groups of queries and groups of candidates out to cells.
    In a cell, blocks of candidates near the same pivot come in the order of their bounds, until no
    bound reaches a query's k-th score; a block is scored by one matrix product, in single precision
    where all its sums are exact there.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    valid = F.forall(F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull() & valid).select(
        F.col(id_col).cast("long").alias("id"), is_query.alias("q"),
        F.transform(vec_col, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("v"))
    rows = written(rows, "vectors")
    pivots = choose_pivots(rows, n_pivots)
    pack = _packer(PIECE, PIECE_ROWS)
    chunks = rows.where("q").select("id", "v").distinct().mapInPandas(pack, PACKED)
    chunks = written(chunks.withColumn("piece", F.monotonically_increasing_id()), "chunks")
    size = chunks.agg(F.coalesce(F.sum(F.length("ids")), F.lit(0)).alias("ids"),
                      F.coalesce(F.sum(F.length("vectors")), F.lit(0)).alias("vectors")).first()
    n_queries, n = size.ids // 8, rows.count()
    dim = sum(d * len(p) for d, p in pivots.items()) / max(1, sum(len(p) for p in pivots.values()))
    query_bytes = size.vectors + n_queries * (16 * k + 8 * n_pivots + 64)
    place = F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30))
    order, best, done = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"), None, 0
    for share in slices(n):
        until = round(share * (1 << 30))
        of, cells = grid(n_queries, int(n * (until - done) / (1 << 30)), max(1, dim), query_bytes,
                         spark.sparkContext.defaultParallelism)
        part = rows.where((place >= done) & (place < until)).select("id", "v").mapInPandas(pack, PACKED)
        no_floors = [F.lit(None).cast(kind).alias(name) for name, kind in FLOORS.items()]
        part = part.withColumn("piece", F.monotonically_increasing_id()).select(
            F.explode(F.sequence(F.lit(0), F.lit(of - 1))).alias("of"),
            F.pmod(F.xxhash64("piece"), F.lit(cells)).cast("int").alias("cell"), F.lit(1).alias("asks"),
            "dim", "piece", "ids", "vectors", *no_floors)
        if best is None:
            asked = chunks.select("*", *no_floors)
        else:
            floors = best.where(F.col("rank") == k).groupBy(F.shiftright("row", 12).alias("piece")).agg(
                F.collect_list(F.struct((F.col("row") % PIECE_ROWS).cast("int").alias("at"), "score", "vec_id")).alias("f"))
            floors = floors.select("piece", F.col("f.at").alias("floor_at"), F.col("f.score").alias("floors"),
                                   F.col("f.vec_id").alias("floor_ids"))
            asked = chunks.join(floors, "piece", "left")
        asked = asked.select(F.pmod(F.xxhash64("piece"), F.lit(of)).cast("int").alias("of"),
                             F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"), F.lit(0).alias("asks"),
                             *part.columns[3:])
        # A cell is a partition; queries come before the candidates there.
        keys = F.array(*[F.lit(x).cast("long") for x in partition_keys(spark, of * cells)])
        dealt = asked.union(part).withColumn("key", keys[F.col("of") * cells + F.col("cell")])
        dealt = dealt.repartition(of * cells, "key").sortWithinPartitions("of", "cell", "dim", "asks")
        found = dealt.mapInPandas(_searcher(k, pivots, BLOCK, CHUNK),
                                  "row long, query_id long, vec_id long, score long")
        if best is not None:
            found = best.drop("rank").unionByName(found)
        best, done = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), until
        if share < 1:
            best = written(best, "best")
    return best.select("query_id", "rank", "vec_id", "score")
