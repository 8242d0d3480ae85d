"""Operator 7, exact top-k inner products by an impact-ordered, score-at-a-time index.

Vectors are cut into blocks of bounded size, each indexed once. A posting is a component of a vector; postings are grouped into segments by their
quantised impact, the magnitude of the component. Segments go into the scores of a batch of queries by descending impact, a tier of levels at a time.
What a row's postings that are still out can add to a score is at most their norm times the query's (Cauchy and Schwarz), so after each tier every score has
a lower and an upper bound. A row whose upper bound is under the k-th lower bound, or under a k-th score that an earlier block gave, cannot be among the best.
A query stops when few rows are left that can be; exactly those are rescored, in integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspan.llm.shared import spool

#: Components are scaled by SCALE and floored; impacts are quantised by 2 to the power of SHIFT.
SCALE, SHIFT = 1024, 3
#: Tiers end where so large a share of the postings has gone in.
TIERS = (0.25, 0.4, 0.5, 0.6, 0.7, 0.85, 1.0)
#: Rows of a block of candidates, queries that are processed at once, and rows left, as a multiple of k, at which a query stops.
BLOCK, QUERIES, FEW = 8192, 512, 8
#: Slack of bounds for rounding, relative to the norms.
EPS = 1e-12


class Index:
    """Postings of a block (integer vectors x by row, ids) as a matrix for each tier of quantised impacts, and the norm of what is out after it."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        self.x, self.ids = x, ids
        self.by_id = np.argsort(ids, kind="stable")
        level = np.abs(x) >> SHIFT
        size = np.bincount(np.unique(level, return_inverse=True)[1].ravel())
        levels, done = np.unique(level)[::-1], np.cumsum(size[::-1])
        ends = sorted({int(np.searchsorted(done, share * x.size)) for share in TIERS})
        self.tiers, last = [], None
        for e in ends:
            low = levels[min(e, len(levels) - 1)]
            own = np.where((level >= low) & (True if last is None else level < last), x, 0).astype(np.float64)
            out = np.where(level < low, x, 0).astype(np.float64)
            self.tiers.append((own, np.sqrt((out * out).sum(1))))
            last = low
        self.norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))

    def search(self, q: np.ndarray, own: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(number of the query, id, score, tiers that each query took): each query's best k rows but those of its own id, ties to the smaller id.

        least: scores under it are of no use (-inf: none known).
        """
        n, n_q = len(self.x), len(q)
        qf = q.astype(np.float64).T
        norm = np.sqrt((qf * qf).sum(0))
        sums = np.zeros((n, n_q))
        a, z = (np.searchsorted(self.ids[self.by_id], own, side=s) for s in ("left", "right"))
        mine = np.repeat(np.arange(n_q), z - a)
        sums[self.by_id[np.repeat(a - np.cumsum(z - a) + (z - a), z - a) + np.arange(len(mine))], mine] = -np.inf
        active, took, rows, asks = np.arange(n_q), np.zeros(n_q, np.int64), [], []
        for t, (matrix, out) in enumerate(self.tiers):
            part = sums[:, active] + matrix @ qf[:, active]
            sums[:, active] = part
            took[active] += 1
            wide = out[:, None] * norm[active] + EPS * self.norm[:, None] * norm[active]
            floor = least[active]
            if n > k:
                low = part - wide
                floor = np.maximum(floor, np.partition(low, n - k, axis=0)[n - k])
            alive = (part + wide >= floor) & (part > -np.inf)
            last = t + 1 == len(self.tiers)
            stop = np.full(len(active), True) if last else alive.sum(0) <= FEW * k
            r, c = np.nonzero(alive[:, stop])
            rows.append(r)
            asks.append(active[stop][c])
            active = active[~stop]
            if not len(active):
                break
        r, c = np.concatenate(rows), np.concatenate(asks)
        scores = np.concatenate([np.einsum("ij,ij->i", self.x[r[i : i + (1 << 16)]], q[c[i : i + (1 << 16)]]) for i in range(0, len(r), 1 << 16)] or [np.zeros(0, np.int64)])
        order = np.lexsort((self.ids[r], -scores, c))
        r, c, scores = r[order], c[order], scores[order]
        place = np.arange(len(c)) - np.searchsorted(c, c)
        best = place < k
        return c[best], self.ids[r[best]], scores[best], took


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.int64)


def _stream(k: int):
    """Rows sorted by block, candidates before queries: a block is indexed when its first query comes, its queries stream through."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, kept, index = None, [], None
        for b in batches:
            blocks, asks = b.column("block").to_numpy(), b.column("asks").to_numpy(zero_copy_only=False)
            new = np.flatnonzero((blocks[1:] != blocks[:-1]) | (asks[1:] != asks[:-1])) + 1
            for lo, hi in zip([0, *new.tolist()], [*new.tolist(), len(b)], strict=True):
                if lo == hi:
                    continue
                if blocks[lo] != at:
                    at, kept, index = blocks[lo], [], None
                part = b.slice(lo, hi - lo)
                if not asks[lo]:
                    kept.append((_matrix(part.column("v")), part.column("vec_id").to_numpy()))
                    continue
                if index is None and kept:
                    index, kept = Index(np.concatenate([x for x, _ in kept]), np.concatenate([i for _, i in kept])), []
                if index is None:  # no candidate of this length in the block
                    continue
                for s in range(0, len(part), QUERIES):
                    some = part.slice(s, QUERIES)
                    own = some.column("vec_id").to_numpy()
                    c, ids, scores, _ = index.search(_matrix(some.column("v")), own, k, some.column("least").fill_null(-np.inf).to_numpy(zero_copy_only=False))
                    yield pa.RecordBatch.from_arrays([pa.array(own[c]), pa.array(ids), pa.array(scores)], names=["query_id", "vec_id", "score"])

    return run


def search(candidates: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k candidates of greatest inner product of floor(1024 * x), ties to the smaller vec_id.

    Both tables have vec_id and embedding (array of float). All candidates count but those whose vec_id is the query's own; fewer than k: all of them.
    Vectors that are null, empty or hold null or non-finite components take no part, nor do null ids; vectors meet only those of
    their length. Rows of queries that share an id and a vector are one query; if vectors differ, the row of the first vector in array order is taken. Repeated
    candidates count each. Empty tables give an empty table. Other columns are ignored. Candidates are dealt to blocks of about `block` rows by
    a hash of the id and the row's place, so repeated ids fill no block; any dealing gives the same result. All queries meet a first block, whose k-th
    scores go with them to the others, in tasks that hold one block and one batch of queries; k rows a query and block are merged.
    """
    whole = lambda df: df.where("vec_id is not null and size(embedding) > 0").where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE)).alias("v"))
    c, q = whole(candidates), spool(whole(queries).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    blocks = max(1, -(-candidates.count() // block))
    # the written table fixes each row's block, whichever it is
    c = spool(c.select(F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("asks"), "vec_id", "v", F.size("v").alias("dims"), F.lit(None).cast("double").alias("least")), "candidates")

    def met(own: DataFrame, asks: DataFrame, numbers) -> DataFrame:
        asks = asks.select(F.explode(numbers).alias("block"), F.lit(True).alias("asks"), "vec_id", "v", F.size("v").alias("dims"), "least")
        rows = own.unionByName(asks).withColumn("block", F.xxhash64("dims", "block"))
        return rows.repartition(max(1, min(blocks, 4096)), "block").sortWithinPartitions("block", "asks").select("block", "asks", "vec_id", "v", "least").mapInArrow(_stream(k), "query_id long, vec_id long, score long")

    first = spool(met(c.where("block = 0"), q.withColumn("least", F.lit(None).cast("double")), F.array(F.lit(0))), "first")
    if blocks == 1:
        found = first
    else:
        least = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("least"))
        asks = q.join(least.withColumnRenamed("query_id", "own"), F.col("vec_id") == F.col("own"), "left").select("vec_id", "v", "least")
        found = first.unionAll(met(c.where("block > 0"), asks, F.sequence(F.lit(1), F.lit(blocks - 1))))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
