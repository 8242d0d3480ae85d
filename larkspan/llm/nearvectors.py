"""Operator 5, near-duplicate vectors by a flat graph: robust-pruned on overlapping cluster shards, adjacency lists united, range-expanding greedy search from medoids, links verified in double precision; an exact check adds the links that the search has missed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.shared import spool, stars

#: Cosine of a link.
LINK = 0.95
#: Vectors that centroids are fitted on (bound of the sample), vectors a centroid, centroids at most, shards a vector is in.
SAMPLE, SHARE, CENTROIDS, OVERLAP = 8192, 1500, 1024, 3
#: Vectors of a shard at most; larger clusters are cut into parts and every part is asked for every other.
SHARD = 4096
#: Neighbours looked at and the slack of robust pruning, random and medoid neighbours added, medoids, nodes expanded before the range phase.
NEAR, ALPHA, RANDOM, MEDOIDS, STEPS = 32, 1.2, 4, 16, 40
#: Vectors of a cell at most: the check of pairs without a common shard holds cell against cell.
CELL = 16384


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centroids(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means on unit vectors, started from rows spread over the sample."""
    c = sample[np.linspace(0, len(sample) - 1, k).astype(int)]
    for _ in range(rounds):
        own = (sample @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, own, sample)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 0, total / np.maximum(size, 1e-300), c)
    return c


def prune(x: np.ndarray, seed: int) -> np.ndarray:
    """Adjacency (rows of node numbers, -1 for none) of a shard's unit vectors: nearest neighbours robustly pruned, and some random ones."""
    n = len(x)
    near = min(NEAR, n - 1)
    rng = np.random.default_rng(seed)
    out = np.full((n, near + RANDOM), -1, np.int64)
    for a in range(0, n, 512):
        s = x[a : a + 512] @ x.T
        m = len(s)
        s[np.arange(m), np.arange(a, a + m)] = -2
        if near:
            c = np.argpartition(-s, near - 1, axis=1)[:, :near]
            c = np.take_along_axis(c, np.argsort(-np.take_along_axis(s, c, 1), axis=1, kind="stable"), 1)
            far = np.sqrt(np.maximum(0, 2 - 2 * np.take_along_axis(s, c, 1)))
            v = x[c]
            among = np.sqrt(np.maximum(0, 2 - 2 * np.matmul(v, v.transpose(0, 2, 1))))
            alive = np.ones((m, near), bool)
            for j in range(near):
                alive[:, j + 1 :] &= ~(alive[:, j, None] & (ALPHA * among[:, j, j + 1 :] <= far[:, j + 1 :]))
            out[a : a + m, :near] = np.where(alive, c, -1)
        out[a : a + m, near:] = rng.integers(0, n, (m, RANDOM))
    return out


def medoids(x: np.ndarray) -> np.ndarray:
    """The node nearest to the mean, then nodes far from those before."""
    at = [int((x @ x.mean(0)).argmax())]
    best = x @ x[at[0]]
    for _ in range(min(MEDOIDS, len(x)) - 1):
        at.append(int(best.argmin()))
        best = np.maximum(best, x @ x[at[-1]])
    return np.array(at)


def explore(graph: np.ndarray, x: np.ndarray, start: np.ndarray, q: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) of nodes with a cosine of reach or more that the search meets: greedy from start, then on from every node in range."""
    n = len(x)
    x32, q32 = x.astype(np.float32), q.astype(np.float32)
    seen = np.full((len(q), n), -2, np.float32)
    fresh = np.zeros((len(q), n), np.float32)  # cosines of seen nodes that are not expanded, shifted by 2
    both = lambda rows, nodes: np.einsum("ij,ij->i", q32[rows], x32[nodes])

    def visit(rows: np.ndarray, nodes: np.ndarray) -> None:
        new = (nodes >= 0) & (seen[rows, nodes] == -2)
        rows, nodes = rows[new], nodes[new]
        for a in range(0, len(rows), 1 << 17):
            r, c = rows[a : a + (1 << 17)], nodes[a : a + (1 << 17)]
            s = both(r, c)
            seen[r, c] = s
            fresh[r, c] = s + 2

    every = np.arange(len(q))
    visit(np.repeat(every, len(start)), np.tile(start, len(q)))
    for _ in range(STEPS):
        best = fresh.argmax(1)
        on = np.flatnonzero(fresh[every, best] > 0)
        if not len(on):
            break
        fresh[on, best[on]] = 0
        visit(np.repeat(on, graph.shape[1]), graph[best[on]].ravel())
    while True:
        rows, nodes = np.nonzero(fresh >= reach + 2)
        if not len(rows):
            break
        for a in range(0, len(rows), 1 << 14):
            r, c = rows[a : a + (1 << 14)], nodes[a : a + (1 << 14)]
            fresh[r, c] = 0
            visit(np.repeat(r, graph.shape[1]), graph[c].ravel())
    return np.nonzero(seen >= reach)


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node that each of n nodes reaches by the links (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def slack(dims: int) -> float:
    """What a cosine in single precision may lack at most."""
    return 1e-4 + 2e-7 * dims


def cells(sizes: dict[int, int], k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(first cell, number of cells) of each of k clusters of these sizes, and the number of cells: small clusters share one, large ones are cut by the node."""
    first, number, held, at = np.zeros(k, np.int64), np.ones(k, np.int64), CELL, -1
    for c in range(k):
        n = sizes.get(c, 0)
        if n > CELL:
            number[c] = -(-n // CELL)
            first[c], at, held = at + 1, at + number[c], CELL
        else:
            if held + n > CELL:
                at, held = at + 1, 0
            first[c], held = at, held + n
    return first, number, at + 1


def needed(cosines: np.ndarray, home: np.ndarray, c: np.ndarray, link: float) -> np.ndarray:
    """By vector and cluster, whether a vector of that cluster can have a cosine of `link` with it.

    A vector is nearest to its own centroid, so it is on that side of the plane between two centroids; one linked to it is at most
    sqrt(2 - 2 link) from it, and so from that side.
    """
    far = np.sqrt(np.maximum(0, 2 - 2 * (c @ c.T)))
    reach = np.sqrt(max(0, 2 - 2 * link)) + 1e-6
    return cosines[np.arange(len(home)), home][:, None] - cosines <= reach * far[home] + 1e-6


def _vectors(t: pa.Table, name: str = "v") -> np.ndarray:
    c = t.column(name).combine_chunks()
    return c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)


def apart(placed: DataFrame, at: dict[int, np.ndarray], link: float) -> DataFrame:
    """(node, links, root) of the links between vectors without a common shard, exact. placed: of group(); at: centroids by length.

    Each vector is in the cell of its nearest centroid and asks its own and the later cells that have a cluster it needs. The clusters of its
    own shards it does not need: their vectors share these. A task holds two cells.
    """
    sizes: dict[int, dict[int, int]] = {}
    for d, c, n in placed.where(F.col("dims").isin([d for d, c in at.items() if len(c) > OVERLAP])).groupBy("dims", "home").count().collect():  # at most CENTROIDS a length
        sizes.setdefault(d, {})[c] = n
    sent = placed.sparkSession.sparkContext.broadcast({d: (at[d], *cells(n, len(at[d]))) for d, n in sizes.items()})

    def ask(batches):
        for b in batches:
            t = pa.table({n: b.column(n) for n in ("node", "dims", "v", "copies", "near", "home")})
            for d in sorted(set(t.column("dims").to_pylist()) & sent.value.keys()):
                own = t.filter(pc.equal(t.column("dims"), d))
                c, first, number, n = sent.value[d]
                home, near = own.column("home").to_numpy(), _vectors(own, "near")
                want = needed(_unit(_vectors(own)) @ c.T, home, c, link)
                want[np.arange(len(own))[:, None], near] = False
                has = np.arange(n)[None, :] >= first[:, None]
                has &= np.arange(n)[None, :] < (first + number)[:, None]
                cell = first[home] + own.column("node").to_numpy() % number[home]
                asked = (want.astype(np.float32) @ has.astype(np.float32) > 0) & (np.arange(n)[None, :] >= cell[:, None])
                ends = np.concatenate(([0], np.cumsum(asked.sum(1)))).astype(np.int32)
                own = own.append_column("cell", pa.array(cell.astype(np.int32)))
                own = own.append_column("asks", pa.ListArray.from_arrays(pa.array(ends), pa.array(np.nonzero(asked)[1].astype(np.int32))))
                yield from own.to_batches()

    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"node": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        same = left.column("q_cell")[0].as_py() == left.column("q_ask")[0].as_py()
        q, q_ids, q_copies, q_near, q_home = _unit(_vectors(left, "q_v")), left.column("q_node").to_numpy(), left.column("q_copies").to_numpy(), _vectors(left, "q_near"), left.column("q_home").to_numpy()
        x, ids, copies, near, home = _unit(_vectors(right)), right.column("node").to_numpy(), right.column("copies").to_numpy(), _vectors(right, "near"), right.column("home").to_numpy()
        x32, links, q_links, ties_a, ties_b = x.astype(np.float32).T, np.zeros(len(ids), np.int64), np.zeros(len(q_ids), np.int64), [], []
        for a in range(0, len(q), 256):
            s = q[a : a + 256].astype(np.float32) @ x32 >= link - slack(q.shape[1])
            s &= q_home[a : a + 256, None] != home[None, :]
            r, c = np.nonzero(s)
            for i in range(0, len(r), 1 << 17):
                rr, cc = r[i : i + (1 << 17)] + a, c[i : i + (1 << 17)]
                sure = (np.einsum("ij,ij->i", q[rr], x[cc]) >= link) & ~(q_near[rr][:, :, None] == near[cc][:, None, :]).any((1, 2))
                rr, cc = rr[sure], cc[sure]
                np.add.at(q_links, rr, copies[cc])
                if not same:  # in one cell both ask
                    np.add.at(links, cc, q_copies[rr])
                if len(rr):
                    hit, place = np.unique(np.concatenate((q_ids[rr], ids[cc])), return_inverse=True)
                    ties_a.append(hit)
                    ties_b.append(hit[_roots(place[: len(rr)], place[len(rr) :], len(hit))])
        ties_a, ties_b = (np.concatenate(t) if t else np.zeros(0, np.int64) for t in (ties_a, ties_b))
        n, m = q_links > 0, links > 0
        return pa.table({"node": np.concatenate((q_ids[n], ids[m], ties_a)), "links": np.concatenate((q_links[n], links[m], np.zeros(len(ties_a), np.int64))), "root": np.concatenate((q_ids[n], ids[m], ties_b))})

    what = "node long, dims int, v array<double>, copies long, near array<int>, home int"
    x = spool(placed.select("node", "dims", "v", "copies", "near", "home").mapInArrow(ask, f"{what}, cell int, asks array<int>"), "cells")
    left = x.withColumn("ask", F.explode("asks")).drop("asks")
    pairs = left.select("dims", F.col("cell").alias("asked"), "ask").distinct()  # of cells
    right = x.drop("asks").withColumnRenamed("cell", "ask").join(F.broadcast(pairs), ["dims", "ask"])
    left = left.toDF(*[f"q_{c}" for c in left.columns])
    return left.groupBy("q_dims", "q_cell", "q_ask").cogroup(right.groupBy("dims", "asked", "ask")).applyInArrow(check, "node long, links long, root long")


def group(rows: DataFrame, link: float = LINK) -> DataFrame:
    """One row per row of (vec_id, embedding): vec_id, n_links, component_id, kept.

    n_links counts the other rows with a cosine of `link` or more, all of them: what the search of a shard misses is found by a check of the shard,
    pairs without a common shard by a check of cells of clusters, but for those that the planes between centroids rule out. component_id is the smallest vec_id that links reach,
    itself included; kept: vec_id = component_id. Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing: 0 links, their own component. Vectors of different lengths do not link. Equal vectors are one node of the graph, so that copies
    are counted, not paired. Rows with a null vec_id take part; a component of null ids only has a null id and kept is false.
    An empty table stays empty; other columns are ignored. Every cosine of a link is computed in double precision.
    """
    spark = rows.sparkSession
    good = F.coalesce((F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    x = rows.select("vec_id", "embedding").withColumn("good", good)
    node = spool(x.where("good").groupBy("embedding").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies")).select(F.xxhash64("embedding").alias("node"), F.transform("embedding", lambda y: y.cast("double")).alias("v"), F.size("embedding").alias("dims"), "low", "copies", "embedding"), "nodes")
    n = node.count()
    sample = node.select("dims", "v", F.xxhash64("node", F.lit(1)).alias("o")).orderBy("o").limit(SAMPLE).toArrow()
    at = {}
    for d in set(sample.column("dims").to_pylist()):
        own = _unit(_vectors(sample.filter(pc.equal(sample.column("dims"), d))))
        at[d] = centroids(own, max(1, min(CENTROIDS, len(own), -(-n // SHARE))))
    sent = spark.sparkContext.broadcast(at)  # at most CENTROIDS vectors a length

    def assign(batches):
        for b in batches:
            t = pa.table({"v": b.column("v"), "dims": b.column("dims")})
            near, home = np.zeros((len(t), OVERLAP), np.int32), np.zeros(len(t), np.int32)
            for d in set(t.column("dims").to_pylist()):
                if (c := sent.value.get(d)) is not None and len(c) > 1:
                    mine = np.flatnonzero(t.column("dims").to_numpy() == d)
                    if len(c) > OVERLAP:
                        s = _unit(_vectors(t.take(mine))) @ c.T
                        near[mine] = np.sort(np.argpartition(-s, OVERLAP - 1, axis=1)[:, :OVERLAP], axis=1)
                        home[mine] = near[mine, np.take_along_axis(s, near[mine], 1).argmax(1)]
                    else:
                        near[mine] = np.arange(OVERLAP)
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("dims"), b.column("v"), b.column("copies"), pa.array(list(near), pa.list_(pa.int32())), pa.array(home)], names=["node", "dims", "v", "copies", "near", "home"])

    placed = spool(node.select("node", "dims", "v", "copies").mapInArrow(assign, "node long, dims int, v array<double>, copies long, near array<int>, home int"), "placed")
    member = placed.drop("home").withColumn("shard", F.explode(F.array_distinct("near")))
    sizes = member.groupBy("dims", "shard").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("parts"))
    member = spool(member.join(F.broadcast(sizes), ["dims", "shard"]).withColumn("part", F.pmod(F.xxhash64("node", F.lit(2)), F.col("parts")).cast("int")), "shards")

    def build(t: pa.Table) -> pa.Table:
        ids = t.column("node").to_numpy()
        graph = prune(_unit(_vectors(t)), len(ids))
        return pa.table({"node": ids, "next": pa.array([ids[g[g >= 0]] for g in graph], pa.list_(pa.int64()))})

    lists = member.groupBy("dims", "shard", "part").applyInArrow(build, "node long, next array<long>")
    lists = lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("next"))).alias("next"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"node": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        ids, x = left.column("node").to_numpy(), _unit(_vectors(left))
        place = np.argsort(ids)
        near, copies, shard = np.array(left.column("near").to_pylist()), left.column("copies").to_numpy(), left.column("shard")[0].as_py()
        next_ = left.column("next").combine_chunks()
        flat, ends = next_.flatten().to_numpy(zero_copy_only=False), next_.offsets.to_numpy()
        spot = place[np.minimum(np.searchsorted(ids, flat, sorter=place), len(ids) - 1)]
        spot = np.where(ids[spot] == flat, spot, -1)
        size = np.diff(ends)
        graph = np.full((len(ids), int(size.max(initial=1)) or 1), -1, np.int64)
        graph[np.repeat(np.arange(len(ids)), size), np.arange(ends[0], ends[-1]) - np.repeat(ends[:-1], size)] = spot
        asked, q, q_near = right.column("q_node").to_numpy(), _unit(_vectors(right, "q_v")), np.array(right.column("q_near").to_pylist())
        start = medoids(x)
        links, ties_a, ties_b = np.zeros(len(asked), np.int64), [], []
        for a in range(0, len(asked), 1024):
            every = q[a : a + 1024].astype(np.float32) @ x.astype(np.float32).T >= link - slack(x.shape[1])
            every[explore(graph, x, start, q[a : a + 1024], link - 1e-4)] = True
            r, c = np.nonzero(every)
            r += a
            sure = np.concatenate([np.einsum("ij,ij->i", q[r[i : i + (1 << 16)]], x[c[i : i + (1 << 16)]]) >= link for i in range(0, len(r), 1 << 16)] or [np.zeros(0, bool)]) & (asked[r] != ids[c])
            r, c = r[sure], c[sure]
            # a pair in several shards counts in the first that both are in
            common = (q_near[r][:, :, None] == near[c][:, None, :]).any(2)
            first = np.where(common, q_near[r], np.iinfo(np.int32).max).min(1) == shard
            np.add.at(links, r[first], copies[c[first]])
            root = _roots(r - a, c + 1024, 1024 + len(ids))
            there = np.concatenate((asked[a : a + 1024], np.zeros(max(0, a + 1024 - len(asked)), np.int64), ids))
            hit = np.unique(np.concatenate((r - a, c + 1024)))
            ties_a.append(there[hit])
            ties_b.append(there[root[hit]])
        ties_a, ties_b = np.concatenate(ties_a), np.concatenate(ties_b)
        return pa.table({"node": np.concatenate((asked, ties_a)), "links": np.concatenate((links, np.zeros(len(ties_a), np.int64))), "root": np.concatenate((asked, ties_b))})

    key = ["dims", "shard", "part", "asks"]
    graph = member.join(lists, "node").withColumn("asks", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asks = member.withColumnRenamed("part", "asks").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asks = asks.select(*[F.col(c).alias(f"q_{c}") for c in (*key, "node", "v", "near")])
    found = graph.select(*key, "node", "v", "near", "copies", "next").groupBy(*key).cogroup(asks.groupBy(*[f"q_{c}" for c in key])).applyInArrow(search, "node long, links long, root long")
    found = spool(found, "found")
    if any(len(c) > OVERLAP for c in at.values()):
        found = found.unionAll(spool(apart(placed, at, link), "apart"))
    n_links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = spool(stars(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))), "roots").select(F.col("a").alias("node"), "root")
    node = node.join(n_links, "node", "left").join(roots, "node", "left").select("embedding", "low", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    first = node.groupBy("root").agg(F.min("low").alias("component_id"))
    named = node.join(first, "root").select(F.col("embedding").alias("e"), "n_links", "component_id")
    out = x.join(named, F.col("good") & (F.col("embedding") == F.col("e")), "left")
    component = F.when(F.col("good"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def audit(rows: DataFrame, found: DataFrame, link: float = LINK, asked: int = 200) -> float:
    """Share of the true links of about `asked` vectors (chosen by a hash of the id) that found.n_links has, by brute force over all rows in batches."""
    x = rows.where("vec_id is not null").select("vec_id", "embedding")
    own = x.orderBy(F.xxhash64("vec_id", F.lit(9))).limit(asked).toPandas()
    own = own[[e is not None and len(e) > 0 and all(c is not None for c in e) and np.isfinite(np.array(e, float)).all() and np.any(e) for e in own["embedding"]]]
    q = _unit(np.stack(own["embedding"].to_numpy())) if len(own) else np.zeros((0, 1))
    ids = own["vec_id"].to_numpy()

    def count(batches):
        import pandas as pd

        for b in batches:
            b = b[[e is not None and len(e) == q.shape[1] and all(c is not None for c in e) and np.isfinite(np.array(e, float)).all() and np.any(e) for e in b["embedding"]]]
            if len(b):
                s = (q @ _unit(np.stack(b["embedding"].to_numpy())).T >= link) & (ids[:, None] != b["vec_id"].to_numpy()[None, :])
                yield pd.DataFrame({"vec_id": ids, "truth": s.sum(1)})

    truth = x.mapInPandas(count, "vec_id long, truth long").groupBy("vec_id").agg(F.sum("truth").alias("truth"))
    got = truth.join(found, "vec_id").agg(F.sum(F.least("truth", "n_links")).alias("got"), F.sum("truth").alias("truth")).first()
    return 1.0 if not got["truth"] else got["got"] / got["truth"]
