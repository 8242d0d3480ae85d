"""Documents alike in their word shingles, on the keys of operator 8: the near-duplicate stage of the pipeline.

Candidates: texts whose SimHash of distinct words differs in at most 3 bits (Golay keys of simhash.py) or that share a band of minhashes of their
shingle sets, and whose sketches are near. Links: candidates whose shingle sets have the similarity asked for. Groups: what links connect.

Large groups of near copies must not become all their pairs, and no link may be lost. So groups are contracted in rounds: first each text is held
against two others of its keys; then only keys whose texts are still in different groups are looked at, where each pair of groups tries its
nearest candidates; at last every candidate between two groups that is left is verified. Rounds are joins and aggregates, which spill.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.shared import lower_ascii, release, slices, spool, stars
from larkspan.llm.simhash import BITS, keys

#: Shingle similarity of a link, and differing bits that sketches of 64 minhash bits may have (a pair of 0.8 has 6.4 on average).
SIMILARITY, SKETCH_BITS = 0.8, 20
#: Bands of minhashes of the shingle set, and minhashes of each: a pair of similarity 0.8 shares no band once in 14,000 times.
BANDS, BAND = 24, 5
#: Keys that are broadcast at most.
SMALL = 200_000
#: What a dealt key is: an index entry or a question of the Golay code, or the first of the bands.
INDEX, ASKS, OF_BAND = 0, 1, 2
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(29)) * _MIX
    return x ^ x >> np.uint64(32)


class Texts:
    """Word hashes of lower-cased texts (null: no word): words of text i are h[ends[i - 1]:ends[i]]."""

    def __init__(self, texts: pa.Array):
        import xxhash

        found = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        parent, words = pc.list_parent_indices(found), pc.list_flatten(found)
        there = pc.not_equal(words, "")
        parent, words = parent.filter(there).to_numpy().astype(np.int64), words.filter(there).dictionary_encode()
        own = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words.dictionary.to_pylist()), np.uint64, len(words.dictionary))
        at = words.indices.to_numpy().astype(np.int64)
        self.h = own[at] if len(own) else np.zeros(0, np.uint64)
        each = np.unique(parent * max(1, len(own)) + at)  # the distinct words of each text
        self.own, self.own_n = own[each % max(1, len(own))] if len(own) else np.zeros(0, np.uint64), np.bincount(each // max(1, len(own)), minlength=len(texts))
        self.n = np.bincount(parent, minlength=len(texts))
        self.ends = np.cumsum(self.n)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of the shingles of k words, text by text, number by text), repeats included; fewer words make one shingle, no word none."""
        h, n = self.h, self.n
        number = np.where(n >= k, n - k + 1, np.minimum(n, 1))
        first = np.repeat(self.ends - n - (np.cumsum(number) - number), number) + np.arange(int(number.sum()))
        left = np.repeat(n, number)
        x = np.zeros(len(first), np.uint64)
        for j in range(k):  # words past a short text's end count as none
            at = first + j
            there = j < left
            x = x * _STEP + np.where(there, h[np.minimum(at, len(h) - 1)] if len(h) else np.uint64(0), np.uint64(0)) + np.uint64(j)
        return _mixed(x), number

    def print_of_words(self) -> np.ndarray:
        """SimHash of the distinct words, each once, so that no frequent word makes all bits. No word: 0."""
        x, n, ends = self.own ^ self.own >> np.uint64(29), self.own_n, np.cumsum(self.own_n)
        sums = np.zeros((len(n), 64), np.int64)
        for a in range(0, len(x), 1 << 16):
            part = x[a : a + (1 << 16)]
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            rows = np.arange(*np.searchsorted(ends, (a, a + len(part) - 1), side="right") + np.array((0, 1)))
            rows = rows[n[rows] > 0]
            sums[rows] += np.add.reduceat(bits, np.maximum(ends[rows] - n[rows] - a, 0), axis=0, dtype=np.int64)
        return np.ascontiguousarray(np.packbits(sums * 2 > n[:, None], axis=1, bitorder="little")).view(np.int64).ravel()


@cache
def _orders() -> np.ndarray:
    return np.random.default_rng(7).integers(0, 1 << 63, BANDS * BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minhashes(x: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit sketch, keys of the bands of 60 bits) by text. No shingle: the same ones for all such texts."""
    rows = np.flatnonzero(number)
    starts = (np.cumsum(number) - number)[rows]
    least = np.zeros((BANDS * BAND, len(number)), np.uint64)
    for i, order in enumerate(_orders()):
        if len(rows):
            least[i, rows] = np.minimum.reduceat(x * order, starts)
    bands = np.zeros((BANDS, len(number)), np.uint64)
    for j in range(BAND):
        bands = _mixed((bands ^ least[j::BAND]) * _STEP)
    bands = (bands + np.arange(BANDS, dtype=np.uint64)[:, None] * _STEP) >> np.uint64(4)
    sketch = np.ascontiguousarray(np.packbits((least[:64] >> np.uint64(9) & np.uint64(1)).astype(np.uint8).T, axis=1, bitorder="little")).view(np.int64).ravel()
    return sketch, bands.T


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """By text, the sorted 32-bit hashes of its distinct shingles."""
    x, number = Texts(texts).shingles(k)
    return [np.unique(part) for part in np.split((x >> np.uint64(32)).astype(np.uint32), np.cumsum(number)[:-1])] if len(number) else []


def _dealt(node: DataFrame, asks: bool) -> DataFrame:
    """(key, kind, body, fp, sketch, root): the keys of each text. asks: with the Golay code's questions. Spark sizes it by the texts, far too low: its joins are asked to merge."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 2048):
                b = whole.slice(at, 2048)
                body, fp, sketch, root = (b.column(i).to_numpy() for i in (0, 1, 2, 4))
                k, r, q, s = keys(np.ascontiguousarray(fp))
                bands = np.frombuffer(b"".join(b.column(3).to_pylist()), np.int64) | 1 << 60
                every = np.repeat(np.arange(len(b)), BANDS)
                for key, rows, kind in ((k, r, np.full(len(k), INDEX)), (q, s, np.full(len(q), ASKS)), (bands, every, np.tile(np.arange(OF_BAND, OF_BAND + BANDS), len(b)))):
                    if asks or key is not q:
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(kind.astype(np.int8)), *[pa.array(x[rows]) for x in (body, fp, sketch, root)]], names=["key", "kind", "body", "fp", "sketch", "root"])

    return node.select("body", "fp", "sketch", "bands", "root").mapInArrow(run, "key long, kind byte, body long, fp long, sketch long, root long")


def _far(kind, fp, other_fp, sketch, other_sketch):
    """Differing bits of two sketches, null if they or the fingerprints of a Golay key are too far."""
    bits = F.bit_count(sketch.bitwiseXOR(other_sketch))
    return F.when((bits <= SKETCH_BITS) & ((kind >= OF_BAND) | (F.bit_count(fp.bitwiseXOR(other_fp)) <= BITS)), bits)


def _first_edges(node: DataFrame) -> DataFrame:
    """(a, b): each text with the nearest and with the smallest of the ends (smallest and greatest body) of its keys."""
    dealt = _dealt(node, False)
    ends = dealt.groupBy("key").agg(F.min(F.struct("body", "fp", "sketch")).alias("low"), F.max(F.struct("body", "fp", "sketch")).alias("high")).where("low.body <> high.body")
    x = dealt.hint("merge").join(ends, "key").select("kind", "body", "fp", "sketch", F.explode(F.array("low", "high")).alias("o"))
    far = _far(F.col("kind"), F.col("fp"), F.col("o.fp"), F.col("sketch"), F.col("o.sketch"))
    x = x.where("body <> o.body").select(F.col("body").alias("a"), F.col("o.body").alias("b"), far.alias("far")).where("far is not null")
    x = x.groupBy("a").agg(F.min("b").alias("low"), F.min(F.struct("far", "b"))["b"].alias("near"))
    return x.select(F.explode(F.array("low", "near")).alias("b"), "a").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _mixed_keys(node: DataFrame) -> DataFrame:
    """The dealt rows of keys whose texts are in different groups."""
    dealt = _dealt(node, True)
    mixed = spool(dealt.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key"), "keys")
    mixed = F.broadcast(mixed) if mixed.limit(SMALL + 1).count() <= SMALL else mixed.hint("merge")
    return spool(dealt.join(mixed, "key", "left_semi"), "mixed")


def _candidates(rows: DataFrame, node: DataFrame) -> DataFrame:
    """(a, b, low, high, far): candidates of different groups (low < high are their roots), from dealt rows; node has body, root and marks (a number of each band).

    Of two groups one is not the key's greatest: only such rows are joined to all of the key, so a giant group is not paired with itself.
    A pair comes from the first band it shares, from Golay keys only if it shares none.
    """
    rows = rows.drop("root").join(node.select("body", "root", "marks"), "body")
    count = rows.groupBy("key", "root").agg(F.count("*").alias("n"))
    main = count.groupBy("key").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.count("*").alias("groups")).where("groups > 1").select("key", "main")
    left = rows.join(main, "key").where("root <> main").select("key", *[F.col(c).alias(f"l_{c}") for c in ("kind", "body", "fp", "sketch", "root", "marks")])
    far = _far(F.col("kind"), F.col("fp"), F.col("l_fp"), F.col("sketch"), F.col("l_sketch"))
    first = F.array_position(F.zip_with("marks", "l_marks", lambda x, y: x == y), True)
    x = left.join(rows, "key").where(F.col("root") != F.col("l_root")).where((F.col("kind") == F.col("l_kind")) & (F.col("kind") >= OF_BAND) | (F.col("kind") + F.col("l_kind") == INDEX + ASKS))
    x = x.where(far.isNotNull()).where(F.when(F.col("kind") >= OF_BAND, first == F.col("kind") - OF_BAND + 1).otherwise(first == 0)).withColumn("far", far)
    own = F.struct(F.col("root").alias("root"), F.col("body").alias("body"))
    other = F.struct(F.col("l_root").alias("root"), F.col("l_body").alias("body"))
    x = x.select(F.least(own, other).alias("one"), F.greatest(own, other).alias("two"), "far")
    return x.select(F.col("one.body").alias("a"), F.col("two.body").alias("b"), F.col("one.root").alias("low"), F.col("two.root").alias("high"), "far").distinct()


def alike(docs: DataFrame, shingle: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, body, component_id, kept_body): the smallest doc_id that links reach. A link: Jaccard similarity of the shingle sets of at least `similarity`.

    body is a hash of the lower-cased text; kept_body is the smallest body of the rows of component_id. Equal texts are one node. Null and empty texts are
    one group, as they have the same (no) shingles. Null ids are never the smallest unless a group has no other. Repeated rows stay; an empty table
    stays empty; columns besides doc_id and text are ignored. No cap on candidates: all that keys bring together across groups are verified.
    """
    x = docs.select("doc_id", lower_ascii(F.coalesce("text", F.lit(""))).alias("text")).select("doc_id", F.xxhash64("text").alias("body"), "text")
    kind = dict(docs.dtypes)["doc_id"]

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                t = Texts(b.column(2))
                sketch, bands = minhashes(*t.shingles(shingle))
                bands = np.ascontiguousarray(bands).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(t.print_of_words()), pa.array(sketch), pa.array([r.tobytes() for r in bands], pa.binary())], names=["doc_id", "body", "fp", "sketch", "bands"])
            release()

    seen = spool(x.mapInArrow(prints, f"doc_id {kind}, body long, fp long, sketch long, bands binary"), "prints")
    node = spool(seen.groupBy("body").agg(F.min("doc_id").alias("low_id"), *[F.min(n).alias(n) for n in ("fp", "sketch", "bands")]).withColumn("root", F.col("body")), "texts")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in shingle_sets(b.column(1), shingle)], pa.binary())], names=["body", "shingles"])
            release()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for one, other in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                one, other = np.frombuffer(one, np.uint32), np.frombuffer(other, np.uint32)
                n = len(np.intersect1d(one, other, assume_unique=True))
                good.append(n >= similarity * (len(one) + len(other) - n))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])
            release()

    def verified(pairs: DataFrame) -> DataFrame:
        """The links among (a, b). One row of each text is read again, its set is made once."""
        linked = pairs.select(F.col("a").alias("body")).unionAll(pairs.select("b")).distinct()
        linked = node.join(linked, "body", "left_semi").select(F.col("body").alias("own"), "low_id")
        own = x.join(linked, (F.col("body") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("low_id"))).select("body", "text")
        own = own.mapInArrow(sets, "body long, shingles binary").groupBy("body").agg(F.first("shingles").alias("shingles"))
        own = spool(own, "shingles")
        return spool(pairs.join(own.toDF("a", "one"), "a").join(own.toDF("b", "other"), "b").select("a", "b", "one", "other").mapInArrow(compare, "a long, b long"), "verified")

    def contracted(rows: DataFrame, edges: DataFrame) -> DataFrame:
        """rows with the root that the groups joined by edges (a, b between roots) have."""
        ties = spool(stars(edges), "ties").select(F.col("a").alias("tied"), F.col("root").alias("to"))
        return rows.join(ties, F.col("root") == F.col("tied"), "left").withColumn("root", F.coalesce("to", "root")).drop("tied", "to")

    def between(links: DataFrame, pairs: DataFrame) -> DataFrame:
        return links.join(pairs, ["a", "b"]).select(F.col("low").alias("a"), F.col("high").alias("b"))

    @F.pandas_udf("array<int>")
    def marks(bands: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(b, np.int64).astype(np.int32) for b in bands])

    # first round: a few edges a text
    pairs = spool(_first_edges(node), "first")
    node = spool(contracted(node, verified(pairs)), "groups")
    # second round: each pair of groups tries its nearest candidates
    every = spool(_candidates(_mixed_keys(node), node.withColumn("marks", marks(F.col("bands")))), "candidates")
    if not every.isEmpty():
        nearest = spool(every.groupBy("low", "high").agg(F.min(F.struct("far", "a", "b")).alias("n")).select("n.a", "n.b", "low", "high"), "nearest")
        node = spool(contracted(node, between(verified(nearest.select("a", "b")), nearest)), "groups")
        # last round: every other candidate between groups
        root = lambda c, name: node.select(F.col("body").alias(c), F.col("root").alias(name))
        rest = every.select("a", "b").join(root("a", "low"), "a").join(root("b", "high"), "b").where("low <> high").join(nearest.select("a", "b"), ["a", "b"], "left_anti")
        seen_pair = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"))
        rest = spool(rest.join(seen_pair, (F.least("a", "b") == F.col("x")) & (F.greatest("a", "b") == F.col("y")), "left_anti"), "rest")
        if not rest.isEmpty():
            node = spool(contracted(node, between(verified(rest.select("a", "b")), rest)), "groups")
    own = seen.select("doc_id", "body").join(node.select("body", "root"), "body")
    first = own.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "body")).alias("m")).select("root", F.col("m.doc_id").alias("component_id"), F.col("m.body").alias("kept_body"))
    return own.join(first, "root").select("doc_id", "body", "component_id", "kept_body")


def keep_one(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """docs with one row of each group of alike(): the one of the smallest id, and of rows that share that id the one of the smallest body.

    Rows with the same id and text (but for case) are the same document: one of them stays. Rows that only share the id are different documents, each of its
    own group. Null ids stay only where a group has no other. Null and empty texts are one group. An empty table stays empty; all columns are kept.
    """
    named = [c for c in docs.columns if c not in ("doc_id", "text")]
    x = docs.select(F.col("doc_id").alias("c_id"), F.col("text").alias("c_text"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(named)])
    x = x.withColumn("own_body", F.xxhash64(lower_ascii(F.coalesce("c_text", F.lit("")))))
    kept = alike(docs, shingle).where(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("body") == F.col("kept_body"))).select("doc_id", "body").distinct()
    x = x.join(kept, F.col("c_id").eqNullSafe(F.col("doc_id")) & (F.col("own_body") == F.col("body")), "left_semi").dropDuplicates(["c_id", "own_body"])
    at = {"doc_id": "c_id", "text": "c_text", **{c: f"c{i}" for i, c in enumerate(named)}}
    return x.select(*[F.col(at[c]).alias(c) for c in docs.columns])
