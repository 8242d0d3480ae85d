"""Operator 8, SimHash near-deduplication with Golay-code fuzzy hashing.

The 64 bits are parted into segments of 23, 23 and 18 bits (the last filled up with zeros), words of the perfect binary Golay code (23, 12, 7).
Every word is at most 3 bits from one codeword; a word that differs from it in one bit is at most 4 bits from the same codeword.
So the index gives the index of a segment's nearest codeword, the query those of all codewords within 4 bits (1 or 6 of them),
and segments that differ in at most one bit always share a key. Three errors in three segments leave these cases, each with its keys:
two segments without error; one without error and one with a single error; a single error in each (then half of the third is whole).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.shared import WORD, lower_ascii, spool, stars

#: Generator polynomial of the code, and the segments (shift, bits). Fixed values.
POLYNOMIAL = 0b101011100011
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Greatest number of differing bits of a link. The keys above are made for 3.
BITS = 3


def fingerprints(texts: list[str | None], shingle: int) -> np.ndarray:
    """SimHash of whole lower-cased texts: bit i is set if it is set in over half the XXH64 (seed 42) of the shingles, repeats included. No word: 0."""
    import regex
    import xxhash

    find, h = regex.compile(WORD).findall, xxhash.xxh64_intdigest
    out = np.zeros(len(texts), np.uint64)
    for i, text in enumerate(texts):
        w = find(text) if text else []
        if not w:
            continue
        if len(w) <= shingle:
            hashes = [h(" ".join(w).encode(), 42)]
        else:
            hashes = [h(" ".join(x).encode(), 42) for x in zip(*(w[k:] for k in range(shingle)))]  # noqa: B905
        n = len(hashes)
        a = np.zeros(-(-n // 255) * 255, np.uint64)
        a[:n] = hashes
        bits = np.unpackbits(a.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = bits.reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
        out[i] = np.packbits(sums * 2 > n, bitorder="little").view(np.uint64)[0]
    return out


def fingerprint(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """docs plus fp, the fingerprint as a signed long. Null texts have no word."""
    from pyspark.sql import types as T

    names = docs.columns
    schema = T.StructType([*[f for f in docs.schema.fields if f.name != "text"], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 512):
                b = whole.slice(at, 512)
                fp = fingerprints(b.column(names.index("text")).to_pylist(), shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays([*[b.column(i) for i, n in enumerate(names) if n != "text"], pa.array(fp)], names=schema.names)

    return docs.withColumn("text", lower_ascii(F.col("text"))).mapInArrow(run, schema)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome: the pattern of the nearest codeword, all patterns of at most 4 bits that lead to a codeword, and their number."""
    def syndrome(x: int) -> int:
        for i in range(22, 10, -1):
            if x >> i & 1:
                x ^= POLYNOMIAL << (i - 11)
        return x

    one = [syndrome(1 << i) for i in range(23)]
    near = np.zeros(2048, np.uint32)
    within: list[list[int]] = [[] for _ in range(2048)]
    for k in range(5):
        for at in combinations(range(23), k):
            s = 0
            for i in at:
                s ^= one[i]
            x = sum(1 << i for i in at)
            if k <= 3:
                near[s] = x
            within[s].append(x)
    most = max(map(len, within))
    every = np.array([w + [w[0]] * (most - len(w)) for w in within], np.uint32)
    return near, every, np.array(list(map(len, within)))


@cache
def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and of the high 11 bits; the sum (xor) of both is a word's."""
    def table(shift: int, n: int) -> np.ndarray:
        x = np.arange(1 << n, dtype=np.uint32) << shift
        for i in range(22, 10, -1):
            x = np.where(x >> i & 1, x ^ np.uint32(POLYNOMIAL << (i - 11)), x)
        return x

    return table(0, 12), table(12, 11)


def codewords(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For 23-bit words: the index (12 high bits) of the nearest codeword, those of all within 4 bits, and which of these count."""
    near, every, n = _tables()
    low, high = _syndromes()
    x = x.astype(np.uint32)
    s = low[x & 4095] ^ high[x >> 12]
    return (x ^ near[s]) >> 11, (x[:, None] ^ every[s]) >> 11, np.arange(every.shape[1]) < n[s][:, None]


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, row) of the index and (keys, row) of the query for fingerprints."""
    fp = fp.view(np.uint64)
    seg = [(fp >> np.uint64(s) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in SEGMENTS]
    code = [codewords(x) for x in seg]
    rows = np.arange(len(fp))
    index, query = [], []

    def add(tag: int, exact: list[np.ndarray], coded: list[int]) -> None:
        head = np.full(len(fp), tag, np.int64)
        for x in exact:
            head = head << 23 | x
        one, many, on = head, head[:, None], np.ones((len(fp), 1), bool)
        for j in coded:
            one = one << 12 | code[j][0]
            many = (many[:, :, None] << 12 | code[j][1][:, None, :]).reshape(len(fp), -1)
            on = (on[:, :, None] & code[j][2][:, None, :]).reshape(len(fp), -1)
        index.append((one, rows))
        at = np.nonzero(on)
        query.append((many[at], at[0]))

    for tag, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        add(tag + 1, [seg[i], seg[j]], [])
    for tag, (i, j) in enumerate(((0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1))):
        add(tag + 4, [seg[i]], [j])
    add(10, [seg[2] & 511], [0, 1])
    add(11, [seg[2] >> 9], [0, 1])
    join = lambda a: (np.concatenate([k for k, _ in a]), np.concatenate([r for _, r in a]))
    return *join(index), *join(query)


def links(prints: DataFrame) -> DataFrame:
    """(a, b): all pairs of different fingerprints (column fp, distinct and not null) that differ in at most 3 bits. The bits are compared inside the join.

    Spark sizes the keys by the fingerprints' file, 100 times too low, and would broadcast the questions: the join is asked to merge.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 2048):
                fp = whole.column(0).slice(at, 2048).to_numpy(zero_copy_only=False).astype(np.int64)
                k, r, q, s = keys(fp)
                for key, own, asks in ((k, fp[r], False), (q, fp[s], True)):
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own), pa.array(np.full(len(key), asks))], names=["key", "fp", "asks"])

    every = prints.select("fp").mapInArrow(run, "key long, fp long, asks boolean")
    a = every.where("not asks").select("key", F.col("fp").alias("a"))
    b = every.where("asks").select("key", F.col("fp").alias("b"))
    return a.hint("merge").join(b, (a["key"] == b["key"]) & (a["a"] < b["b"]) & (F.bit_count(a["a"].bitwiseXOR(b["b"])) <= BITS)).select("a", "b").distinct()


def groups(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): each document's fingerprint and the smallest doc_id that links of at most 3 bits reach.

    Links are sought between different fingerprints only, and exact: no key, bucket or group is capped. Texts are taken whole; null and empty
    ones have fingerprint 0 and link like others; fewer words than a shingle make one shingle. Null ids are never the smallest,
    unless a group has no other. Repeated rows stay; an empty table stays empty; columns besides doc_id and text are ignored.
    """
    seen = spool(fingerprint(docs.select("doc_id", "text"), shingle), "fingerprints")
    own = spool(seen.groupBy("fp").agg(F.min("doc_id").alias("low")), "prints")
    tied = spool(stars(links(own)), "ties").select(F.col("a").alias("tied"), "root")
    own = own.join(tied.hint("merge"), own["fp"] == tied["tied"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    first = own.groupBy("root").agg(F.min("low").alias("component_id"))
    named = own.join(first, "root").select(F.col("fp").alias("own_fp"), "component_id")
    return seen.hint("merge").join(named, seen["fp"] == named["own_fp"]).select("doc_id", "fp", "component_id")


def hexed(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
