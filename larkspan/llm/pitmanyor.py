"""Operator 9, scoring by a hierarchical Pitman-Yor model of word bigrams.

A context restaurant for each word seats what follows it; its tables are customers of the word restaurant, which all contexts share as
their parent; that one's base is uniform over the training words and one for all others. Seatings are sampled by Gibbs: in each sweep customers
of contexts leave and are seated again under a draw of the parent, then the parent is seated with the tables of all contexts. The predictive
probability of the seatings after each sweep past burn-in is averaged. The state of a dish is (customers, tables); the sizes of its tables are
integrated out: a customer sits alone with probability S(c-1, t-1) / S(c, t) of generalised Stirling numbers. A context's weight of new tables
rises with its tables; drawn as a gamma variable of theta / d + tables (times d), it leaves the dishes of the context independent of each other.

Distribution: contexts are dealt to shards by a hash; contexts that alone would fill a shard are cut by the hash of what follows, their tables
are added up between sweeps. After each sweep shards send the tables of each dish to the part of the word restaurant that the dish's hash is dealt
to, and get its customers and its draw. So all shards share one parent; the word restaurant's dishes with equal customers are alike, so its tables
are sampled by distinct counts.
Documents travel once, as numbers of words in a batch; batches ask shards with packed sorted hashes and get packed answers in the same order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.shared import release, spool, unspool

#: The end token: no word can be a line end. It is also the context of a text's first word.
END = "\n"
#: Sweeps, of which so many first ones are not averaged; least moves of a dish in a sweep, and moves for each of its customers; chains for each distinct count of the word restaurant.
SWEEPS, BURN_IN, MOVES, TURNS, CHAINS = 4, 1, 8, 4, 16
#: Text bytes of a batch and of a shard.
BATCH, SHARD = 10_000_000, 12_000_000
#: Up to so many customers Stirling ratios are exact; beyond, their limit d * t / c.
EXACT = 64
THETA = 1.0


def alone(d: float) -> np.ndarray:
    """S(c-1, t-1) / S(c, t) by c and t up to EXACT."""
    s = np.zeros((EXACT + 1, EXACT + 1))
    s[0, 0] = 1.0
    out = np.zeros_like(s)
    t = np.arange(1, EXACT + 1)
    for c in range(1, EXACT + 1):
        s[c, 1:] = s[c - 1, :-1] + (c - 1 - d * t) * s[c - 1, 1:]
        s[c, c + 1 :] = 0
        out[c, 1 : c + 1] = s[c - 1, :c] / s[c, 1 : c + 1]
    return out


def first_tables(c: np.ndarray, pull: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes whose customers come one after the other, drawn in blocks that double. pull: the weight of a new table."""
    t, n = np.minimum(c, 1), np.minimum(c, 1)
    while (n < c).any():
        more = np.minimum(n, c - n)
        t = t + rng.binomial(more, np.clip(pull / np.maximum(n - d * t + pull, 1e-300), 0, 1))
        n = n + more
    return t


def reseat(c: np.ndarray, t: np.ndarray, pull: np.ndarray, d: float, moves: int, rng: np.random.Generator) -> np.ndarray:
    """Gibbs moves: of each dish, customers leave and are seated again, each of them TURNS times on average and `moves` of them at least.

    Up to EXACT customers they move one by one; of larger dishes an EXACT-th moves at once.
    """
    t = np.minimum(np.maximum(t, np.minimum(c, 1)), c)
    on = np.flatnonzero(c > 1)
    on = on[np.argsort(-c[on], kind="stable")]
    c, pull, now, table = c[on], pull[on], t[on], alone(d)
    turns = -np.maximum(moves, TURNS * np.minimum(c, EXACT))
    large, block = int((c > EXACT).sum()), -(-c // EXACT)
    for k in range(int(-turns.min(initial=0))):
        n = int(np.searchsorted(turns, -k))
        b, s = slice(0, min(large, n)), slice(min(large, n), n)
        now[b] -= np.minimum(rng.binomial(block[b], d * now[b] / c[b]), now[b] - 1)
        now[b] += rng.binomial(block[b], pull[b] / (c[b] - 1 - d * now[b] + pull[b]))
        now[b] = np.minimum(now[b], c[b])
        x = now[s] - ((rng.random(n - s.start) < table[c[s], now[s]]) & (now[s] > 1))
        now[s] = x + (rng.random(n - s.start) < pull[s] / (c[s] - 1 - d * x + pull[s]))
    t[on] = now
    return t


def discount(n1: float, n2: float) -> float:
    """n1 / (n1 + 2 n2), inside (0, 1)."""
    return float(np.clip((n1 + 0.5) / (n1 + 2 * n2 + 1), 0.05, 0.95))


class Tokens:
    """Training tokens and distinct words, from the distinct counts of words and how many words have each; the base score's terms."""

    def __init__(self, counts: np.ndarray, words: np.ndarray):
        self.total, self.distinct = int((counts * words).sum()), int(words.sum())

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.total + 0.1 * (self.distinct + 1)))


class Words:
    """The word restaurant, by distinct counts of customers: averaged predictive probability of a word of each count and of an unknown one, and the last
    sweep's tables, under which draw() draws the restaurant's weights of words; fresh is the weight of its base."""

    def __init__(self, counts: np.ndarray, dishes: np.ndarray, seed: int):
        self.total, self.distinct = int((counts * dishes).sum()), int(dishes.sum())
        n = dict(zip(counts.tolist(), dishes.tolist(), strict=True))
        d, rng = discount(n.get(1, 0), n.get(2, 0)), np.random.default_rng(seed)
        base, seats = 1 / (self.distinct + 1), float(self.distinct)
        c, t = np.repeat(counts, CHAINS), None
        known, new, samples = np.zeros(len(counts)), 0.0, 0
        for k in range(SWEEPS):
            pull = np.full(len(c), (THETA + d * seats) * base)
            t = reseat(c, first_tables(c, pull, d, rng) if t is None else t, pull, d, MOVES, rng)
            mean = t.reshape(len(counts), CHAINS).mean(1)
            seats = float((mean * dishes).sum())
            if k >= BURN_IN:
                rest = (THETA + d * seats) * base
                known, new, samples = known + (counts - d * mean + rest) / (THETA + self.total), new + rest / (THETA + self.total), samples + 1
        self.counts, self.known, self.new = counts, known / samples, new / samples
        self.d, self.tables, self.fresh = d, t.reshape(len(counts), CHAINS), float(rng.gamma(THETA + d * seats))

    def p(self, c: np.ndarray) -> np.ndarray:
        if not len(self.counts):
            return np.full(len(c), self.new)
        return np.where(c > 0, self.known[np.minimum(np.searchsorted(self.counts, c), len(self.counts) - 1)], self.new)

    def draw(self, c: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Gamma weights of dishes of c customers, 0 without customers."""
        out, on = np.zeros(len(c)), c > 0
        if on.any():
            out[on] = rng.gamma(c[on] - self.d * self.tables[np.searchsorted(self.counts, c[on]), rng.integers(0, CHAINS, int(on.sum()))])
        return out


class Shard:
    """Pairs (context u, dish w) of a shard in order, with c training customers; hot: numbers of its contexts that are cut, and their hashes."""

    def __init__(self, blob: bytes | None = None, *made: np.ndarray):
        if blob is not None:
            raw = _raw(blob)
            n, pairs, dishes, hot = np.frombuffer(raw, np.int64, 4).tolist()
            made = _unpack(raw, 32, (np.int32, n), (np.uint8, 8 * pairs), (np.int64, pairs), (np.uint8, 8 * dishes), (np.int64, hot), (np.int64, hot))
            made = (made[0], _sums(made[1]), made[2], _sums(made[3]), *made[4:])
        self.runs, self.w, self.c, self.dishes, self.hot, self.hashes = made
        self.u, self.n = np.repeat(np.arange(len(self.runs)), self.runs), len(self.runs)

    def blob(self) -> bytes:
        sizes = np.array([self.n, len(self.w), len(self.dishes), len(self.hot)])
        return _press(sizes, self.runs.astype(np.int32), _steps(self.w), self.c.astype(np.int64), _steps(self.dishes), self.hot.astype(np.int64), self.hashes.astype(np.int64))

    def per_context(self, x: np.ndarray, whole: dict[int, float]) -> np.ndarray:
        """Sums by context; whole: those of contexts that are cut, by hash."""
        out = np.bincount(self.u, x, self.n).astype(np.float64)
        out[self.hot] = [whole[h] for h in self.hashes.tolist()]
        return out

    def sweep(self, t: np.ndarray | None, seats: dict[int, float], weights: dict[int, float], parent: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
        """Tables of all pairs after one sweep, under a draw of the parent by dish. t: those before, None at first. seats, weights: the tables
        of contexts that are cut, and the gamma variables drawn for them."""
        g = rng.gamma(THETA / d + self.per_context(np.minimum(self.c, 1) if t is None else t, seats))
        g[self.hot] = [weights[h] for h in self.hashes.tolist()]
        pull = d * g[self.u] * parent[self.w]
        return reseat(self.c, first_tables(self.c, pull, d, rng) if t is None else t, pull, d, MOVES, rng)

    def predict(self, t: np.ndarray, seats: dict[int, float], customers: dict[int, float], parent: np.ndarray, d: float) -> np.ndarray:
        """Predictive probability of each pair under one seating and the parent's probabilities by dish."""
        total = THETA + self.per_context(self.c, customers)
        return (self.c - d * t) / total[self.u] + ((THETA + d * self.per_context(t, seats)) / total)[self.u] * parent[self.w]


def _logs(p: np.ndarray) -> np.ndarray:
    """Probabilities as 2-byte logarithms, steps of a 1024th of a power of two, down to 2^-63."""
    return np.round(-1024 * np.log2(np.clip(p, 2.0**-63, 1))).astype(np.uint16)


def _unlog(x: np.ndarray) -> np.ndarray:
    """Their logarithms to base 10."""
    return x * (-np.log10(2) / 1024)


def _press(*parts: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b"".join(p.tobytes() for p in parts))


def _raw(blob: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(blob)


def _planes(a: np.ndarray) -> np.ndarray:
    """The first bytes of all numbers, then the second ones and so on: they compress better."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).ravel()


def _whole(planes: np.ndarray, kind: type) -> np.ndarray:
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).ravel().view(kind)


def _steps(a: np.ndarray) -> np.ndarray:
    """8-byte numbers as planes of the steps between them, the sign in the lowest bit."""
    d = np.diff(a.astype(np.int64), prepend=0)
    return _planes(d << 1 ^ d >> 63)


def _sums(planes: np.ndarray) -> np.ndarray:
    d = _whole(planes, np.int64)
    return np.cumsum(d >> 1 ^ -(d & 1))


def _unpack(raw: bytes, at: int, *kinds: tuple[type, int]) -> list[np.ndarray]:
    """Arrays of these types and lengths, one after the other."""
    out = []
    for kind, n in kinds:
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    return out


def _wide(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """40-bit hashes of their low 32 and high 8 bits."""
    return low.astype(np.int64) | high.astype(np.int64) << 32


def _rows(made: list[tuple[int, str, int, bytes]]) -> pa.Table:
    return pa.table([pa.array(list(x), kind) for x, kind in zip(zip(*made, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.binary()), strict=True)], names=["to", "kind", "origin", "blob"])


def _blobs(t: pa.Table, kind: str) -> list[tuple[int, bytes]]:
    """(origin, blob) of the rows of a kind, by origin: rows come in any order, sums must not depend on it."""
    mine = t.filter(pc.equal(t.column("kind"), kind)).sort_by("origin")
    return list(zip(mine.column("origin").to_pylist(), mine.column("blob").to_pylist(), strict=True))


def pack(docs: DataFrame, shards: int, batch: int = BATCH) -> DataFrame:
    """From (doc_id, held, text): a row for each batch of documents (batch, ids, held, size, words, seq, cuts).

    words: sorted hashes of its words in order of shard (hash modulo shards), then their counts in training documents; seq: tokens of each document, then
    the numbers of all its tokens; cuts: how many words each shard has, then 8 bits of each word's hash, by which large contexts are cut. Every text is split once.
    """
    schema = "batch long, ids array<long>, held array<boolean>, size long, words binary, seq binary, cuts binary"

    def flush(number: int, part: pa.Table) -> pa.RecordBatch:
        from pandas.util import hash_array

        texts = pc.fill_null(part.column("text").combine_chunks(), "")
        found = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        parent, words = pc.list_parent_indices(found), pc.list_flatten(found)
        there = pc.not_equal(words, "")
        parent, words = parent.filter(there).to_numpy().astype(np.int64), words.filter(there).dictionary_encode()
        held = part.column("held").combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
        n = len(held)
        hashes = hash_array(np.array([*words.dictionary.to_pylist(), END], dtype=object), categorize=False)
        order = np.lexsort((hashes, hashes % np.uint64(shards)))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        size = np.bincount(parent, minlength=n) + 1
        ends = np.cumsum(size) - 1
        seq = np.empty(int(size.sum()), np.int64)
        on = np.ones(len(seq), bool)
        on[ends] = False
        seq[on], seq[ends] = place[words.indices.to_numpy()], place[-1]
        own = np.bincount(seq, np.repeat(~held, size), len(order))
        return pa.RecordBatch.from_arrays([
            pa.array([number]), pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([held.tolist()], pa.list_(pa.bool_())), pa.array([len(order)]),
            pa.array([_press(hashes[order], own.astype(np.int32))], pa.binary()), pa.array([_press(_planes(np.concatenate((size, seq)).astype(np.int32)))], pa.binary()),
            pa.array([_press(np.bincount((hashes % np.uint64(shards)).astype(np.int64), minlength=shards).astype(np.int32), (hashes[order] >> np.uint64(20)).astype(np.uint8))], pa.binary()),
        ], names=["batch", "ids", "held", "size", "words", "seq", "cuts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, kept, size = (TaskContext.get().partitionId() << 32), [], 0
        for b in batches:
            for at in range(0, len(b), 200):
                kept.append(b.slice(at, 200))
                size += pc.sum(pc.binary_length(kept[-1].column("text"))).as_py() or 0
                if size >= batch:
                    yield flush(number, pa.Table.from_batches(kept))
                    number, kept, size = number + 1, [], 0
                    release()
        if kept:
            yield flush(number, pa.Table.from_batches(kept))
        del kept
        release()

    return docs.select("doc_id", "held", "text").mapInArrow(run, schema)


class Batch:
    """A packed batch: hashes and training counts of its words, tokens, and its distinct pairs (context, word) in order."""

    def __init__(self, size: int, n_docs: int, words: bytes | None, seq: bytes | None, cuts: bytes | None = None, shards: int = 0):
        if cuts is not None:
            raw = _raw(cuts)
            self.shard, self.cut = np.repeat(np.arange(shards), np.frombuffer(raw, np.int32, shards)), np.frombuffer(raw, np.uint8, size, 4 * shards).astype(np.int64)
        if words is not None:
            raw = _raw(words)
            self.hashes, self.own = np.frombuffer(raw, np.uint64, size), np.frombuffer(raw, np.int32, offset=8 * size)
        if seq is not None:
            raw = _whole(np.frombuffer(_raw(seq), np.uint8), np.int32).astype(np.int64)
            self.size, self.seq = raw[:n_docs], raw[n_docs:]
            starts = np.cumsum(self.size) - self.size
            before = np.empty_like(self.seq)
            before[1:] = self.seq[:-1]
            before[starts] = self.seq[-1] if len(self.seq) else 0  # every text ends with END
            self.starts, self.pair = starts, before * size + self.seq
            self.words = size


def _spans(key: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's run starts in sorted shard numbers, and the end."""
    return np.searchsorted(key, np.arange(shards + 1))


def score(docs: DataFrame, held, seed: int = 11, batch: int = BATCH, shard: int = SHARD) -> DataFrame:
    """One row per row of (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    held: a boolean column; documents where it is false teach the model, all are scored over their whole lower-cased (A-Z) text: its words, then one end.
    score: log10 of the text's averaged predictive probability, base_score that of additive smoothing (0.1) of the training counts.
    Null and empty texts have the end only. Repeated rows count each; a null id stays null. No training document: every word
    is unknown. An empty table gives an empty table; other columns are ignored. Counts and base scores are exact (words stand for
    themselves by 64-bit hashes); the sampler is seeded.
    """
    spark = docs.sparkSession
    text_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(2, -(-text_bytes // shard))
    packed = spool(pack(docs.select("doc_id", held.alias("held"), "text"), shards, batch), "packed")

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for number, size, words in zip(*(rows.column(k).to_pylist() for k in range(3)), strict=True):
                b = Batch(size, 0, words, None)
                at = _spans((b.hashes % np.uint64(shards)).astype(np.int64), shards)
                blobs = [_press(b.hashes[x:y], b.own[x:y]) for x, y in zip(at, at[1:])]  # noqa: B905
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(shards)), pa.array(np.full(shards, number)), pa.array(np.diff(at)), pa.array(blobs, pa.binary())], names=["shard", "batch", "n", "blob"])

    def count_words(t: pa.Table) -> pa.Table:
        numbers, sizes = t.column("batch").to_pylist(), t.column("n").to_pylist()
        raws = [_raw(x) for x in t.column("blob").to_pylist()]
        hashes = np.concatenate([np.frombuffer(r, np.uint64, n) for r, n in zip(raws, sizes, strict=True)])
        own = np.concatenate([np.frombuffer(r, np.int32, offset=8 * n) for r, n in zip(raws, sizes, strict=True)])
        known, at = np.unique(hashes, return_inverse=True)
        c = np.bincount(at, own, len(known)).astype(np.int64)
        answers = np.split(c[at], np.cumsum(sizes)[:-1])
        counts, dishes = np.unique(c[c > 0], return_counts=True)
        hot = np.argsort(-c, kind="stable")[:8]
        stats = _press(np.array([len(counts), len(hot)]), counts, dishes, known[hot].view(np.int64), c[hot])
        n = len(numbers) + 1
        return pa.table({"batch": pa.array([*numbers, -1], pa.int64()), "shard": pa.array([t.column("shard")[0].as_py()] * n, pa.int64()), "kind": pa.array(["word"] * n), "blob": pa.array([*[_press(a) for a in answers], stats], pa.binary())})

    reply = "batch long, shard long, kind string, blob binary"
    asked = packed.select("batch", "size", "words").mapInArrow(ask_words, "shard long, batch long, n long, blob binary")
    words = spool(asked.groupBy("shard").applyInArrow(count_words, reply), "words")

    # by shard: its distinct counts (no more than the root of twice its tokens) and its 8 most frequent words
    every: dict[int, int] = {}
    frequent: list[tuple[int, int]] = []
    for row in words.where("batch = -1").select("blob").toLocalIterator():
        a = np.frombuffer(_raw(row[0]), np.int64)
        n, h = int(a[0]), int(a[1])
        for c, k in zip(a[2 : 2 + n].tolist(), a[2 + n : 2 + 2 * n].tolist(), strict=True):
            every[c] = every.get(c, 0) + k
        frequent += zip(a[2 + 2 * n : 2 + 2 * n + h].tolist(), a[2 + 2 * n + h :].tolist(), strict=True)
    counts = np.array(sorted(every), np.int64)
    tokens = Tokens(counts, np.array([every[c] for c in counts.tolist()], np.int64))
    total = tokens.total
    # contexts with over a quarter of a shard's tokens are cut: at most 4 * shards of them
    cuts = {h: (-(-c * 4 * shards // total), c) for h, c in frequent if c * 4 * shards > total}
    hot = spark.sparkContext.broadcast(cuts)

    def large(hashes: np.ndarray) -> dict[int, int]:
        return {int(k): min(n, shards, 256) for h, (n, _) in hot.value.items() for k in np.flatnonzero(hashes == np.array([h], np.int64).view(np.uint64)[0])}

    def pairs(b: Batch, large: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs in order, their shards, and the number of each token's pair. large: number of a context that is cut -> parts."""
        order = np.argsort(b.pair, kind="stable")
        found = b.pair[order]
        new = np.concatenate(([True], found[1:] != found[:-1]))[: len(found)]
        at = np.empty(len(found), np.int32)
        at[order] = np.cumsum(new, dtype=np.int32) - 1
        found = found[new]
        u, w = (found // b.words).astype(np.int32), (found % b.words).astype(np.int32)
        where = b.shard[u]
        for k, n in large.items():
            mine = slice(*np.searchsorted(u, (k, k + 1)))
            where[mine] = (where[mine] + b.cut[w[mine]] % n) % shards
        return u, w, where, at

    def ask_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i in range(len(rows)):
                size, held_, words_, seq, cuts_, number = (rows.column(k)[i].as_py() for k in range(6))
                b = Batch(size, len(held_), words_, seq, cuts_, shards)
                big = large(b.hashes)
                u, w, where, at = pairs(b, big)
                own = np.bincount(at, np.repeat(~np.array(held_, bool), b.size), len(u)).astype(np.int32)
                order = np.argsort(where, kind="stable")
                span = _spans(where[order], shards)
                # for the last step: which of the batch's contexts are cut
                marks = np.array([x for k in sorted(big) for x in (k, big[k])], np.int64)
                for s in range(shards):
                    mine = order[span[s] : span[s + 1]]
                    first = np.flatnonzero(np.concatenate(([True], u[mine][1:] != u[mine][:-1]))) if len(mine) else np.zeros(0, np.int64)
                    hu, hw = b.hashes[u[mine][first]] >> np.uint64(24), b.hashes[w[mine]] >> np.uint64(24)
                    low = lambda h: (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                    high = lambda h: (h >> np.uint64(32)).astype(np.uint8)
                    blob = _press(np.array([len(first), len(mine), len(marks)]), marks, low(hu), np.diff(np.append(first, len(mine))).astype(np.int32), own[mine], low(hw), high(hu), high(hw))
                    yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([number]), pa.array([blob], pa.binary())], names=["shard", "batch", "blob"])

    # the word restaurant's parts: so few that a part has about the words of several shards
    parts = max(2, -(-shards // 8))
    short = lambda h: int(np.array([h], np.int64).view(np.uint64)[0] >> np.uint64(24))
    customers = {short(h): float(c) for h, (_, c) in cuts.items()}

    def sent(x: Shard, shard: int, t: np.ndarray) -> list[tuple[int, str, int, bytes]]:
        """To each part, the tables of each of its dishes; to the driver, those of contexts that are cut and how many pairs have one and two customers."""
        tables, part = np.bincount(x.w, t, len(x.dishes)).astype(np.int64), x.dishes % parts
        out = [(p, "tally", shard, _press(np.array([int((part == p).sum())]), _steps(x.dishes[part == p]), tables[part == p])) for p in range(parts)]
        own = np.bincount(x.u, t, x.n).astype(np.int64)[x.hot]
        return [*out, (-1, "stats", shard, _press(np.array([int((x.c == 1).sum()), int((x.c == 2).sum()), len(own)]), x.hashes.astype(np.int64), own))]

    def gather(t: pa.Table) -> pa.Table:
        """A shard's pairs, and where each batch's pairs are among them."""
        shard, t = t.column("shard")[0].as_py(), t.sort_by("batch")
        numbers, sizes, us, ws, cs, marked = t.column("batch").to_numpy(), [], [], [], [], []
        for blob in t.column("blob"):
            raw = _raw(blob.as_py())
            n_u, n, n_marks = np.frombuffer(raw, np.int64, 3).tolist()
            marks, low_u, runs, c, low_w, high_u, high_w = _unpack(raw, 24, (np.int64, n_marks), (np.uint32, n_u), (np.int32, n_u), (np.int32, n), (np.uint32, n), (np.uint8, n_u), (np.uint8, n))
            us.append(np.repeat(_wide(low_u, high_u), runs))
            ws.append(_wide(low_w, high_w))
            cs.append(c)
            sizes.append(n)
            marked.append(marks)
        contexts, u = np.unique(np.concatenate(us), return_inverse=True)
        del us
        dishes, w = np.unique(np.concatenate(ws), return_inverse=True)
        del ws
        found, at = np.unique(u * len(dishes) + w, return_inverse=True)
        c = np.bincount(at, np.concatenate(cs), len(found)).astype(np.int64)
        hot = np.flatnonzero(np.isin(contexts, np.array(sorted(customers), np.int64)))
        x = Shard(None, np.bincount(found // max(1, len(dishes)), minlength=len(contexts)), found % max(1, len(dishes)), c, dishes, hot, contexts[hot])
        ask = _press(np.array([len(numbers), sum(map(len, marked)), len(at)]), numbers, np.array(sizes), np.array([len(m) for m in marked]), *marked, _steps(at))
        out = _rows([(shard, "pairs", shard, x.blob()), (shard, "ask", shard, ask), *sent(x, shard, np.minimum(c, 1))])
        del u, w, found, at, c, x
        release()
        return out

    def tallies(t: pa.Table) -> tuple[list[int], list[int], np.ndarray, np.ndarray]:
        """Shards, how many dishes each has, which these are among the part's dishes, and the customers of the part's dishes: the tables of all contexts."""
        shard, raws = zip(*((s, _raw(b)) for s, b in _blobs(t, "tally")), strict=True)
        sizes = [int(np.frombuffer(r, np.int64, 1)[0]) for r in raws]
        own = [_unpack(r, 8, (np.uint8, 8 * n), (np.int64, n)) for r, n in zip(raws, sizes, strict=True)]
        known, at = np.unique(np.concatenate([_sums(h) for h, _ in own]), return_inverse=True)
        return list(shard), sizes, at, np.bincount(at, np.concatenate([n for _, n in own]), len(known)).astype(np.int64)

    def spread(t: pa.Table) -> pa.Table:
        *_, c = tallies(t)
        n, dishes = np.unique(c[c > 0], return_counts=True)
        return _rows([(-1, "spread", t.column("to")[0].as_py(), _press(n, dishes))])

    def replies(words, k: int):
        def reply(t: pa.Table) -> pa.Table:
            part = t.column("to")[0].as_py()
            shard, sizes, at, c = tallies(t)
            draw = words.value.draw(c, np.random.default_rng([seed, k, part]))
            ends = np.cumsum(sizes)[:-1]
            return _rows([(s, "reply", part, _press(np.array([draw.sum()]), x, y)) for s, x, y in zip(shard, np.split(c[at], ends), np.split(draw[at].astype(np.float32), ends), strict=True)])

        return reply

    def seated(t: pa.Table, words: Words) -> tuple[Shard, list[np.ndarray], list[np.ndarray], np.ndarray]:
        """A shard's pairs, its tables after each sweep that is averaged (and the last), the parent's probabilities by dish with each, and a draw of the parent."""
        x = Shard(_blobs(t, "pairs")[0][1])
        c, draw, mass = np.zeros(len(x.dishes), np.int64), np.zeros(len(x.dishes)), words.fresh
        for part, blob in _blobs(t, "reply"):
            raw, mine = _raw(blob), np.flatnonzero(x.dishes % parts == part)
            m, c[mine], draw[mine] = _unpack(raw, 0, (np.float64, 1), (np.int64, len(mine)), (np.float32, len(mine)))
            mass += float(m[0])
        tables, parents = [], []
        for _, blob in _blobs(t, "state"):
            raw = _raw(blob)
            n, m = np.frombuffer(raw, np.int64, 2).tolist()
            arrays = _unpack(raw, 16, *[(np.int64, len(x.w))] * n, *[(np.float32, len(x.dishes))] * m)
            tables, parents = arrays[:n], arrays[n:]
        return x, tables, [*parents, words.p(c).astype(np.float32)], (draw + words.fresh / (words.distinct + 1)) / mass

    def sweeps(words, k: int, d: float, seats: dict[int, float], weights: dict[int, float]):
        def sweep(t: pa.Table) -> pa.Table:
            shard = t.column("to")[0].as_py()
            x, tables, parents, parent = seated(t, words.value)
            new = x.sweep(tables[-1] if tables else None, seats, weights, parent, d, np.random.default_rng([seed, k, shard, 1]))
            if k <= BURN_IN:  # the seatings before are not averaged
                tables, parents = [], []
            return _rows([(shard, "state", shard, _press(np.array([len(tables) + 1, len(parents)]), *tables, new, *parents)), *sent(x, shard, new)])

        return sweep

    def answers_of(words, d: float, seats: list[dict[int, float]]):
        def answer(t: pa.Table) -> pa.Table:
            shard = t.column("to")[0].as_py()
            x, tables, parents, _ = seated(t, words.value)
            p = _logs(sum(x.predict(y, s, customers, z, d) for y, s, z in zip(tables, seats, parents, strict=True)) / len(tables))
            raw = _raw(_blobs(t, "ask")[0][1])
            n, m, asked = np.frombuffer(raw, np.int64, 3).tolist()
            numbers, sizes, n_marks, marks, at = _unpack(raw, 24, (np.int64, n), (np.int64, n), (np.int64, n), (np.int64, m), (np.uint8, 8 * asked))
            cut = lambda a, by: np.split(a, np.cumsum(by)[:-1])
            blobs = [_press(np.array([len(y)]), y, z) for y, z in zip(cut(marks, n_marks), cut(p[_sums(at)], sizes), strict=True)]
            del x, tables, parents, p, at
            release()
            return pa.table({"batch": pa.array(numbers, pa.int64()), "shard": pa.array([shard] * n, pa.int64()), "kind": pa.array(["pair"] * n), "blob": pa.array(blobs, pa.binary())})

        return answer

    flow = "to long, kind string, origin long, blob binary"
    of_kind = lambda x, kind: x.where(F.col("kind") == kind).select("to", "kind", "origin", "blob")
    asked = packed.select("size", "held", "words", "seq", "cuts", "batch").mapInArrow(ask_pairs, "shard long, batch long, blob binary")
    last = made = spool(asked.groupBy("shard").applyInArrow(gather, flow), "pairs", "kind")
    rng, d, seats = np.random.default_rng([seed, 2]), 0.0, []
    for k in range(SWEEPS + 1):
        # a part's distinct numbers of customers, no more than the root of twice its customers; a shard's contexts that are cut
        found: dict[int, int] = {}
        spreads = spool(of_kind(last, "tally").groupBy("to").applyInArrow(spread, flow), "spread", "kind")
        for row in spreads.select("blob").toLocalIterator():
            for c, n in zip(*np.frombuffer(_raw(row[0]), np.int64).reshape(2, -1).tolist(), strict=True):
                found[c] = found.get(c, 0) + n
        counts = np.array(sorted(found), np.int64)
        parent = spark.sparkContext.broadcast(Words(counts, np.array([found[c] for c in counts.tolist()], np.int64), seed + k))
        stats = [np.frombuffer(_raw(r[0]), np.int64) for r in of_kind(last, "stats").select("blob").toLocalIterator()]
        d = d or discount(sum(int(x[0]) for x in stats), sum(int(x[1]) for x in stats))
        seats.append(dict.fromkeys(sorted(customers), 0.0))
        for x in stats:
            for h, n in zip(*x[3:].reshape(2, -1).tolist(), strict=True):
                seats[-1][h] += n
        weights = {h: float(rng.gamma(THETA / d + n)) for h, n in seats[-1].items()}
        rows = of_kind(last, "tally").groupBy("to").applyInArrow(replies(parent, k), flow).unionAll(of_kind(made, "pairs"))
        if k:
            rows = rows.unionAll(of_kind(last, "state"))
        if k < SWEEPS:
            before, last = last, spool(rows.groupBy("to").applyInArrow(sweeps(parent, k, d, seats[-1], weights), flow), "sweep", "kind")
            if k:
                unspool(before)
    predicted = spool(rows.unionAll(of_kind(made, "ask")).groupBy("to").applyInArrow(answers_of(parent, d, seats[BURN_IN + 1 :]), reply), "predicted", "kind").select("batch", "shard", "kind", "blob")
    unspool(last)
    unspool(made)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        row = {k: left.column(k)[0].as_py() for k in left.column_names}
        ids, held_ = row["ids"], row["held"]
        b = Batch(row["size"], len(ids), None, row["seq"], row["cuts"], shards)
        answers = {(k, s): x for k, s, x in zip(right.column("kind").to_pylist(), right.column("shard").to_pylist(), right.column("blob").to_pylist(), strict=True)}
        c = np.concatenate([np.frombuffer(_raw(answers["word", s]), np.int64) for s in range(shards)])
        answered = [_raw(answers["pair", s]) for s in range(shards)]
        marks = np.frombuffer(answered[0], np.int64, int(np.frombuffer(answered[0], np.int64, 1)[0]), 8).tolist()
        u, _, where, at = pairs(b, dict(zip(marks[::2], marks[1::2], strict=True)))
        order = np.argsort(where, kind="stable")
        span = _spans(where[order], shards)
        good = np.zeros(len(u))
        for s in range(shards):
            good[order[span[s] : span[s + 1]]] = _unlog(np.frombuffer(answered[s], np.uint16, offset=8 + 8 * len(marks)))
        of = lambda x: np.add.reduceat(x, b.starts)
        return pa.table({
            "doc_id": pa.array(ids, pa.int64()), "held_out": pa.array(held_, pa.bool_()), "n_tokens": pa.array(b.size), "n_known": of((c > 0).astype(np.int64)[b.seq]),
            "base_score": of(tokens.base(c)[b.seq]), "score": of(good[at]),
        })

    answers = words.where("batch >= 0").unionAll(predicted).select(F.col("batch").alias("to"), "shard", "kind", "blob")
    out = packed.drop("words").groupBy("batch").cogroup(answers.groupBy("to")).applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def perplexity(scored: DataFrame) -> DataFrame:
    """Per token, of the model and of the base: one row for held-out and one for training documents."""
    per = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(per("score").alias("perplexity"), per("base_score").alias("base_perplexity"))
