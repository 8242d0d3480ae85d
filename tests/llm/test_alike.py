"""The near-duplicate stage against exact Jaccard similarities of all pairs."""

import re
from itertools import combinations

import numpy as np
import pytest
from test_documents import empty, odd

from larkspan.llm import alike

LOWER = {c: c + 32 for c in range(65, 91)}


def brute_sets(texts, k=5):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        out.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    return out


def brute(ids, texts, similarity=0.8):
    """Smallest id of each row's component."""
    sets = brute_sets(texts)
    low = list(range(len(ids)))

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for i, j in combinations(range(len(ids)), 2):
        both = len(sets[i] & sets[j])
        if both >= similarity * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((find(i), find(j)), key=lambda x: ids[x])
            low[b] = a
    return [ids[find(i)] for i in range(len(ids))]


def check(spark, rows):
    """Components of rows (doc_id, text) by alike() and by all pairs."""
    got = {r["doc_id"]: r["component_id"] for r in alike.alike(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    rows = sorted(rows)
    want = dict(zip([r[0] for r in rows], brute([r[0] for r in rows], [r[1] for r in rows])))
    wrong = [k for k in want if got[k] != want[k]]
    assert not wrong, (len(wrong), len(want))
    return got


def test_tables(spark, data):
    """All documents of the small table, short ones included."""
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    got = check(spark, rows)
    assert len(set(got.values())) < len(got)


def test_short_texts(spark):
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(250):
        w = [f"w{x}" for x in rng.integers(0, 300, rng.integers(12, 70))]
        rows.append(w)
        rows.append([f"x{rng.integers(300)}", *w[1:]] if rng.random() < 0.5 else [*w, *(f"x{x}" for x in rng.integers(0, 300, rng.integers(1, 4)))])
    got = check(spark, [(i, " ".join(w)) for i, w in enumerate(rows)])
    assert len(set(got.values())) < 350


def test_families(spark):
    """A large family of near copies, one that drifts step by step, and pairs just under and over the similarity."""
    rng = np.random.default_rng(6)
    rows = []
    base = [f"a{x}" for x in rng.integers(0, 3000, 300)]
    for _ in range(150):
        v = list(base)
        for at in rng.choice(300, 3, replace=False):
            v[at] = f"edit{rng.integers(1 << 30)}"
        rows.append(v)
    v = [f"b{x}" for x in rng.integers(0, 3000, 300)]
    for _ in range(120):
        v = list(v)
        v[rng.integers(300)] = f"step{rng.integers(1 << 30)}"
        rows.append(v)
    for _ in range(60):
        v = [f"c{x}" for x in rng.integers(0, 3000, 200)]
        rows.append(v)
        v = list(v)
        for at in rng.choice(200, rng.integers(3, 7), replace=False):
            v[at] = f"edit{rng.integers(1 << 30)}"
        rows.append(v)
    check(spark, [(int(i), " ".join(rows[k])) for k, i in enumerate(rng.permutation(len(rows)))])


def test_sets_and_prints():
    import pyarrow as pa

    texts = ["a b c d e f", "a b c", None, "", " \t a  b\x0bc d e f \n", "x " * 100_000, "one"]
    got = alike.shingle_sets(pa.array(texts), 5)
    assert [len(x) for x in got] == [len(x) for x in brute_sets(texts)]
    assert got[0].tolist() == got[4].tolist()
    t = alike.Texts(pa.array(texts))
    prints = t.print_of_words()
    import xxhash

    for text, p in zip(texts, prints.tolist()):
        w = set((text or "").split())
        h = [xxhash.xxh64_intdigest(x, 42) for x in w]
        h = [x ^ x >> 29 for x in h]
        assert p & (1 << 64) - 1 == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    x, n = t.shingles(5)
    sketch, bands = alike.minhashes(x, n)
    orders = alike._orders()
    at = np.concatenate(([0], np.cumsum(n)))
    for i in range(len(texts)):
        least = [min((int(v) * int(o) & (1 << 64) - 1 for v in set(x[at[i] : at[i + 1]].tolist())), default=0) for o in orders]
        assert int(sketch[i]) & (1 << 64) - 1 == sum((m >> 9 & 1) << b for b, m in enumerate(least[:64]))
    assert bands[0].tolist() == bands[4].tolist() and bands.shape == (len(texts), alike.BANDS)
    assert all(len(y) == 0 for y in (*alike.minhashes(*alike.Texts(pa.array([], pa.string())).shingles(5)), alike.Texts(pa.array([], pa.string())).print_of_words()))


def test_odd(spark):
    d = odd(spark)
    kept = alike.keep_one(d)
    assert kept.columns == d.columns and sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect() if r["doc_id"] is not None) == [(False, k) for k in (1, 2, 5, 6, 7)]
    assert kept.count() == 6 and alike.keep_one(empty(spark)).count() == 0


@pytest.mark.parametrize("rows, want", [
    ([(3, "A"), (5, "A"), (5, "B")], {(3, "A"), (5, "B")}),
    ([(None, "A"), (4, "a"), (None, "C")], {(4, "a"), (None, "C")}),
    ([(1, "x y"), (1, "X y"), (1, "z")], {(1, "x y"), (1, "z")}),
])
def test_repeated_ids(spark, rows, want):
    """No text is lost because rows share an id."""
    kept = {(r[0], r[1]) for r in alike.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(i, t.lower()) for i, t in kept} == {(i, t.lower()) for i, t in want} and len(kept) == len(want)


def test_dealt_keys_are_not_broadcast(spark, tmp_path):
    """Spark sizes the dealt keys by the few bytes of the texts they are made of."""
    spark.range(100).selectExpr("xxhash64(id) as body", "id as fp", "id as sketch", "binary(repeat('a', 192)) as bands", "id as root").write.parquet(str(tmp_path / "texts"))
    plan = alike._first_edges(spark.read.parquet(str(tmp_path / "texts")))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
