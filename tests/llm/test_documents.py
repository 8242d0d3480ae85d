"""Operators on documents: brute force, nulls, empties, repeats, ties, other columns of clashing names."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspan.llm import chat, language, lines, mixing, pieces, pitmanyor, queries_b, simhash
from larkspan.llm.shared import stars

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, out long, mix_copies long, c0 string, row string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def odd(spark):
    """Null, empty and long texts, null ids, sources and languages, repeated rows, columns called like an operator's own."""
    long = "word " * 30_000
    base = [(1, "the cat of the house and the dog", "en", "a"), (1, "the cat of the house and the dog", "en", "a"), (2, None, None, None), (3, "", "en", "b"), (None, "der hund und die katze", "de", "a"), (5, long, "en", "b"), (6, "123 456 \n\n ?", None, None), (7, " \t\v\f\x1c\x85x\xa0y", "de", "b")]
    return spark.createDataFrame([(i, t, g, s, len(t or ""), 7, 8, "c", "r") for i, t, g, s in base], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def keep(df, *names):
    return sorted([tuple(r) for r in df.select(*names).collect()], key=str)


def test_stars(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5), (8, 7), (3, 1), (3, 1)], "a long, b long")
    assert keep(stars(e), "a", "root") == [(1, 1), (2, 1), (3, 1), (7, 7), (8, 7), (9, 7)]
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert stars(chain).agg(F.max("root"), F.count("*")).first()[:] == (0, 201)
    assert stars(e.where("false")).count() == 0


# language


def test_language_accuracy(spark, data):
    got = queries_b.op4_language_id(spark, data).join(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.95


def test_language_brute(spark):
    text = "Über den Häusern, 3 the end the"
    keys, n = language.grams(text)
    flat = re.sub(r"[^a-zäöüß]+", " ", text.lower()).strip()
    want = Counter(flat.replace(" ", ""))
    padded = f" {flat} "
    want.update(padded[i : i + 2] for i in range(len(padded) - 1))
    want.update(padded[i : i + 3] for i in range(len(padded) - 2) if padded[i + 1] != " ")
    pack = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    assert dict(zip(keys.tolist(), n.tolist())) == {pack(g): c for g, c in want.items()}


def test_language_odd(spark):
    d = odd(spark)
    p = language.fit(d.select("doc_id", "text", "lang"))
    got = language.identify(d, p)
    assert got.columns == [*d.columns, "lang_pred", "lang_score"] and got.count() == 8
    assert {r["lang_pred"] for r in got.where("doc_id in (2, 3, 6)").collect()} == {"und"}
    assert got.where("lang_score < 0 or lang_score > 1").count() == 0
    assert {r["lang_pred"] for r in language.identify(d, {}).collect()} == {"und"}
    assert language.identify(empty(spark), p).count() == 0 and language.fit(empty(spark).select("doc_id", "text", "lang")) == {}


# lines


def test_lines(spark):
    rows = []
    for i in range(12):
        rows.append((i, f"unique words number {chr(97 + i)} stay here\nRead {i} more stories on our site today\nanother {chr(97 + i) * 3} ending line"))
    copies = [(100 + i, "first line of a copy\nsecond line of a copy\nthird line of a copy") for i in range(6)]
    d = spark.createDataFrame(rows + copies + [(None, None), (50, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lines.drop_lines(d).collect()}
    assert all(got[i]["text"] == rows[i][1].split("\n")[0] + "\n" + rows[i][1].split("\n")[2] and got[i]["lines_dropped"] == 1 for i in range(12))
    assert all(got[100 + i]["lines_dropped"] == 0 for i in range(6))  # copies go as documents, not line by line
    assert got[None]["text"] is None and got[50]["text"] == ""


def test_lines_generalise(spark):
    """A field without digits is found by the tree: lines of a leaf differ in one position."""
    names = "anna bert cleo dora emil fritz".split()
    d = spark.createDataFrame([(i, f"a{n} own words\nWritten by our author {n} for the daily paper\nz{n} more words") for i, n in enumerate(names)], "doc_id long, text string")
    assert {r["lines_dropped"] for r in lines.drop_lines(d).collect()} == {1}


def test_lines_footer_and_copies(spark):
    """All lines of a footer go, on short texts too and where a large group of copies or near copies has it; the lines of the copies stay."""
    rng = np.random.default_rng(4)
    own = lambda n: ["".join(rng.choice(list("abcdefghij"), 6)) + " own words of line " + "".join(rng.choice(list("klmnop"), 9)) for _ in range(n)]
    footer = ["Read all the news of the day", "Terms and conditions", "Made in town"]
    body = own(12)
    rows = [own(5) + footer for _ in range(10)]
    for k in range(300):
        v = list(body)
        v[k % 12] += f" edit{k}" if k % 2 else f" {chr(97 + k % 26)} {chr(97 + k // 26)}"
        rows.append((v if k > 60 else body) + footer)
    other = ["Share this page with friends", "All rights are kept", "Write to us"]
    rows += [own(2) + other for _ in range(8)]
    d = spark.createDataFrame([(i, "\n".join(r)) for i, r in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lines.drop_lines(d).collect()}
    assert all(got[i]["text"] == "\n".join(r[:-3]) and got[i]["lines_dropped"] == 3 for i, r in enumerate(rows))


def brute_lines(docs, depth=3, agree=0.6, least=6, n_docs=4, share=0.5):
    """Texts without the lines of recurring templates, by plain Python over (id, text) without nulls."""
    def mask(line):
        line = re.sub(" {2,}", " ", line.translate({9: 32, 13: 32, 12: 32, 11: 32}))
        return " ".join("<*>" if re.search("[0-9]", w) else w for w in line.split(" ")).strip(" ")

    texts = sorted({t for _, t in docs})
    own = {t: [m for m in map(mask, t.split("\n")) if m] for t in texts}
    leaf = lambda m: (m.count(" "), " ".join(m.split(" ")[:depth]))
    in_leaf = Counter(f for t in texts for f in {leaf(m) for m in own[t]})
    half, some = {}, {}
    for t in texts:
        n = sorted(in_leaf[leaf(m)] for m in own[t])
        if n:
            half[t], some[t] = 1 / n[int(len(n) * 0.5)], 1 / n[int(len(n) * 0.2)]
    has = {}
    for t in texts:
        for m in own[t]:
            has.setdefault(m, set()).add(t)

    def recurs(lines_, general):
        of = set().union(*(has[m] for m in lines_))
        h, s = sum(half[t] for t in of), sum(some[t] for t in of)
        return h >= n_docs - 1e-6 or not general and s >= n_docs - 1e-6 and s >= share * len(of) - 1e-6

    general = set()

    def down(lines_):
        if len(lines_) < 2 or not recurs(lines_, True):
            return
        words = {m: m.split(" ") for m in lines_}
        size = len(words[lines_[0]])
        if size < least:
            return
        main = [min(Counter(w[p] for w in words.values()).items(), key=lambda x: (-x[1], x[0]))[0] for p in range(size)]
        near = [m for m in lines_ if sum(a == b for a, b in zip(words[m], main)) / size >= agree]
        if len(near) > 1 and recurs(near, True):
            general.update(near)
            lines_ = [m for m in lines_ if m not in set(near)]
        kinds = [len({words[m][p] for m in lines_}) for p in range(size)]
        at = min((k, p) for p, k in enumerate(kinds) if k > 1)[1] if lines_ and max(kinds) > 1 else None
        if at is not None:
            for w in sorted({words[m][at] for m in lines_}):
                down([m for m in lines_ if words[m][at] == w])

    by_leaf = {}
    for m in has:
        by_leaf.setdefault(leaf(m), []).append(m)
    for found in by_leaf.values():
        down(sorted(found))
    gone = general | {m for m in has if m not in general and recurs([m], False)}
    return {(i, t): "\n".join(x for x in t.split("\n") if mask(x) not in gone) for i, t in docs}


def test_lines_brute(spark, data):
    """The tree against plain Python on all documents of the small table, with mixed leaves and footers planted."""
    rng = np.random.default_rng(9)
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect() if r[1]]
    names = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(40)]
    for i in range(60):
        kind = ("Shared by our reader {} on site today now", "Shared by our {} shop in old town {}", "Shared by our team of {} and more people")[i % 3]
        docs.append((5000 + i, f"own {names[i % 40]} text {'x' * i}\n" + kind.format(*rng.choice(names, 2)) + f"\nlast {names[-i % 40]} words {'y' * i}"))
    docs += [(6000 + i, f"Shared by our {' '.join(rng.choice(names, 5))}") for i in range(5)]
    got = {(r["doc_id"], r["old"]): r["text"] for r in lines.drop_lines(spark.createDataFrame([(i, t, t) for i, t in docs], "doc_id long, text string, old string")).collect()}
    want = brute_lines(docs)
    assert got == want
    assert any(v != k[1] for k, v in want.items() if k[0] < 5000)


def test_lines_mixed_leaf(spark):
    """Strays in a leaf do not save a template, and a leaf can hold two."""
    rng = np.random.default_rng(2)
    names = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(200)]
    rows = [(i, f"u{names[i]}a own words\nShared by our reader {names[i]} on site today now\nv{names[i]} more") for i in range(60)]
    rows += [(100 + i, f"u{names[i + 60]} own words\nShared by our {names[i + 60]} shop of the town\nv{names[i + 60]}b more of it") for i in range(40)]
    rows += [(200 + i, f"u{names[i + 120]} words\nShared by our {' '.join(names[i + 130 : i + 135])}\nv{names[i + 120]}b more c") for i in range(5)]
    got = {r["doc_id"]: r["lines_dropped"] for r in lines.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(n == (1 if i < 200 else 0) for i, n in got.items())


def test_lines_odd(spark):
    d = odd(spark)
    got = lines.drop_lines(d)
    assert got.columns == [*d.columns, "lines_dropped"]
    assert keep(got, *d.columns) == keep(d, *d.columns)
    assert lines.drop_lines(empty(spark)).count() == 0


# simhash


def brute_print(text, k):
    import xxhash

    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    s = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_fingerprints(spark, data):
    texts = [r[0] for r in spark.read.parquet(f"{data}/documents.parquet").select("text").limit(40).collect()] + [None, "", "One", "ONE two", "a b c", "a\x1cb\x85c \x0bd"]
    lowered = [t and t.translate({c: c + 32 for c in range(65, 91)}) for t in texts]
    for k in (3, 5):
        assert simhash.fingerprints(lowered, k).tolist() == [brute_print(t, k) for t in texts]


def test_golay():
    near, every, n = simhash._tables()
    assert sorted(set(n.tolist())) == [1, 6]
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, rng.integers(0, 4), replace=False):
            b[i] ^= np.uint64(1 << int(bit))
    k, r, _, _ = simhash.keys(a)
    _, _, q, s = simhash.keys(b)
    index = set(zip(k.tolist(), r.tolist()))
    assert {y for x, y in zip(q.tolist(), s.tolist()) if (x, y) in index} == set(range(len(a)))


def test_simhash_brute(spark, data):
    d = spark.read.parquet(f"{data}/documents.parquet")
    got = simhash.groups(d).toPandas()
    fp = got["fp"].to_numpy().astype(np.int64).view(np.uint64)
    link = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3
    ids = got["doc_id"].to_numpy()
    low = ids.copy()
    while True:
        new = np.where(link, low[None, :], ids.max()).min(1)
        if (new == low).all():
            break
        low = new
    assert low.tolist() == got["component_id"].tolist()


def test_simhash_odd(spark):
    d = odd(spark)
    got = {r["doc_id"]: r for r in simhash.groups(d).collect()}
    assert simhash.groups(d).count() == 8
    assert got[2]["fp"] == got[3]["fp"] == 0 and got[3]["component_id"] == 2 and got[1]["component_id"] == 1
    assert simhash.groups(empty(spark)).count() == 0


def test_simhash_keys_are_not_broadcast(spark, tmp_path):
    """Few bytes of fingerprints become a hundred times as many of keys, which Spark does not see."""
    spark.range(1000).selectExpr("xxhash64(id) as fp").write.parquet(str(tmp_path / "prints"))
    plan = simhash.links(spark.read.parquet(str(tmp_path / "prints")))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


# mixing


def brute_targets(size):
    names = sorted([s for s in size if s is not None]) + [s for s in size if s is None]
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = sum(size.values()), set()
    while True:
        rest = total - sum(3 * size[s] for s in full)
        free = [s for s in names if s not in full]
        got = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if got[s] > 3 * size[s]}
        if not over:
            return {s: got.get(s, 3.0 * size[s]) for s in names}
        full |= over


def test_mix(spark, data):
    d = spark.read.parquet(f"{data}/documents.parquet").unionByName(spark.createDataFrame([(10**6 + i, "w " * (i + 1), "en", "aaa" if i < 3 else None, 2) for i in range(6)], "doc_id long, text string, lang string, source string, n_chars long"))
    m = mixing.mix(d).toPandas()
    words = [len(WORD.findall(t or "")) for t in m["text"]]
    assert m["mix_size"].tolist() == words
    size = Counter()
    for s, n in zip(m["source"].where(m["source"].notna(), None), words):
        size[s if isinstance(s, str) else None] += n
    want = brute_targets(size)
    taken, biggest = Counter(), Counter()
    for s, n, t, c, own in zip(m["source"], words, m["mix_target"], m["mix_copies"], m["mix_source_size"]):
        s = s if isinstance(s, str) else None
        assert own == size[s] and abs(t - want[s]) <= 1e-6 * max(1, want[s]) and 0 <= c <= 3
        taken[s] += c * n
        biggest[s] = max(biggest[s], n)
    assert all(abs(taken[s] - want[s]) <= 2 * biggest[s] + 1 for s in size)
    again = mixing.mix(d.repartition(3)).toPandas()
    assert sorted(zip(m["doc_id"], m["mix_copies"])) == sorted(zip(again["doc_id"], again["mix_copies"]))


def test_mix_odd(spark):
    d = odd(spark)
    got = mixing.mix(d)
    assert got.count() == 8 and got.columns == [*[c for c in d.columns if c != "mix_copies"], "mix_size", "mix_source_size", "mix_target", "mix_copies"]
    assert mixing.copies(d).columns == d.columns
    assert mixing.mix(empty(spark)).count() == 0 and mixing.copies(empty(spark)).count() == 0


# pieces


def test_pieces_parity(spark, data):
    d = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, "a  b\n\n ▁c \U0001f600 \x00 é"), (-2, " lead"), (-3, ""), (-4, None), (-5, "▁"), (-6, "\n x\n\n  y \n"), (-7, "tail \t  "), (-8, "a\x1fb  c"), (-9, "</s> <s>[INST] <0x0A>")], "doc_id long, text string"))
    for every in (1, 1 << 40):  # each text whole; unit by unit only
        got = pieces.encode(d, check_every=every)
        assert got.where("text is not null and not parity").count() == 0
    import sentencepiece

    judge = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert all(r["ids"] == judge.encode(r["text"]) for r in got.where("text is not null").collect())
    assert got.where("doc_id >= 0 and not decoded_ok").count() == 0
    r = {x["doc_id"]: x for x in got.where("doc_id < 0").collect()}
    assert r[-4]["ids"] is None and r[-4]["parity"] is None and r[-3]["ids"] == [] and r[-3]["decoded_ok"] and r[-2]["decoded_ok"]
    back = pieces.decode(got)
    assert back.where("doc_id <> -1 and doc_id <> -5 and not (text <=> decoded)").count() == 0


def test_pieces_query_parity(spark, data):
    """Every text of the query and of the stage has a parity value."""
    import corpus_pipeline

    from larkspan.llm import queries_c

    docs = spark.read.parquet(f"{data}/documents.parquet")
    for got in (queries_c.QUERIES["op2_pieces"](spark, data), corpus_pipeline.encode(spark, docs, data)):
        assert got.where("parity is null and n_pieces is not null or not parity").count() == 0


def test_pieces_unigram(spark):
    """A unigram model written by hand: scores, byte fallback and normaliser flags come from its protobuf."""
    import struct

    def field(n, b):
        return bytes([n << 3 | 2, *([len(b)] if len(b) < 128 else [len(b) & 127 | 128, len(b) >> 7])]) + b

    def piece(p, score, kind):
        return field(1, field(1, p.encode()) + bytes([2 << 3 | 5]) + struct.pack("<f", score) + bytes([3 << 3, kind]))

    raw = piece("<unk>", 0, 2) + b"".join(piece(f"<0x{i:02X}>", 0, 6) for i in range(256))
    raw += b"".join(piece(p, s, 1) for p, s in (("▁ab", -1.0), ("▁a", -2.0), ("b", -2.5), ("▁", -3.0), ("a", -3.5), ("abc", -4.0), ("c", -5.0)))
    raw += field(2, bytes([3 << 3, 1]) + bytes([(35 << 3 & 127) | 128, 35 >> 4, 1])) + field(3, bytes([3 << 3, 1, 4 << 3, 0, 5 << 3, 1]))
    m = pieces.Model.parse(raw)
    assert m.kind == pieces.UNIGRAM and m.byte_fallback and not m.squeeze and m.pieces[257] == ("▁ab", -1.0, 1)
    import sentencepiece

    judge = sentencepiece.SentencePieceProcessor(model_proto=raw)
    coder = pieces.Coder(raw)
    texts = ["ab abc", "a  b", "é ab", "", "cab", "\na\n\nab ", " a", "▁a b", "a\x1fb c"]
    ids, n, ok, same = coder.encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [judge.encode(t) for t in texts]
    assert same.all() and ok.tolist() == ["▁" not in t for t in texts]
    assert all(len(x) == 0 for x in coder.encode(pa.array([], pa.string())))


def test_units_are_learned_once_by_a_coder(monkeypatch):
    """Later batches learn only units that earlier ones had not, and get the same as from a coder of their own; so too where few units are kept."""
    raw = open(pieces.MODEL, "rb").read()
    batches = [pa.array(["a new house\nand more", "", "\ud55c odd\u2581mark"]), pa.array(["more new \ud55c\n houses", "a  house\n\n"]), pa.array([], pa.string()), pa.array(["a new house"])]
    for kept in (pieces.KEPT, 6):
        monkeypatch.setattr(pieces, "KEPT", kept)
        coder, learned, learn = pieces.Coder(raw), [], pieces.Coder.learn
        monkeypatch.setattr(coder, "learn", lambda units: learned.extend(units.to_pylist()) or learn(coder, units))
        for texts in batches:
            for x, y in zip(coder.encode(texts), pieces.Coder(raw).encode(texts), strict=True):
                assert x.tolist() == y.tolist()
        assert kept == 6 or len(learned) == len(set(learned)) > 5


def test_texts_checked_whole_are_not_checked_by_units_too():
    """Where every text is checked whole, sentencepiece sees each text once, one at a time, and no units; ids and both checks are those of units and texts, and a wrong id is found."""
    raw = open(pieces.MODEL, "rb").read()
    batches = [pa.array(["a new house\nand more", "", " \ud55c odd\u2581mark", "\u2581", "a\x1fb  c\x00", "tail \n\n \U0001f600"]), pa.array(["more new \ud55c\n houses"]), pa.array([], pa.string())]
    coder, seen = pieces.Coder(raw, judged=False), []
    judge = coder.judge

    class Judge:
        def encode(self, given, **how):
            seen.append(given)
            return judge.encode(given, **how)

    coder.judge = Judge()
    for texts in batches:
        asked = np.ones(len(texts), bool)
        for x, y in zip(coder.encode(texts, asked), pieces.Coder(raw).encode(texts, asked), strict=True):
            assert x.tolist() == y.tolist()
    assert seen == [t for texts in batches for t in texts.to_pylist()]
    # units that nobody has judged never count as right: their texts are checked whole, asked or not
    seen.clear()
    assert coder.encode(pa.array(["a new house"]))[3].all() and seen == ["a new house"]
    coder.kept[1][:] += 1
    ids, n, ok, same = coder.encode(pa.array(["a new house", "more"]), np.ones(2, bool))
    assert not ok.any() and not same.any()


def test_pieces_decoded_as_by_the_library():
    """The decoder of the checks gives what the one of the tokenizer gives."""
    coder = pieces.Coder(open(pieces.MODEL, "rb").read())
    texts = ["", " ", "a  b\n\n \u2581c \U0001f600 \x00 \u00e9", "\u2581", "\u2581\u2581 x", " lead", "tail \t ", "</s> <0xE2><0x96><0x81>", "\u2580\u2582 \u0000\ud55c\u2581\U0001f600"]
    found = [coder.tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert coder.back.decode_batch(found, skip_special_tokens=False) == coder.tok.decode_batch(found, skip_special_tokens=False)


def test_pieces_odd(spark):
    d = odd(spark)
    got = pieces.encode(d)
    assert got.columns == [*d.columns, "ids", "n_pieces", "decoded_ok", "parity"] and got.count() == 8
    assert pieces.encode(empty(spark)).count() == 0


# scoring


def crc(i):
    return zlib.crc32(str(i).encode())


def test_scores(spark, data):
    d = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 2, " A\x1cb \x85")], "doc_id long, text string"))
    got = pitmanyor.score(d, F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)) == 0, shard=200_000, batch=150_000)
    p = {r["doc_id"]: r for r in got.collect()}
    toks = {r["doc_id"]: [*WORD.findall((r["text"] or "").translate({c: c + 32 for c in range(65, 91)})), "\n"] for r in d.collect()}
    c = Counter(w for k, v in toks.items() if crc(k) % 10 for w in v)
    n, v = sum(c.values()), len(c)
    for k, w in toks.items():
        r = p[k]
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(w), sum(c[x] > 0 for x in w), n, crc(k) % 10 == 0)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0
    q = {r["held_out"]: r for r in pitmanyor.perplexity(got).collect()}
    assert q[True]["perplexity"] < q[True]["base_perplexity"]


def test_word_restaurant_sums_to_one():
    counts, dishes = np.array([1, 2, 5, 900]), np.array([50, 20, 9, 1])
    w = pitmanyor.Words(counts, dishes, 1)
    assert (w.p(counts) * dishes).sum() + w.p(np.array([0]))[0] == pytest.approx(1, abs=1e-6)


def test_seating_matches_exact_posterior():
    """Gibbs over the tables of one dish of 6 customers against weights S(6, t) * (theta | d) rising * base ** t."""
    d, pull_base, rng, n = 0.5, 0.3, np.random.default_rng(2), 6
    s = np.zeros((n + 1, n + 1))
    s[0, 0] = 1
    for c in range(1, n + 1):
        for t in range(1, c + 1):
            s[c, t] = s[c - 1, t - 1] + (c - 1 - d * t) * s[c - 1, t]
    # the pull of a new table is held fixed, as in a sweep
    want = s[n, 1:] * pull_base ** np.arange(1, n + 1)
    want /= want.sum()
    t = pitmanyor.reseat(np.full(60_000, n), np.ones(60_000, np.int64), np.full(60_000, pull_base), d, 120, rng)
    got = np.bincount(t, minlength=n + 1)[1:] / len(t)
    assert np.abs(got - want).max() < 0.012


def test_seating_of_large_dishes():
    """Tables of dishes of 2,000 customers, started under another parent, after a run's sweeps against the exact posterior mean."""
    d, pull, rng, n, most = 0.8, 20.0, np.random.default_rng(5), 2000, 1200
    t = np.arange(1, most + 1)
    s = np.where(t == 1, 0.0, -np.inf)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(2, n + 1):
            s = np.logaddexp(np.concatenate(([-np.inf], s[:-1])), np.where(t < c, np.log(np.maximum(c - 1 - d * t, 1e-300)) + s, -np.inf))
    w = s + t * math.log(pull)
    w = np.exp(w - w.max())
    assert w[-1] < 1e-9 * w.sum()
    want = (w * t).sum() / w.sum()
    c, got = np.full(400, n), None
    got = pitmanyor.first_tables(c, np.full(400, 0.05), d, rng)
    means = []
    for _ in range(pitmanyor.SWEEPS):
        got = pitmanyor.reseat(c, got, np.full(400, pull), d, pitmanyor.MOVES, rng)
        means.append(got.mean())
    assert np.mean(means[pitmanyor.BURN_IN :]) == pytest.approx(want, rel=0.05)


def test_contexts_share_a_parent_of_their_tables(spark):
    """Behind an unknown context, a word that many contexts have is more probable than one as frequent that a single context has, wherever the contexts are."""
    taught = [(i, f"san francisco c{i} glass") for i in range(300)]
    asked = [(1000, "unseen francisco"), (1001, "unseen glass")]
    d = spark.createDataFrame(taught + asked, "doc_id long, text string")
    for shard in (10**6, 500):
        p = {r["doc_id"]: r["score"] for r in pitmanyor.score(d, F.col("doc_id") >= 1000, shard=shard).where("doc_id >= 1000").collect()}
        assert p[1001] - p[1000] > 1.5


def test_franchise_matches_customers_one_by_one(monkeypatch):
    """Averaged predictive probabilities of a small franchise against a sampler that seats each customer at tables of their own, in contexts and parent."""
    d, theta, rng = 0.5, pitmanyor.THETA, np.random.default_rng(3)
    monkeypatch.setattr(pitmanyor, "discount", lambda *_: d)
    counts = np.array([[5, 2, 0, 1], [1, 0, 3, 0], [0, 4, 1, 2]])
    n, v = counts.shape

    # plainly: sizes of tables by (context, dish) and by dish of the parent
    low, top = {(u, w): [] for u in range(n) for w in range(v)}, [[] for _ in range(v)]
    seats, base = (lambda u: sum(len(low[u, w]) for w in range(v))), 1 / (v + 1)

    def parent(w):
        every = sum(map(len, top))
        return (sum(top[w]) - d * len(top[w]) + (theta + d * every) * base) / (theta + sum(map(sum, top)))

    def sit(tables, new):
        k = rng.choice(len(tables) + 1, p=(x := np.array([*(y - d for y in tables), new])) / x.sum())
        tables[k : k + 1] = [tables[k] + 1 if k < len(tables) else 1]
        return tables[k] == 1

    def leave(tables):
        k = rng.choice(len(tables), p=np.array(tables) / sum(tables))
        tables[k : k + 1] = [tables[k] - 1] if tables[k] > 1 else []

    def come(u, w):
        if sit(low[u, w], (theta + d * seats(u)) * parent(w)):
            sit(top[w], (theta + d * sum(map(len, top))) * base)

    customers = [(u, w) for u in range(n) for w in range(v) for _ in range(counts[u, w])]
    for u, w in customers:
        come(u, w)
    want, samples = np.zeros((n, v)), 0
    for k in range(1200):
        for u, w in customers:
            before = len(low[u, w])
            leave(low[u, w])
            if len(low[u, w]) < before:
                leave(top[w])
            come(u, w)
        if k >= 50:
            p = [parent(w) for w in range(v)]
            want += [[(counts[u, w] - d * len(low[u, w]) + (theta + d * seats(u)) * p[w]) / (theta + counts[u].sum()) for w in range(v)] for u in range(n)]
            samples += 1
    want /= samples

    none = np.zeros(0, np.int64)
    x = pitmanyor.Shard(pitmanyor.Shard(None, np.full(n, v), np.tile(np.arange(v), n), counts.ravel(), np.arange(v) << 30, none, none).blob())
    t, got, samples = None, np.zeros(n * v), 0
    for k in range(1200):
        c = np.bincount(x.w, np.minimum(x.c, 1) if t is None else t, v).astype(np.int64)
        words = pitmanyor.Words(*np.unique(c, return_counts=True), k)
        if k >= 50:
            got, samples = got + x.predict(t, {}, {}, words.p(c), d), samples + 1
        draw = words.draw(c, rng)
        t = x.sweep(t, {}, {}, (draw + words.fresh / (v + 1)) / (draw.sum() + words.fresh), d, rng)
    assert got / samples == pytest.approx(want.ravel(), rel=0.04, abs=0.004)


def test_scores_odd(spark):
    d = odd(spark)
    none, every = F.lit(True), F.lit(False)
    assert pitmanyor.score(d, every).count() == 8
    r = pitmanyor.score(d, none).collect()
    assert len(r) == 8 and {x["train_tokens"] for x in r} == {0} and {x["n_known"] for x in r} == {0}
    assert pitmanyor.score(empty(spark), none).count() == 0


# chats


def test_chats(spark):
    t = [(1, 0, "system", "s"), (1, 1, "user", "a\\b <s> [INST"), (1, 2, "assistant", "</s>\\</s>[/INST]<</SYS>>"), (2, 1, "assistant", "x"), (2, 0, "user", None), (3, 0, "user", "no answer"), (4, 0, "tool<s>", "[END]"), (4, 1, None, "y"), (None, None, "user", "q"), (5, 0, "user", "same"), (5, 0, "user", "same")]
    d = spark.createDataFrame([(*x, 1) for x in t], "conv_id long, turn long, role string, text string, at long")
    f = chat.format_chats(d)
    got = {r["conv_id"]: r for r in chat.read_back(f).collect()}
    whole = {r["conv_id"]: r for r in f.collect()}
    assert [(x["role"], x["text"]) for x in got[1]["turns"]] == [(r, x) for _, _, r, x in t[:3]] and got[1]["learned"] == t[2][3]
    assert [(x["role"], x["text"]) for x in got[4]["turns"]] == [("tool<s>", "[END]"), ("", "y")]
    assert [(x["role"], x["text"]) for x in got[2]["turns"]] == [("user", ""), ("assistant", "x")]
    assert {k: (r["valid"], r["bad_turn"]) for k, r in got.items()} == {1: (True, 0), 2: (True, 0), 3: (False, 2), 4: (False, 1), None: (False, 2), 5: (False, 2)}
    assert all("".join(s["text"] for s in r["segments"]) == r["formatted"] for r in whole.values())
    assert "".join(chat_text for chat_text in [s["text"] for s in whole[1]["segments"] if s["loss"]]) == whole[1]["formatted"][whole[1]["spans"][0]["start"] - 1 :][: whole[1]["spans"][0]["length"]]
    assert chat.format_chats(d.where("false")).count() == 0


def test_chat_query(spark, data, duck):
    from conftest import plain

    got = queries_b.op10_chat_format(spark, data).toPandas()
    assert plain(got).equals(plain(duck.execute(queries_b.SQL["op10_chat_format"]).df()))
    r = got[got["conv_id"] == -7].iloc[0]
    text = "</s>[INST] ok [/INST]"
    assert r["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest() and r["loss_chars"] == len(text)
