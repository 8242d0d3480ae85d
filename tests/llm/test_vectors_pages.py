"""Operators on vectors and pages: SQL, brute force, planted near-duplicates, odd rows."""

import numpy as np
import pytest
from conftest import plain

from larkspan.llm import htmltext, nearvectors, queries_a, queries_d, topk

SCHEMA = "vec_id long, embedding array<float>, label int, node long, shard int"


def frame(spark, ids, x):
    return spark.createDataFrame([(i, v if v is None else [None if c is None else float(c) for c in v], 0, 1, 1) for i, v in zip(ids, x)], SCHEMA)


def planted(spark, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(300, 16))
    near = x[:40] + rng.normal(size=(40, 16)) * 0.08 * np.abs(x[:40]).mean()
    hot = x[299] + rng.normal(size=(200, 16)) * 0.03
    x = np.concatenate((x, near, hot, x[:10], x[:5] * 2)).astype(np.float32)
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [float("inf")] * 16, [1.0, 2.0]]
    return list(range(len(x) + len(odd))), [*x.tolist(), *odd]


def brute_links(ids, x, link=0.95):
    good = [v is not None and len(v) > 0 and all(c is not None for c in v) and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float)) for v in x]
    n, out = len(ids), []
    m = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(i):
            if good[i] and good[j] and len(x[i]) == len(x[j]):
                a, b = np.array(x[i], float), np.array(x[j], float)
                m[i, j] = m[j, i] = a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= link
    low = np.array(ids)
    while True:
        new = np.minimum(low, np.where(m, low[None, :], max(ids) + 1).min(1))
        if (new == low).all():
            break
        low = new
    for i in range(n):
        out.append((ids[i], int(m[i].sum()), int(low[i]), bool(low[i] == ids[i])))
    return out


@pytest.mark.parametrize("shard, share", [(4096, 1500), (64, 100)])
def test_near_vectors(spark, monkeypatch, shard, share):
    monkeypatch.setattr(nearvectors, "SHARD", shard)
    monkeypatch.setattr(nearvectors, "SHARE", share)
    ids, x = planted(spark)
    d = frame(spark, ids, x)
    got = nearvectors.group(d)
    want = {r[0]: r for r in brute_links(ids, x)}
    have = {r["vec_id"]: tuple(r) for r in got.collect()}
    assert have.keys() == want.keys()
    found, true = sum(r[1] for r in have.values()), sum(r[1] for r in want.values())
    assert 0.9 * true <= found <= true and all(have[k][1] <= want[k][1] for k in want)
    assert sum(have[k][2:] == want[k][2:] for k in want) >= 0.98 * len(want)
    if shard == 4096:
        assert have == want
        assert nearvectors.audit(d.where("size(embedding) = 16"), got, asked=60) >= 0.9


def test_near_vectors_across_shards(spark, monkeypatch):
    """Links of vectors without a common shard are found too; clusters share a cell or are cut into several."""
    for name, n in (("SHARD", 64), ("SHARE", 20), ("CELL", 40)):
        monkeypatch.setattr(nearvectors, name, n, raising=False)
    ids, x = planted(spark, 5)
    rng = np.random.default_rng(6)
    more = rng.normal(size=16) + rng.normal(size=(150, 16)) * 0.2
    ids, x = [*ids, *range(len(ids), len(ids) + 150)], [*x, *more.astype(np.float32).tolist()]
    assert {tuple(r) for r in nearvectors.group(frame(spark, ids, x)).collect()} == set(brute_links(ids, x))


def test_near_vectors_empty(spark):
    assert nearvectors.group(frame(spark, [], [])).count() == 0
    got = nearvectors.group(frame(spark, [1, 2], [None, [0.0]])).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_near_vectors_sql(spark, data, duck):
    got = queries_d.op5_near_vectors(spark, data).toPandas()
    assert plain(got).equals(plain(duck.execute(queries_d.SQL["op5_near_vectors"]).df()))


def test_near_vectors_planted(spark, data, duck):
    got = queries_d.near_vectors_planted(spark, data).toPandas()
    assert plain(got).equals(plain(duck.execute(queries_d.SQL["near_vectors_planted"]).df()))
    assert 300 < (got["n_links"] > 0).sum() < len(got)


def test_topk_sql(spark, data, duck):
    got = queries_d.op7_topk(spark, data).toPandas()
    assert plain(got).equals(plain(duck.execute(queries_d.SQL["op7_topk"]).df()))


@pytest.mark.parametrize("block", [4096, 50])
def test_topk_brute(spark, block):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 12)).astype(np.float32)
    x[50:60] = x[0]
    x[7] = 0
    odd = [None, [], [float("nan")] * 12, [None] * 12, [1.0] * 3]
    d = frame(spark, list(range(405)), [*x.tolist(), *odd])
    got = {}
    for r in topk.search(d, d.where("vec_id % 100 = 0"), block=block).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    v = np.floor(1024 * x.astype(float)).astype(int)
    for q in (0, 100, 200, 300):
        s = v @ v[q]
        best = sorted((-int(s[i]), i) for i in range(400) if i != q)[:10]
        assert sorted(got[q]) == [(k + 1, i, -m) for k, (m, i) in enumerate(best)]
    assert topk.search(d.where("false"), d).count() == 0 and topk.search(d, d.where("false")).count() == 0
    few = topk.search(d.where("vec_id < 4"), d.where("vec_id = 0"))
    assert few.count() == 3


def test_topk_stops_early():
    """Queries stop before the last tier, more of them with a score that an earlier block gave; results stay exact."""
    rng = np.random.default_rng(1)
    x = np.floor(1024 * rng.normal(size=(4096, 64)) / 8).astype(np.int64)
    q = np.floor(1024 * rng.normal(size=(50, 64)) / 8).astype(np.int64)
    ids = np.arange(4096)
    index = topk.Index(x, ids)
    own = np.full(50, -1)
    own[0] = 7
    every = q @ x.T
    every[0, 7] = -(1 << 40)
    best = np.sort(every, axis=1)[:, ::-1]
    used = []
    for least in (np.full(50, -np.inf), best[:, 9].astype(float)):
        c, found, scores, took = index.search(q, own, 10, least)
        for i in range(50):
            want = sorted(zip(-every[i], ids))[:10]
            assert list(zip(-scores[c == i], found[c == i])) == want
        used.append(took)
        assert (took < len(index.tiers)).mean() >= 0.9
    assert (used[1] <= used[0]).all() and used[1].sum() < used[0].sum()


def test_topk_odd(spark):
    """Null ids, repeated rows, one id with different vectors, large components, ties."""
    v = [1.0, -2.0]
    rows = [(1, v), (1, v), (None, v), (2, [3e12, 1.0]), (3, [0.0, 0.0]), (3, v), (0, v), (0, [-1.0, 0.0]), (4, v)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.search(d, d.where("vec_id = 0")).collect()), key=lambda r: r[1])
    assert [r[2:] for r in got] == [(3, 0), (1, -(1 << 20)), (1, -(1 << 20)), (3, -(1 << 20)), (4, -(1 << 20)), (2, -1024 * 3 * 10**12 * 1024)]


PAGE = """<!DOCTYPE html><html><head><title>t {n}</title><style>p{{}}</style><script>var a = "<p>no</p>";</script></head><body>
<header><a href="/">Site &amp; name</a></header><nav class="menu"><ul><li>Home<li>News</ul></nav><div class="cookie-notice"><p>We use cookies {n}</p></div>
<main><article><header><h1>Title&nbsp;{n} &lt;x&gt;</h1></header><p>First   <b>bold</b> &#233;t&eacute; {n}.<p>Second<br>line {n} with a link <a href="#">here</a>, then.</p>{more}<form><p>Mail?</p><input name=a></form>
<aside><p>Related {n}</p></aside><div class="ad-slot"><p>Buy {n}</p></div></article></main><section id="comments"><p>Comment {n}</p></section><footer><p>&copy; {n}</p></footer></body></html>"""


def test_pages(spark):
    rows = [(i, f"http://a.example/{i}", PAGE.format(n=i, more="<ul><li>one<li>two</ul>" if i % 2 else "")) for i in range(9)]
    rows += [(20, "http://b.example/x", PAGE.format(n=20, more="")), (21, None, None), (22, "http://a.example/", ""), (23, "x", "<p>plain & open <i>text"), (20, "http://b.example/x", PAGE.format(n=20, more=""))]
    d = spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, html string, z string, chunk int")
    got = htmltext.extract(d, chunk=4)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == len(rows)
    r = {x["page_id"]: x for x in got.collect()}
    for i in (*range(9), 20):
        assert r[i]["text"] == f"Title {i} <x>\n\nFirst bold été {i}.\n\nSecond line {i} with a link here, then." + ("\n\none\n\ntwo" if i % 2 and i < 20 else "")
        assert r[i]["n_chars"] == len(r[i]["text"])
    assert r[21]["text"] == "" and r[22]["n_chars"] == 0 and r[23]["text"] == "plain & open text"
    assert htmltext.extract(d.where("false")).count() == 0


def test_open_tags_end_with_their_gap(spark):
    """A menu that one page leaves open ends where the template of its host goes on."""
    page = "<html><body><nav><ul><li>m</li></ul>{end}<article><h1>T</h1><p>Text {n}</p></article><footer>f</footer></body></html>"
    texts = htmltext.texts([page.format(n=i, end="</nav>" if i else "") for i in range(6)])
    assert texts == [f"T\n\nText {i}" for i in range(6)]


def plain_pages(n, seed=3):
    """(html, text) of pages of one template without any name that tells: div, p, h1 only."""
    rng = np.random.default_rng(seed)
    words = lambda k: " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(k))
    out = []
    for _ in range(n):
        parts = [words(rng.integers(10, 60)) for _ in range(rng.integers(1, 7))]
        title, more = words(5), "".join(f'<div><a href="/x">{words(4)}</a></div>' for _ in range(rng.integers(2, 6)))
        out.append((
            f'<html><body><div><a href="/">Home</a> <a href="/n">News</a></div><div><div>{words(8)}</div><div>Write to us</div></div><div><h1>{title}</h1><div>{"".join("<p>" + p for p in parts)}</div>'
            f"<div>Share this with friends</div></div><div>{more}</div><div>Copyright of the site</div></body></html>",
            "\n\n".join([title, *parts]),
        ))
    return out


def test_pages_without_names():
    """The template alone finds the text, and without it the text would not be found."""
    pages = plain_pages(40)
    got = htmltext.texts([h for h, _ in pages])
    assert got == [t for _, t in pages]
    one = [htmltext.texts([h])[0] for h, _ in pages]
    assert all(a != b and t in a.replace("Write to us", "") for a, b, (_, t) in zip(one, got, pages))


def test_template_decides(monkeypatch):
    pages = plain_pages(12)
    monkeypatch.setattr(htmltext, "labels", lambda pages: [[("", "")] * len(p.parent) for p in pages])
    assert all(a != t for a, (_, t) in zip(htmltext.texts([h for h, _ in pages]), pages))


def test_copied_pages_keep_their_text():
    """Copies of a page without an article count once, and no page loses all its blocks."""
    page = lambda *blocks: "<html><body>" + "".join(f"<div>{b}</div>" for b in blocks) + "</body></html>"
    story = ["The story of the town.", "Its second part is longer."]
    pages = [page(*story)] * 8 + [page(f"Own words {k} of this page.", "More stories on the front page.") for k in "abcde"]
    got = htmltext.texts(pages)
    assert got[:8] == ["\n\n".join(story)] * 8
    assert all(t.startswith(f"Own words {k} of this page.") for k, t in zip("abcde", got[8:]))
    for n in (1, 2, 5, 50):
        assert htmltext.texts([page(*story)] * n) == ["\n\n".join(story)] * n
    assert htmltext.texts(['<div class="post-form"><p>Text</p></div>']) == ["Text"]


def test_deep_and_broken_markup():
    deep = "<div>" * 300 + "<article><p>In the deep</p>" + "<section>" * 40 + "x" + "</article>" + "</div>" * 300 + "<footer>f</footer>"
    assert htmltext.texts([deep]) == ["In the deep\n\nx"]
    assert htmltext.texts(["</div></p><div><p>a<div>b</span></body></div>", "<", "<div", "&lt;p&gt; &#x110000; &nbsp;"])[0] == "a\n\nb"
    assert htmltext.texts(["<main></main><p>outside</p>", None, ""]) == ["", "", ""]
    long = "<p>" + "word " * 200_000 + "</p>"
    assert len(htmltext.texts([long] * 2)[1]) == 999_999


def test_classes_of_what_holds_the_article():
    page = '<html><body><div class="wrap no-sidebar"><p>up</p><article><div class="entry-header"><h1>T {n}</h1></div><p>Text</p><div class="comments"><article class="comment"><p>c</p></article></div></article></div><div id="sidebar"><p>s</p></div></body></html>'
    assert htmltext.texts([page.format(n=1)]) == ["T 1\n\nText"]
    assert htmltext.texts([page.format(n=i) for i in range(5)]) == [f"T {i}\n\nText" for i in range(5)]


def test_classes():
    pages = [htmltext.tokens(f"<html><body><ul>{'<li><a>x</a></li>' * n}</ul><p>t</p></body></html>") for n in (1, 2, 3)]
    found = htmltext.classes(pages)
    assert any({r.rsplit(">", 1)[1] for r in roles} == {"li", "/li", "a", "/a"} for v, roles in found.items() if v == ((0, 1), (1, 2), (2, 3)))
    assert [r.rsplit(">", 1)[1] for r in htmltext.root(pages, found)][:3] == ["html", "body", "ul"]


def test_page_query(spark, data):
    import re

    got = {r["page_id"]: r["text"] for r in queries_a.op1_html_text(spark, data).collect()}
    for r in spark.read.parquet(f"{data}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [" ".join(htmltext.unescape(re.sub(r"<[^>]*>", " " if "<br" in b else "", b)).split()) for b in re.split(r"</?(?:p|h1)\b[^>]*>", inner)]
        assert got[r["page_id"]] == "\n\n".join(p for p in parts if p)
