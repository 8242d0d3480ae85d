"""Operator 1, main text of web pages by equivalence-class template deduction.

Pages of a host are read together, in chunks of bounded size. A token is a tag in its role (name, class and id, in its chain of open tags).
Tokens with the same occurrence vector over the chunk's pages form a class. The class that stands once on every page, in one order, is
the root template; other classes of tags that open and close nest in the gaps between its tokens. A gap inherits what encloses it in the template,
so a tag that a page leaves open ends with its gap. Where pages have an article or main element, gaps and nested classes of it that are forms, adverts, replies and the
like go, the rest of it is the text. Where they have none, names say little: tokens of equal counts are told apart by place, the others nest as repeated classes,
and the slots so found decide: text is what varies from page to page, is not made of links, and lies in the main element of the template.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.shared import spool

#: Pages of a chunk, on average, and hosts of several chunks that are broadcast at most.
CHUNK, HOSTS = 400, 100_000
#: Bytes of html of a chunk, on average.
BYTES = 16_000_000
#: Elements whose content is not main text. Fixed values.
CHROME = frozenset("head script style noscript template svg math iframe object canvas nav menu header footer aside form button select textarea input dialog audio video".split())
#: Words of a class, id or role that say the same. Fixed values.
CHROME_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu topbar toolbar header masthead footer sidebar aside cookie cookies consent notice notices alert popup modal overlay newsletter subscribe signup login search form comment comments commentlist respond reply replies disqus discussion share sharing social related recommended breadcrumb breadcrumbs pagination pager widget copyright contentinfo complementary".split())
MAIN = frozenset(("article", "main"))
#: Those that make even an article no main text.
REPLIES = frozenset(("comment", "comments", "commentlist", "reply", "replies", "respond"))
#: Elements that end a block of text. Fixed values.
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul caption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements left out of a role's chain: pages leave them open.
LOOSE = frozenset("p li b i a u s em strong small span font br dd dt tr td th option".split())

_token = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|</?[a-zA-Z][^<>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^<>\"']*)*>", re.S | re.I)
_name = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_marks = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


class Tag:
    """What matters of a tag: name, opens, chrome, whether that holds outside articles only (a header), whether a class or id says so, and its key without other attributes."""

    __slots__ = ("name", "opens", "chrome", "outside", "said", "key")

    def __init__(self, raw: str):
        self.name = _name.match(raw)[1].lower()
        self.opens = raw[1] != "/"
        marks = " ".join(a or b or c for a, b, c in _marks.findall(raw)).lower() if self.opens and "=" in raw else ""
        words = set(re.split(r"[^a-z]+", marks)) if marks else ()
        own = {w for w in words if w in CHROME_WORDS}
        self.said = bool(own)
        self.chrome = self.name in CHROME or (bool(own & REPLIES) if self.name in MAIN else self.said and self.name not in ("html", "body"))
        self.outside = self.name == "header" or self.name not in CHROME and own == {"header"}
        self.key = f"{'' if self.opens else '/'}{self.name}{' ' + re.sub('[0-9]+', '0', marks) if marks else ''}"


_tags: dict[str, Tag] = {}


def tokens(html: str) -> list[tuple[Tag | None, str | None, str]]:
    """(tag, role, text) in page order: text runs have no tag; comments, declarations and whole raw-text elements are left out. Roles of tags are chains of keys."""
    out: list = []
    at, chain, stack = 0, "", []  # stack: name, chain before, key
    places: dict[str, list[int]] = {}  # by name, where it stands in the stack
    for m in _token.finditer(html):
        a, b = m.span()
        if a > at:
            out.append((None, None, html[at:a]))
        at = b
        if m[1] or html[a + 1] in "!?":
            if m[1]:
                out.append((None, None, " "))
            continue
        raw = html[a:b]
        tag = _tags.get(raw)
        if tag is None:
            tag = Tag(raw)
            if len(_tags) < 50_000:
                _tags[raw] = tag
        name = tag.name
        if name in LOOSE or name in VOID:
            out.append((tag, f"{chain}>{tag.key}", ""))
        elif tag.opens:
            out.append((tag, f"{chain}>{tag.key}", ""))
            if raw[-2] != "/":
                places.setdefault(name, []).append(len(stack))
                stack.append((name, chain, tag.key))
                chain = f"{chain}>{tag.key}"
        else:
            key = tag.key  # with the marks of the tag it closes
            if places.get(name):
                k = places[name][-1]
                chain, key = stack[k][1], "/" + stack[k][2]
                for n, _, _ in stack[k:]:
                    places[n].pop()
                del stack[k:]
            out.append((tag, f"{chain}>{key}", ""))
    if at < len(html):
        out.append((None, None, html[at:]))
    return out


def classes(pages: list[list]) -> dict[tuple, list[str]]:
    """Equivalence classes: occurrence vector (counts by page, pages without the role left out) -> roles, in the order in which they first stand."""
    vectors: dict[str, list] = {}
    for i, page in enumerate(pages):
        for role, n in Counter(r for _, r, _ in page if r).items():
            vectors.setdefault(role, []).append((i, n))
    out: dict[tuple, list[str]] = {}
    for role, v in vectors.items():
        out.setdefault(tuple(v), []).append(role)
    return out


def root(pages: list[list], found: dict[tuple, list[str]]) -> list[str]:
    """The roles of the class that stands once on every page, in the order of all pages; a role that breaks the order is no valid member."""
    every = tuple((i, 1) for i in range(len(pages)))
    roles = set(found.get(every, ()))
    order: list[str] | None = None
    for page in pages:
        own = [r for _, r, _ in page if r in roles]
        if order is None:
            order = own
        elif own != order:
            place = {r: k for k, r in enumerate(own)}
            kept, last = [], -1
            for r in order:
                if place[r] > last:
                    kept.append(r)
                    last = place[r]
            order = kept
            roles = set(kept)
    return order or []


def gaps(template: list[str]) -> list[tuple[bool, bool]]:
    """For the gap after each of the template's tokens: whether it is enclosed in chrome, and in an article or main element."""
    out, chrome, main = [], [], []
    keys = {r.rsplit(">", 1)[1] for r in template}
    for role in template:
        key = role.rsplit(">", 1)[1]
        name = key.lstrip("/").split(" ")[0]
        if key[0] == "/":
            for open_ in (chrome, main):
                if key[1:] in open_:
                    del open_[len(open_) - 1 - open_[::-1].index(key[1:]) :]
        elif name not in VOID and f"/{key}" in keys:
            own = CHROME_WORDS.intersection(re.split(r"[^a-z]+", key.partition(" ")[2]))
            if name in MAIN and not own & REPLIES:
                main.append(key)
                chrome.clear()
            elif name in MAIN or (name in CHROME or own and name not in ("html", "body")) and not (main and (name == "header" or name not in CHROME and own == {"header"})):
                chrome.append(key)
        out.append((bool(chrome), bool(main)))
    return out


def blocks(page: list, template: dict[str, int], inside: list[tuple[bool, bool]]) -> list[tuple[bool, str]]:
    """(in the main element, text) of the page's blocks outside chrome."""
    out: list[tuple[bool, str]] = []
    run: list[str] = []
    chrome = main = False
    skip, depth, own_main, by_word = "", 0, 0, False

    def flush() -> None:
        if run:
            text = " ".join(unescape("".join(run)).split())
            if text:
                out.append((main or own_main > 0, text))
            run.clear()

    for tag, role, text in page:
        if tag is None:
            if not (chrome or skip):
                run.append(text)
            continue
        name = tag.name
        k = template.get(role)
        if k is not None:
            if name in BLOCK or skip or inside[k] != (chrome, main):
                flush()
            elif name in VOID:
                run.append(" ")
            (chrome, main), skip, depth = inside[k], "", 0
            if name in MAIN:
                own_main = 0
            continue
        if skip:
            if name in MAIN and tag.opens and not tag.said and by_word:  # a class of what holds the article itself
                skip, depth = "", 0
            elif name == skip:
                depth += 1 if tag.opens else -1
                if depth == 0:
                    skip = ""
            if skip or name not in MAIN or not tag.opens:
                continue
        if name in BLOCK:
            flush()
        elif name == "br" or name in VOID:
            run.append(" ")
        if tag.opens and tag.chrome and not (tag.outside and (main or own_main)):
            if name not in VOID:
                flush()
                skip, depth, by_word = name, 1, name not in CHROME
        elif name in MAIN and not chrome and not tag.chrome:
            own_main = max(0, own_main + (1 if tag.opens else -1))
    flush()
    return out


class Page:
    """A page without an article or main element as a tree: elements (parent, key), and blocks of text (element, text, characters in links) outside elements whose name says chrome."""

    def __init__(self, page: list):
        self.parent, self.key, self.blocks = [-1], [""], []
        stack, run, linked, link, skip = [("", 0)], [], 0, 0, 0

        def flush() -> None:
            nonlocal linked
            text = " ".join(unescape("".join(run)).split())
            if text:
                self.blocks.append((stack[-1][1], text, linked))
            run.clear()
            linked = 0

        for tag, _, text in page:
            if tag is None:
                if not skip:
                    run.append(text)
                    linked += len(text) if link else 0
                continue
            name = tag.name
            if name == "a":
                link = max(0, link + (1 if tag.opens else -1))
            if name in BLOCK:
                flush()
            elif name == "br" or name in VOID:
                run.append(" ")
            if name in LOOSE or name in VOID:
                continue
            if tag.opens:
                stack.append((name, len(self.parent)))
                self.parent.append(stack[-2][1])
                self.key.append(tag.key)
                skip += name in CHROME
            elif any(n == name for n, _ in stack):
                flush()
                while True:
                    n, _ = stack.pop()
                    skip -= n in CHROME
                    if n == name:
                        break
        flush()


def labels(pages: list[Page]) -> list[list[tuple[str, str]]]:
    """For each element of each page its slot: (the template element that holds it, the repeated element in that, if any).

    Template elements stand once on every page. Children of one key of a template element are tokens of their own, told apart by place, if all pages have equally many of
    them (an occurrence vector of equal counts); else they are a repeated or optional class, which nests in their parent's slot.
    """
    children = []
    for p in pages:
        own: list[dict[str, list[int]]] = [{} for _ in p.parent]
        for i in range(1, len(p.parent)):
            own[p.parent[i]].setdefault(p.key[i], []).append(i)
        children.append(own)
    out: list[list] = [[("", "")] + [None] * (len(p.parent) - 1) for p in pages]
    level = [("", [0] * len(pages))]
    while level:
        below = []
        for label, at in level:
            for key in sorted({k for own, i in zip(children, at, strict=True) for k in own[i]}):
                found = [own[i].get(key, []) for own, i in zip(children, at, strict=True)]
                if len({len(f) for f in found}) == 1:
                    for j in range(len(found[0])):
                        name = f"{label}>{key}#{j}"
                        for page, f in zip(out, found, strict=True):
                            page[f[j]] = (name, "")
                        below.append((name, [f[j] for f in found]))
                else:
                    for page, f in zip(out, found, strict=True):
                        for i in f:
                            page[i] = (label, key)
        level = below
    for p, page in zip(pages, out, strict=True):
        for i in range(1, len(page)):  # what is inside a repeated element is of its slot
            if page[i] is None:
                page[i] = page[p.parent[i]]
    return out


#: Share of the prose of an element that one of its children must hold to be the main one, share of links that makes a slot a menu, and distinct pages from which text that all have is template.
MAIN_SHARE, MENU, PAGES = 0.6, 0.8, 3


def by_slots(pages: list[Page]) -> list[list[str]]:
    """Main blocks of distinct pages of one template that has no article element.

    A slot counts if its text varies from page to page and is not made of links. From the root the main element is sought downwards: into the child that holds most of the prose of such slots, unless
    a heading that varies stays outside. Blocks of its slots that count are the text, but for those that stand once on each page (PAGES or more).
    """
    place = labels(pages)
    slots: dict[tuple[str, str], list[tuple]] = {}
    for p, own in zip(pages, place, strict=True):
        mine: dict[tuple[str, str], list] = {}
        for el, text, linked in p.blocks:
            mine.setdefault(own[el], []).append((text, linked))
        for slot, found in mine.items():
            slots.setdefault(slot, []).append(tuple(found))
    prose: dict[tuple[str, str], int] = {}
    for slot, found in slots.items():
        size, linked = (sum(x(b) for f in found for b in f) for x in (lambda b: len(b[0]), lambda b: min(len(b[0]), b[1])))
        if (len(set(found)) > 1 or len(found) < len(pages)) and linked < MENU * size:
            prose[slot] = size - linked
    inside = lambda slot, main: slot[0] == main or slot[0].startswith(main + ">")
    heading = lambda slot: re.match(r"h[1-6]\b", (slot[1] or slot[0].rsplit(">", 1)[-1]))
    main = ""
    while True:
        total, shares = sum(n for s, n in prose.items() if inside(s, main)), {}
        for s, n in prose.items():
            if inside(s, main) and s[0] != main:
                child = main + ">" + s[0][len(main) + 1 :].split(">")[0]
                shares[child] = shares.get(child, 0) + n
        best = max(shares, key=lambda c: (shares[c], c), default=None)
        if best is None or shares[best] < MAIN_SHARE * total or any(heading(s) and inside(s, main) and not inside(s, best) for s in prose):
            break
        main = best
    every = Counter(t for p in pages for t, n in Counter(t for _, t, _ in p.blocks).items() if n == 1) if len(pages) >= PAGES else {}
    out = []
    for p, own in zip(pages, place, strict=True):
        kept = [t for el, t, _ in p.blocks if own[el] in prose and inside(own[el], main) and every.get(t, 0) < len(pages)]
        out.append(kept or [t for _, t, _ in p.blocks])
    return out


def texts(htmls: list[str | None]) -> list[str]:
    """Main texts of pages of one host."""
    pages = [tokens(h) if h else [] for h in htmls]
    there = [p for p in pages if p]
    if not there:
        return [""] * len(pages)
    template = root(there, classes(there))
    inside = gaps(template)
    place = {r: k for k, r in enumerate(template)}
    found = [blocks(p, place, inside) for p in pages]
    out = ["\n\n".join([t for m, t in b if m]) for b in found]
    # no main element: the template alone says what is text; copies of a page count once
    open_ = {i: Page(p) for i, p in enumerate(pages) if p and not any(t and t.opens and t.name in MAIN and not t.chrome for t, _, _ in p)}
    known: dict[tuple, int] = {}
    for i, p in open_.items():
        known.setdefault(tuple(t for _, t, _ in p.blocks), i)
    if len(known) > 1:
        chosen = dict(zip(known, by_slots([open_[i] for i in known.values()]), strict=True))
        for i, p in open_.items():
            out[i] = "\n\n".join(chosen[tuple(t for _, t, _ in p.blocks)])
    else:  # one page has no template: classes decide, unless nothing is left
        for i, p in open_.items():
            out[i] = "\n\n".join([t for _, t in found[i]] or [t for _, t, _ in p.blocks])
    return out


def host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"//([^/?#]*)", 1)), F.lit(""))


def extract(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of (page_id, url, html): the article's blocks joined by two line ends, and its code points.

    Null or empty html: empty text, as is a page whose article is empty. A null url has the empty host. Repeated rows stay, equal ids too; an empty table gives an empty table; other
    columns are ignored. Chunks are dealt by a hash, `chunk` pages on average, so a host with most of the pages is many groups; pages travel compressed.
    """
    import zstandard

    # hosts of more than one chunk: no more than a row for each `chunk` pages
    n = spool(pages.groupBy(host(F.col("url")).alias("host")).agg(F.ceil(F.greatest(F.count("*") / chunk, F.coalesce(F.sum(F.octet_length("html")), F.lit(0)) / BYTES)).cast("int").alias("chunks")).where("chunks > 1"), "hosts")
    n = F.broadcast(n) if n.limit(HOSTS + 1).count() <= HOSTS else n

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            z = pa.array([None if h is None else squeeze(h.encode("utf-8", "surrogatepass")) for h in b.column("html").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), b.column("host"), z], names=["page_id", "url", "host", "z"])

    kinds = dict(pages.dtypes)
    packed = pages.select("page_id", "url", "html", host(F.col("url")).alias("host")).mapInArrow(pack, f"page_id {kinds['page_id']}, url string, host string, z binary")
    packed = packed.join(n, "host", "left").withColumn("chunk", F.coalesce(F.pmod(F.xxhash64("page_id", "url", "z"), F.col("chunks")), F.lit(0)))
    packed = packed.repartition("host", "chunk")  # else a join by host leaves all chunks of a host in one task

    def run(t: pa.Table) -> pa.Table:
        open_ = zstandard.ZstdDecompressor().decompress
        found = texts([None if z is None else open_(z).decode("utf-8", "surrogatepass") for z in t.column("z").to_pylist()])
        return pa.table({"page_id": t.column("page_id"), "url": t.column("url"), "text": pa.array(found, pa.string()), "n_chars": pa.array(list(map(len, found)), pa.int64())})

    return packed.groupBy("host", "chunk").applyInArrow(run, f"page_id {kinds['page_id']}, url string, text string, n_chars long")
