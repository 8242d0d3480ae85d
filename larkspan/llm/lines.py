"""Operator 3, line deduplication by a log-template tree of fixed depth. Main path: DataFrame functions only.

A line is masked (tokens with a digit become <*>) and goes down the tree: token count, then its leading tokens. Lines of a leaf that agree with
its most frequent tokens at most positions are one template, whose other positions are generalised; the rest is parted further and tried again. What is alike
to nothing is its own template.
A template that recurs across documents is dropped from them. Equal texts count as one document and so does a group of near copies, told by
whole documents: a text most of whose lines stand in m texts counts as 1 / m of one. Copies are left to the near-duplicate operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.llm.shared import named, numbered, spool

#: Leading tokens that lead to a leaf.
DEPTH = 3
#: Share of positions at which a line must have a node's most frequent tokens to be of its template, and the least tokens for that.
AGREE, LEAST = 0.6, 6
#: A template recurs from so many documents on. Texts with few lines of their own count too, if they are this share of a template's texts.
DOCS, SHARE = 4, 0.5
MASK = "<*>"
#: Rows of a table of hashes that is broadcast at most.
SMALL = 100_000


def masked(text: Column) -> Column:
    """The lines of a text, trimmed, white space runs as one space, tokens with a digit as <*>. Patterns run once over the text and only from the start of a token."""
    text = F.regexp_replace(F.translate(text, "\t\r\f\v", "    "), " {2,}", " ")
    return F.transform(F.split(F.regexp_replace(text, r"(?<![^ \n])[^ \n0-9]*+[0-9][^ \n]*+", MASK), "\n"), lambda y: F.trim(y))


def _leaf(line: Column, depth: int) -> Column:
    return F.xxhash64(F.char_length(line) - F.char_length(F.replace(line, F.lit(" "), F.lit(""))), F.substring_index(line, " ", depth))


def line_table(docs: DataFrame, depth: int = DEPTH, lines: bool = False) -> DataFrame:
    """A narrow row for each line that is not blank: doc_id, body (hash of the text), at (its position from 0), line (hash of the masked line), leaf, and the masked line if asked for."""
    # each explode of one struct ends an expression, so that the next one reads its value and does not compute it again for each line
    held = lambda x, **cols: x.select("doc_id", "body", F.explode(F.array(F.struct(*[c.alias(k) for k, c in cols.items()]))).alias("h")).select("doc_id", "body", "h.*")
    x = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("body"), "text")
    x = held(x, t=masked(F.col("text")))
    x = held(x, t=F.col("t"), k=F.transform("t", lambda y: _leaf(y, depth)), at=F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: F.get("t", i) != ""))
    rows = F.transform("at", lambda p: F.struct(
        p.alias("at"), F.xxhash64(F.get("t", p)).alias("line"), F.get("k", p).alias("leaf"), *([F.get("t", p).alias("masked")] if lines else [])))
    return x.select("doc_id", "body", F.explode(rows).alias("f")).select("doc_id", "body", "f.*")


def _small(x: DataFrame, bound: int = SMALL) -> DataFrame:
    """A written table, broadcast if it has no more rows than the bound."""
    return F.broadcast(x) if x.limit(bound + 1).count() <= bound else x


def tokens_of(docs: DataFrame, lines: DataFrame, depth: int) -> DataFrame:
    """(leaf, line, tokens) of the masked lines (leaf, line, body): one text that has a line is masked again, not all that have it."""
    own = spool(lines.groupBy("leaf", "line").agg(F.min("body").alias("body")), "wanted")
    bodies = spool(own.select("body").distinct(), "bodies")
    few = bodies.limit(SMALL + 1).count() <= SMALL
    x = docs.join(F.broadcast(bodies), F.xxhash64("text") == F.col("body"), "left_semi") if few else docs
    x = line_table(x, depth, True).join(_small(own).select("line", "body"), ["line", "body"], "left_semi")
    return x.groupBy("leaf", "line").agg(F.split(F.min("masked"), " ").alias("tokens"))


def templates(docs: DataFrame, lines: DataFrame, by: DataFrame, depth: int = DEPTH, agree: float = AGREE, least: int = LEAST, n_docs: int = DOCS, share: float = SHARE) -> DataFrame:
    """(leaf, line, template): the template of each masked line that is generalised; other lines are their own template and have no row here.

    In a node of the tree (at first a leaf) the lines that have the node's most frequent token (ties: the smaller) at `agree` of the positions or more are one template,
    if they are several and it recurs. The other lines go down by their tokens at the position where these are the fewest different ones (ties: the
    first position), and so on until no node has several lines that as one template would recur. Only such nodes are looked at.
    Lines are dealt by their own hash before their tokens are counted, so that a large node is every task's.
    """
    held = lambda x: recurring(x.select("body", F.col("node").alias("template"), F.lit(True).alias("general")), by, n_docs, share).select(F.col("template").alias("node"))
    several = lambda x: x.groupBy("node").agg(F.min("line").alias("low"), F.max("line").alias("high")).where("low <> high").select("node")
    x = lines.select(F.col("leaf").alias("node"), "line", "body")
    many = spool(several(x).join(held(x), "node", "left_semi"), "leaves")
    own = lines.join(_small(many), F.col("leaf") == F.col("node"), "left_semi").select("leaf", "line", "body")
    own = spool(own, "narrow")
    none = lines.select("leaf", "line", F.col("leaf").alias("template")).where("false")
    if many.isEmpty():
        return none
    bodies = own.select("line", "body").distinct()
    rest = spool(tokens_of(docs, own, depth).where(F.size("tokens") >= least).withColumn("node", F.col("leaf")), "tokens")
    found = none
    while not rest.isEmpty():
        n = rest.repartition("line").select("node", F.posexplode("tokens").alias("p", "w")).groupBy("node", "p", "w").agg(F.count("*").alias("n"))
        main = n.groupBy("node", "p").agg(F.min(F.struct(-F.col("n"), "w"))["w"].alias("w"))
        main = main.groupBy("node").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "w"))), lambda x: x["w"]).alias("main"))
        same = F.size(F.filter(F.zip_with("tokens", "main", lambda a, b: a == b), lambda x: x))
        near = spool(rest.join(main, "node").where(same >= F.size("tokens") * F.lit(agree)).select("node", "line"), "near")
        near = near.join(several(near).join(held(near.join(bodies, "line")), "node", "left_semi"), "node", "left_semi")
        made = spool(rest.join(near, ["node", "line"], "left_semi").select("leaf", "line", F.xxhash64("node", F.lit(1)).alias("template")), "made")
        found = found.unionAll(made)
        left = spool(rest.join(near, ["node", "line"], "left_anti"), "left")
        n = left.repartition("line").select("node", F.posexplode("tokens").alias("p", "w")).groupBy("node", "p").agg(F.count_distinct("w").alias("n")).where("n > 1")
        cut = n.groupBy("node").agg(F.min(F.struct("n", "p"))["p"].alias("p"))
        left = left.join(cut, "node").withColumn("node", F.xxhash64("node", "p", F.element_at("tokens", F.col("p") + 1))).drop("p")
        left = spool(left, "down")
        going = several(left).join(held(left.join(bodies, "line").select("node", "body")), "node", "left_semi")
        rest = spool(left.join(going, "node", "left_semi"), "rest")
    return found


def weights(lines: DataFrame) -> DataFrame:
    """(body, half, some): a text counts as one over the number of texts that have its line's leaf; half: by the upper median of its lines, some: by their lowest fifth.

    Near copies share nearly all leaves, so a group of m counts about once. A text with lines of its own counts once by some, and by half if they are more than half.
    """
    n = lines.groupBy("leaf", "body").agg(F.lit(1).alias("one")).groupBy("leaf").agg(F.count("*").alias("n")).where("n > 1")
    at = lines.groupBy("body", "at").agg(F.min("leaf").alias("leaf")).join(_small(spool(n, "shared")), "leaf", "left")
    x = at.groupBy("body").agg(F.sort_array(F.collect_list(F.coalesce("n", F.lit(1)))).alias("n"))
    part = lambda of: 1.0 / F.get("n", F.floor(F.size("n") * F.lit(of)).cast("int"))
    return x.select("body", part(0.5).alias("half"), part(0.2).alias("some"))


def recurring(lines: DataFrame, by: DataFrame, docs: int = DOCS, share: float = SHARE) -> DataFrame:
    """(template, n_texts, half, some) of the templates to drop, by weights(): half reaches docs; or some does and is also `share` of the texts, for a line that recurs as it is.

    A generalised template needs the former: near copies that differ in a word make such templates too. Sums in parts, so that a common template is never one task's.
    """
    once = lines.groupBy("template", "body").agg(F.max("general").alias("general"))
    total = once.join(by, "body").groupBy("template").agg(F.count("*").alias("n_texts"), F.sum("half").alias("half"), F.sum("some").alias("some"), F.max("general").alias("general"))
    near = 1e-6  # sums of fractions
    return total.where((F.col("half") >= docs - near) | ~F.col("general") & (F.col("some") >= docs - near) & (F.col("some") >= share * F.col("n_texts") - near))


def drop_lines(docs: DataFrame, depth: int = DEPTH, agree: float = AGREE, least: int = LEAST, n_docs: int = DOCS, share: float = SHARE) -> DataFrame:
    """docs with the lines of recurring templates taken out of text, plus lines_dropped (their number).

    Lines are parted by \\n and joined by it; blank lines stay. Null texts stay null, empty texts empty, with 0 dropped. A template that
    recurs inside one document only stays. Rows with the same id and text count as one document and get the same result; null ids are
    an id. An empty table stays empty. Other columns are kept as they are, n_chars
    included, whatever their names; lines_dropped replaces a column of that name.
    """
    x = docs.select("doc_id", "text")
    seen = spool(line_table(x, depth), "lines")
    by = spool(weights(seen), "weights")
    made = spool(templates(x, seen, by, depth, agree, least, n_docs, share), "general")
    narrow = seen.join(_small(made).select(F.col("line").alias("own"), "template"), F.col("line") == F.col("own"), "left")
    narrow = narrow.select("doc_id", "body", "at", F.col("own").isNotNull().alias("general"), F.coalesce("template", "line").alias("template"))
    narrow = spool(narrow, "templates")
    out = narrow.join(_small(spool(recurring(narrow, by, n_docs, share).select("template"), "recurring")), "template", "left_semi")
    out = out.groupBy("doc_id", "body").agg(F.collect_set("at").alias("out")).select(F.col("doc_id").alias("out_id"), F.col("body").alias("out_body"), "out")
    x, at = numbered(docs)
    x = x.withColumn("own_body", F.xxhash64(at["text"])).join(out, F.col(at["doc_id"]).eqNullSafe(F.col("out_id")) & (F.col("own_body") == F.col("out_body")), "left")
    kept = F.array_join(F.filter(F.split(at["text"], "\n"), lambda y, i: ~F.array_contains("out", i)), "\n")
    text = F.when(F.col("out").isNotNull(), kept).otherwise(F.col(at["text"]))
    x = x.withColumn(at["text"], text)
    return named(x, at, lines_dropped=F.coalesce(F.size("out"), F.lit(0)))
