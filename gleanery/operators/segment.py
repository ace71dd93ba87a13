"""Segmentation: lines, paragraphs, prose blocks, chunks, Markdown blocks, outlines.

All windows are partitioned by ``source_id``; offsets are code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from . import cuts


def _order():
    return Window.partitionBy("source_id").orderBy("ln")


def _before():
    return _order().rowsBetween(Window.unboundedPreceding, -1)


#: What :func:`lines` may tell beside: lines that may be short noise.
MAY_BE_NOISE = {"may_be_noise": lambda line: F.coalesce(tx.may_have(F.when(F.length(tx.trimmed(line)) < lx.PROSE, line), *[p for ps in lx.DEMOTIONS.values() for p in ps]), F.lit(False))}


def told(rows: DataFrame, name: str) -> Column:
    """The column ``name`` of what lines() told; true if it wasn't asked."""
    return F.col(name) if name in rows.columns else F.lit(True)


def lines(sources: DataFrame, *keep: str, tell: dict | None = None) -> DataFrame:
    """source_id, ln from 0, begin, stop, line, and the columns ``keep`` of the source. One row a line; offsets are running sums.

    ``tell`` (name: function of the line) is judged before lines are dealt by source: behind a Python function Spark deals them anew.
    """
    split = sources.select("source_id", *keep, F.posexplode(F.split(tx.normalized("text"), "\n")).alias("ln", "line"))
    split, keep = split.select("*", *[f(F.col("line")).alias(n) for n, f in (tell or {}).items()]), (*keep, *(tell or {}))
    begin = F.coalesce(F.sum(F.length("line") + 1).over(_before()), F.lit(0)).cast("long")
    return split.withColumn("begin", begin).select("source_id", "ln", "begin", (F.col("begin") + F.length("line")).alias("stop"), "line", *keep)


def line_context(sources: DataFrame) -> DataFrame:
    """Each line with its neighbours of at most 260 characters, cleaned and cut."""
    near = lambda c: F.when(F.length(tx.trimmed(c)).between(1, lx.CONTEXT_LINE), tx.trimmed(c))
    own = tx.trimmed(F.col("line"))
    parts = F.array_compact(F.array(near(F.lag("line").over(_order())), F.when(own != "", own), near(F.lead("line").over(_order()))))
    return lines(sources).select("source_id", "ln", tx.clean_evidence(F.array_join(parts, "\n")).alias("context"))


def islands(marked: DataFrame, breaks: Column, inside: Column) -> DataFrame:
    """Rows for which ``inside`` holds, with ``island``: a running count of ``breaks``."""
    return marked.withColumn("island", F.sum(breaks.cast("int")).over(_order())).where(inside)


def merged(rows: DataFrame, *more: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """One row for each island (and values of ``by``): first and last line, begin, stop and the text between."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ln", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy("source_id", "island", *by).agg(F.min("ln").alias("first_line"), F.max("ln").alias("last_line"), F.min("begin").alias("begin"), F.max("stop").alias("stop"), text.alias("text"), *more)


def paragraphs(sources: DataFrame) -> DataFrame:
    blank = tx.trimmed(F.col("line")) == ""
    return merged(islands(lines(sources), blank, ~blank)).drop("island")


def prose_blocks(marked: DataFrame) -> DataFrame:
    """Blocks of lines not ``consumed``; blank lines, short noise and sentence ends separate them. ``marked`` has the columns of lines() and ``consumed``."""
    return line_blocks(marked).where("not consumed").drop("consumed")


def line_blocks(marked: DataFrame, *more: Column) -> DataFrame:
    """The blocks of prose_blocks(), and each ``consumed`` line as a block of its own, told by ``consumed``; ``more`` is gathered beside. Lines that follow none of ``marked`` are told by ``starts``, if some are left out."""
    clean = F.col("_clean")
    # only short lines are judged as noise, and only those that may be noise meet its patterns
    flagged = marked.withColumn("_clean", tx.trimmed(F.col("line"))).withColumn("_short", F.when((F.length("_clean") < lx.PROSE) & told(marked, "may_be_noise"), clean)).withColumn("_low", F.lower("_short"))
    noise = F.col("_short").isNotNull() & tx.demoted(F.col("_short"), F.col("_low"))
    flagged = flagged.withColumn("apart", F.col("consumed") | (clean == "") | noise)
    # the text is trimmed, so its last two characters tell how it ends
    flagged = flagged.withColumn("ends", tx.has(F.substring(clean, -2, 2), lx.SENTENCE_END)).drop("_clean", "_short", "_low")
    breaks = F.col("apart") | F.coalesce(F.lag("ends").over(_order()), F.lit(False)) | (F.col("starts") if "starts" in marked.columns else F.lit(False))
    return merged(islands(flagged, breaks, ~F.col("apart") | F.col("consumed")), *more, by=("consumed",)).drop("island")


def semantic_blocks(sources: DataFrame) -> DataFrame:
    """Blocks between headings (Markdown only), blank lines and form feeds, with their heading path. ``sources`` may have ``kind``; without it all are plain."""
    if "kind" not in sources.columns:
        return cuts.plain_blocks(sources)
    headed = F.coalesce(F.col("kind") == "markdown", F.lit(False))
    return _headed_blocks(sources.where(headed)).unionByName(cuts.plain_blocks(sources.where(~headed)))


def _headed_blocks(sources: DataFrame) -> DataFrame:
    cut = lines(sources, "kind").select("source_id", "kind", "ln", "begin", F.posexplode(F.split("line", "\f")).alias("part", "line"))
    at = Window.partitionBy("source_id", "ln").orderBy("part")
    begin = F.col("begin") + F.coalesce(F.sum(F.length("line") + 1).over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = cut.withColumn("begin", begin).withColumn("stop", F.col("begin") + F.length("line")).withColumn("feed", F.col("part") > 0)
    order = Window.partitionBy("source_id").orderBy("ln", "part")
    level = F.when(F.col("kind") == "markdown", F.length(tx.group(F.col("line"), r"\A(#{1,6})\s+([^\n]*)\z", 1)))
    cut = cut.withColumn("level", F.when(level > 0, level)).withColumn("title", tx.trimmed(tx.group(F.col("line"), r"\A(#{1,6})\s+([^\n]*)\z", 2)))
    cut = cut.withColumn("no", F.row_number().over(order))
    for k in range(1, 7):
        cut = cut.withColumn(f"h{k}", F.last(F.when(F.col("level") == k, F.struct("no", "title")), ignorenulls=True).over(order))
    above = lambda k: F.greatest(F.lit(0), F.lit(0), *[F.coalesce(F.col(f"h{j}.no"), F.lit(0)) for j in range(1, k)])
    path = F.array_compact(F.array(*[F.when(F.col(f"h{k}.no") > above(k), F.col(f"h{k}.title")) for k in range(1, 7)]))
    apart = F.col("level").isNotNull() | (tx.trimmed(F.col("line")) == "")
    cut = cut.withColumn("path", path).withColumn("apart", apart)
    cut = cut.withColumn("island", F.sum((F.col("apart") | F.col("feed")).cast("int")).over(order)).where(~F.col("apart"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "line"))), lambda x: x["line"]), "\n")
    return cut.groupBy("source_id", "island").agg(F.min("begin").alias("begin"), F.max("stop").alias("stop"), text.alias("text"), F.min_by("path", "no").alias("path")).drop("island")


def windows_of(text: Column, most: int) -> Column:
    """Greedy windows over the lines of a block: array of (s, e). A window ends at the last newline that it reaches, or after ``most`` characters."""
    line_ends = F.split(text, "\n")
    piece = lambda s, e: F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"))
    start = F.struct(F.lit(0).alias("cs"), F.lit(-1).alias("fit"), F.lit(0).alias("pos"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))

    def step(a: Column, line: Column) -> Column:
        end = a["pos"] + F.length(line)
        over = (end - a["cs"] > most) & (a["fit"] > a["cs"])
        cs = F.when(over, a["fit"] + 1).otherwise(a["cs"])
        out = F.when(over, F.array_append(a["out"], piece(a["cs"], a["fit"]))).otherwise(a["out"])
        k = F.greatest(F.floor((end - cs - 1) / most), F.lit(0)).cast("int")
        full = F.when(k > 0, F.transform(F.sequence(F.lit(0), F.greatest(k, F.lit(1)) - 1), lambda i: piece(cs + i * most, cs + (i + 1) * most))).otherwise(F.array().cast("array<struct<s:int,e:int>>"))
        return F.struct((cs + k * most).cast("int").alias("cs"), end.cast("int").alias("fit"), (end + 1).cast("int").alias("pos"), F.concat(out, full).alias("out"))

    return F.aggregate(line_ends, start, step, lambda a: F.when(a["fit"] > a["cs"], F.array_append(a["out"], piece(a["cs"], a["fit"]))).otherwise(a["out"]))


def chunks(sources: DataFrame, most: int = lx.CHUNK_CHARS) -> DataFrame:
    """source_id, ord, chunk_id, path, begin, stop, text, content_hash, n_text (characters of the trimmed text): verbatim slices of at most ``most`` characters of :func:`semantic_blocks`.

    What is told of the texts is told before they are dealt by source: who doesn't read them doesn't deal them.
    """
    blocks = semantic_blocks(sources)
    spans = F.when(F.length("text") <= most, F.array(F.struct(F.lit(0).alias("s"), F.length("text").alias("e")))).otherwise(windows_of(F.col("text"), most))
    cut = blocks.select("source_id", "begin", "path", "text", F.explode(spans).alias("w"))
    cut = cut.select("source_id", (F.col("begin") + F.col("w.s")).alias("begin"), (F.col("begin") + F.col("w.e")).alias("stop"), "path", F.expr("substring(text, w.s + 1, w.e - w.s)").alias("text"))
    cut = cut.withColumn("n_text", F.length(tx.trimmed(F.col("text")))).withColumn("content_hash", F.substring(F.sha2("text", 256), 1, 16))
    cut = cut.withColumn("ord", F.row_number().over(Window.partitionBy("source_id").orderBy("begin")) - 1).where("n_text > 0")
    ids = F.substring(F.sha2(F.concat_ws(":", "source_id", "ord", "begin", "stop"), 256), 1, 16)
    return cut.select("source_id", "ord", ids.alias("chunk_id"), "path", "begin", "stop", "text", "content_hash", "n_text")


def page_documents(pages: DataFrame) -> DataFrame:
    """source_id, text, page_starts of pages (source_id, page, text): pages joined by form feeds, and where each begins."""
    ordered = F.array_sort(F.collect_list(F.struct("page", tx.normalized("text").alias("text"))))
    texts = F.transform("pages", lambda p: p["text"])
    starts = F.transform("pages", lambda p, i: F.aggregate(F.slice(texts, F.lit(1), i), F.lit(0), lambda a, t: a + F.length(t) + 1))
    return pages.groupBy("source_id").agg(ordered.alias("pages")).select("source_id", F.array_join(texts, "\f").alias("text"), starts.alias("page_starts"))


def with_page(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """``rows`` (source_id, begin, ...) with ``page``, from 1: the last that begins at or before them; null without pages."""
    page = F.size(F.filter("page_starts", lambda p: p <= F.col("begin")))
    return rows.join(documents.select("source_id", "page_starts"), "source_id", "left").withColumn("page", F.when(page > 0, page)).drop("page_starts")


def chunk_batches(cut: DataFrame, size: int = lx.BATCH_CHUNKS) -> DataFrame:
    """``cut`` with ``batch``: consecutive groups of ``size`` chunks of a source."""
    return cut.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy("source_id").orderBy("ord")) - 1) / size).cast("int"))


def markdown_blocks(sources: DataFrame) -> DataFrame:
    """source_id, kind, level, first_line, last_line, begin, stop, raw: blocks of Markdown lines.

    Fences hide all in them, an unclosed one to the end; quote lines join; a run
    of other lines is a list up to its first line that is neither an item nor
    indented, and a paragraph from there.
    """
    line = F.col("line")
    fence = line.rlike(r"\A```")
    marked = lines(sources).withColumn("fence", fence).withColumn("n_fence", F.sum(F.col("fence").cast("int")).over(_order()))
    total = F.max("n_fence").over(Window.partitionBy("source_id"))
    in_fence = (F.col("n_fence") % 2 == 1) | F.col("fence")
    unclosed = in_fence & (F.col("n_fence") == total) & (total % 2 == 1)
    kind = (
        F.when(unclosed, "dropped")
        .when(in_fence, "code")
        .when(tx.trimmed(line) == "", "blank")
        .when(line.rlike(r"\A\s*(?:-{3,}|\*{3,}|_{3,})\s*\z"), "hr")
        .when(tx.has(line, r"\A#{1,6}\s+[^\n]*\z"), "heading")
        .when(line.rlike(r"\A>"), "blockquote")
        .otherwise("run")
    )
    marked = marked.withColumn("kind", kind).withColumn("fence_no", F.when(F.col("kind") == "code", F.floor((F.col("n_fence") - F.when(F.col("fence") & (F.col("n_fence") % 2 == 0), 1).otherwise(0)) / 2)))
    changed = ~F.lag("kind").over(_order()).eqNullSafe(F.col("kind")) | F.col("kind").isin("heading", "hr") | ~F.lag("fence_no").over(_order()).eqNullSafe(F.col("fence_no"))
    marked = marked.withColumn("island", F.sum(changed.cast("int")).over(_order())).where(~F.col("kind").isin("blank", "dropped"))
    item = line.rlike(r"\A\s*(?:[-*+]|\d+\.)\s+")
    run = Window.partitionBy("source_id", "island")
    first_item = F.min_by(item, "ln").over(run)
    not_list = F.min(F.when(~item & ~line.rlike(r"\A\s{2,}\S"), F.col("ln"))).over(run)
    in_list = first_item & (F.col("ln") < F.coalesce(not_list, F.lit(2**31 - 1)))
    marked = marked.withColumn("kind", F.when(F.col("kind") == "run", F.when(in_list, "list").otherwise("paragraph")).otherwise(F.col("kind")))
    level = F.when(F.col("kind") == "heading", F.length(F.regexp_extract("line", r"\A(#{1,6})", 1)))
    raw = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ln", "line"))), lambda x: x["line"]), "\n")
    grouped = marked.withColumn("level", level).groupBy("source_id", "island", "kind")
    return grouped.agg(F.first("level").alias("level"), F.min("ln").alias("first_line"), F.max("ln").alias("last_line"), F.min("begin").alias("begin"), F.max("stop").alias("stop"), raw.alias("raw")).drop("island")


def heading_paths(sources: DataFrame) -> DataFrame:
    """The heading path of each semantic block of Markdown sources; fences don't hide headings here."""
    return semantic_blocks(sources.withColumn("kind", F.lit("markdown"))).select("source_id", "begin", "stop", F.array_join("path", " > ").alias("path"))


def outline(outlines: DataFrame) -> DataFrame:
    """source_id, node_id, ord, level, label, title, parent, from indented, numbered or marked lines."""
    line = F.col("line")
    depth = F.length(F.regexp_replace(F.regexp_extract("line", r"\A([ \t]*)", 1), "\t", "  "))
    body = tx.trimmed(line)
    rules = [
        (r"\A(#{1,6})\s+(.+)\z", F.length(F.regexp_extract(body, r"\A(#{1,6})", 1)), F.lit(None).cast("string")),
        (r"\A(제\s*\d+\s*([장절항]))\s*(.*)\z", F.when(F.regexp_extract(body, r"\A제\s*\d+\s*([장절항])", 1) == "장", 1).when(F.regexp_extract(body, r"\A제\s*\d+\s*([장절항])", 1) == "절", 2).otherwise(3), F.regexp_extract(body, r"\A(제\s*\d+\s*[장절항])", 1)),
        (r"\A(\d+(?:\.\d+)*)[.)]?\s+(.+)\z", F.size(F.split(F.regexp_extract(body, r"\A(\d+(?:\.\d+)*)", 1), r"\.")), F.regexp_extract(body, r"\A(\d+(?:\.\d+)*)", 1)),
        (r"\A[-*+•]\s+(.+)\z", F.floor(depth / 2).cast("int") + 1, F.lit(None).cast("string")),
    ]
    level, label, title = F.floor(depth / 2).cast("int") + 1, F.lit(None).cast("string"), body
    for pattern, at, name in reversed(rules):
        hit = body.rlike(pattern)
        last = {0: r"\A#{1,6}\s+(.+)\z", 1: r"\A제\s*\d+\s*[장절항]\s*(.*)\z", 2: r"\A\d+(?:\.\d+)*[.)]?\s+(.+)\z", 3: r"\A[-*+•]\s+(.+)\z"}[[r[0] for r in rules].index(pattern)]
        level, label = F.when(hit, at).otherwise(level), F.when(hit, name).otherwise(label)
        title = F.when(hit, F.regexp_extract(body, last, 1)).otherwise(title)
    nodes = lines(outlines).where(tx.trimmed(line) != "").select("source_id", "ln", F.least(level, F.lit(9)).cast("int").alias("level"), label.alias("label"), title.alias("title"))
    nodes = nodes.withColumn("ord", F.row_number().over(_order())).withColumn("title", F.when(F.col("title") == "", F.col("label")).otherwise(F.col("title")))
    levels = F.array(*[F.struct(F.last(F.when(F.col("level") == k, F.col("ord")), ignorenulls=True).over(_order().rowsBetween(Window.unboundedPreceding, -1)).alias("o"), F.lit(k).alias("k")) for k in range(1, 9)])
    nodes = nodes.withColumn("open", levels)
    parent = F.array_max(F.transform(F.filter("open", lambda x: (x["k"] < F.col("level")) & x["o"].isNotNull()), lambda x: x["o"]))
    return nodes.select("source_id", F.concat(F.lit("n"), "ord").alias("node_id"), "ord", "level", "label", "title", F.when(parent.isNotNull(), F.concat(F.lit("n"), parent)).alias("parent"))
