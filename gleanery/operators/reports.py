"""Text quality, bibliographies, page texts, and run reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx

# ---- fixed values: text-quality limits ----
BLANK, LOW, GOOD = 10, 80, 180


def text_quality(pages: DataFrame) -> DataFrame:
    """source_id, counts over its pages (source_id, page, text), and level ok, warn or bad."""
    counted = pages.select("source_id", "page", F.regexp_count("text", F.lit(r"[\p{L}\p{N}]")).alias("n"), F.length("text").alias("chars"), F.regexp_count("text", F.lit("[\\x00-\\x08\\x0B\\x0E-\\x1F�□■▯]")).alias("odd"))
    rows = counted.groupBy("source_id").agg(
        F.count("*").alias("n_pages"), F.count_if(F.col("n") >= LOW).alias("extractable"), F.count_if(F.col("n") < LOW).alias("low"), F.count_if(F.col("n") < BLANK).alias("blank"),
        F.sum("n").alias("total"), F.sum("odd").alias("odd"), (F.sum("chars") + F.count("*") - 1).alias("chars"),
    )
    rows = rows.withColumn("average", F.floor(F.col("total") / F.col("n_pages") + 0.5).cast("long")).withColumn("odd_ratio", F.col("odd") / F.greatest("chars", F.lit(1)))
    good, low = F.col("extractable") / F.col("n_pages"), F.col("low") / F.col("n_pages")
    bad = (F.col("total") == 0) | (good < 0.35) | (F.col("average") < LOW) | (F.col("odd_ratio") >= 0.08)
    weak = (good < 0.7) | (low > 0.25) | (F.col("average") < GOOD) | (F.col("odd_ratio") >= 0.03)
    return rows.withColumn("level", F.when(bad, "bad").when(weak, "warn").otherwise("ok"))


def quality_gate(rows: DataFrame, quality: DataFrame) -> DataFrame:
    """Rows of sources that aren't bad."""
    return rows.join(quality.where("level = 'bad'").select("source_id"), "source_id", "left_anti")


def html_text(pages: DataFrame) -> DataFrame:
    """page_id, text: lines of raw HTML, without scripts, styles, comments and tags."""
    text = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"(?i)</p>|<br\s*/?>|</h[1-6]>|</li>", "\n"), r"<[^>]*>", " ")
    lines = F.filter(F.transform(F.split(text, "\n"), tx.one_line), lambda x: x != "")
    return pages.select("page_id", F.array_join(lines, "\n").alias("text"))


def page_cleanup(text: Column) -> Column:
    """No blanks before newlines, at most two newlines in a row, none at the end."""
    text = F.regexp_replace(F.regexp_replace(text, "[ \t]+\n", "\n"), "\n{3,}", "\n\n")
    return F.regexp_replace(text, r"\s+\z", "")


def bibliography(sources: DataFrame) -> DataFrame:
    """source_id, title, author, translator, publisher, year, confidence, display_title: of each field the first fitting line.

    A title is the rest of the first line with "by", else the nearest fitting one of the five lines before it, else
    the first fitting line of all, else the file's name (column ``filename``, if ``sources`` has it).
    """
    name = F.col("filename") if "filename" in sources.columns else F.lit(None).cast("string")
    text = F.substring(F.regexp_replace("text", "\f", "\n"), 1, lx.BIB_CHARS)
    compact = tx.one_line(F.regexp_replace("raw", r"[\x00-\x1f]+", " "))
    lines = sources.select("source_id", F.posexplode(F.split(text, "\r?\n")).alias("ln", "raw")).select("source_id", "ln", compact.alias("line")).where("line <> ''")
    order = Window.partitionBy("source_id").orderBy("ln")
    lines = lines.withColumn("no", F.row_number().over(order)).where(F.col("no") <= lx.BIB_LINES)
    line = F.col("line")
    lines = lines.withColumn("fits", _title_candidate(line)).withColumn("noise", _noise(line)).withColumn("by", tx.has(line, lx.BIB_AUTHOR))
    before = F.last(F.when(F.col("fits"), line), ignorenulls=True).over(order.rowsBetween(-5, -1))
    rest = tx.trimmed(F.regexp_replace(line, tx.java(lx.BIB_AUTHOR), ""))
    by_title = F.coalesce(F.when(_title_candidate(rest), rest), before)
    author = tx.group(line, lx.BIB_AUTHOR, 1)
    for drop in lx.BIB_AUTHOR_DROPS:
        author = F.regexp_replace(author, tx.java(drop), "")
    labelled = lambda pattern: _clamped(tx.group(line, pattern, 1), lx.BIB_FIELD)
    fields = {
        "author_ko": F.when(tx.has(line, lx.BIB_AUTHOR_KO), labelled(lx.BIB_AUTHOR_KO)),
        "author_en": F.when(F.col("by"), tx.let(_clamped(author, lx.BIB_FIELD), lambda x: F.when((x != "") & ~_noise(x), x))),
        "translator_ko": F.when(tx.has(line, lx.BIB_TRANSLATOR_KO), labelled(lx.BIB_TRANSLATOR_KO)),
        "translator_en": F.when(tx.has(line, lx.BIB_TRANSLATOR), labelled(lx.BIB_TRANSLATOR)),
        "publisher_ko": F.when(tx.has(line, lx.BIB_PUBLISHER_KO), labelled(lx.BIB_PUBLISHER_KO)),
        "publisher_en": F.when(~F.col("noise") & tx.has(line, lx.BIB_PUBLISHER), _clamped(line, lx.BIB_FIELD)),
        "year": F.when(tx.has(line, lx.BIB_YEAR), tx.group(line, lx.BIB_YEAR, 1)),
        "first_title": F.when(F.col("fits") & (F.col("no") <= lx.BIB_TITLE_LINES), _clamped(line, lx.BIB_TITLE)),
    }
    marked = lines.select("source_id", "no", *[v.alias(k) for k, v in fields.items()], F.when(F.col("by"), F.struct("no", _clamped(by_title, lx.BIB_TITLE).alias("title"))).alias("by_line"))
    first = [F.min_by(k, F.when(F.col(k).isNotNull(), F.col("no"))).alias(k) for k in fields]
    found = sources.select("source_id", name.alias("filename")).join(marked.groupBy("source_id").agg(*first, F.min("by_line").alias("by_line")), "source_id", "left")
    either = lambda a, b: F.coalesce(F.nullif(F.col(a), F.lit("")), F.col(b))
    title = F.coalesce("by_line.title", "first_title")
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("filename", r"\.[^.]+\z", ""), r"[_\-]+", " "), r"\s*\(\d+\)\s*\z", "")
    file_title = F.coalesce(F.nullif(_clamped(bare, 140), F.lit("")), F.col("filename"))
    file_year = F.nullif(tx.group(F.col("filename"), lx.BIB_YEAR, 1), F.lit(""))
    found = found.select(
        "source_id", F.coalesce(title, file_title).alias("title"), either("author_ko", "author_en").alias("author"), either("translator_ko", "translator_en").alias("translator"),
        either("publisher_ko", "publisher_en").alias("publisher"), F.coalesce("year", file_year).alias("year"), F.when(title.isNotNull(), "heuristic").otherwise("filename_fallback").alias("confidence"),
    )
    return found.withColumn("display_title", display_title())


def display_title() -> Column:
    """Title, author, translator, publisher and year in one line."""
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    parts = F.concat_ws(" · ", some("author"), F.concat(F.lit("역자 "), some("translator")), some("publisher"), some("year"))
    base = F.coalesce(some("title"), F.lit("제목 미상"))
    return F.when(parts == "", base).otherwise(_clamped(F.concat(base, F.lit(" — "), parts), lx.BIB_DISPLAY))


def _clamped(value: Column, most: int) -> Column:
    clean = F.regexp_replace(tx.one_line(F.regexp_replace(value, r"[\x00-\x1f]+", " ")), tx.java(lx.BIB_TRIM), "")
    return tx.let(clean, lambda c: F.when(F.length(c) > most, F.concat(tx.trimmed(F.substring(c, 1, most - 1)), F.lit("…"))).otherwise(c))


def _noise(line: Column) -> Column:
    return reduce(lambda a, b: a | b, [tx.has(line, p) for p in lx.BIB_NOISE])


def _title_candidate(line: Column) -> Column:
    fits = F.length(line).between(6, lx.BIB_TITLE) & (F.regexp_count(line, F.lit("[0-9]")) <= 0.35 * F.length(line))
    return reduce(lambda a, b: a & ~b, [tx.has(line, p) for p in lx.BIB_NOT_TITLE], fits & ~_noise(line))


def sniffed(files: DataFrame) -> DataFrame:
    """path, detected, accepted, reason of binary files (path, length, content): head bytes against the name's ending."""
    head = lambda n: F.hex(F.substring("content", 1, n))
    found = F.when(head(5) == "255044462D", "pdf").when(head(2) == "4D5A", "exe").when(head(4) == "7F454C46", "elf").when(head(4) == "504B0304", "zip").when(F.expr("is_valid_utf8(content)"), "text").otherwise("binary")
    name = F.lower("path")
    wanted = F.when(name.endswith(".pdf"), "pdf").when(name.endswith(".md") | name.endswith(".markdown") | name.endswith(".txt"), "text")
    rows = files.select("path", "length", found.alias("detected"), wanted.alias("wanted"))
    reason = F.when(F.col("length") == 0, "empty").when(F.col("wanted").isNull(), "type").when(F.col("wanted") != F.col("detected"), "content")
    return rows.select("path", "detected", reason.isNull().alias("accepted"), F.coalesce(reason, F.lit("")).alias("reason"))


def step_judgement(scored: DataFrame) -> DataFrame:
    """candidate_id, step, status: created, structure, anchor, mapping and import of each candidate (anchored, mapped: booleans)."""
    step = lambda no, name, ok: F.struct(F.lit(no).alias("no"), F.lit(name).alias("step"), F.when(ok, "pass").otherwise("fail").alias("status"))
    steps = F.array(step(1, "created", F.lit(True)), step(2, "structure", F.col("reason").isNull()), step(3, "anchor", F.col("anchored")), step(4, "mapping", F.col("mapped")), step(5, "import", F.col("action") != "ignore"))
    return scored.select("candidate_id", F.explode(steps).alias("s")).select("candidate_id", "s.no", "s.step", "s.status")


def entry_summary(entries: DataFrame) -> DataFrame:
    """source_id, id, title, status, node, n_claims: the entries of each source that they are from."""
    return entries.select(F.explode("source_ids").alias("source_id"), "id", "title", "status", F.col("outline_node_id").alias("node"), F.size("claims").cast("long").alias("n_claims"))


def redacted(report: DataFrame, debug: bool = False, hidden: tuple[str, ...] = ("raw", "filename", "path", "batch")) -> DataFrame:
    """A report without what may not leave: raw responses, names and paths of files, numbers of batches; all of it with ``debug``."""
    return report if debug else report.drop(*hidden)


def hidden_entries(entries: DataFrame) -> DataFrame:
    """id, reason: entries that are structure instead of knowledge."""
    said = F.array_join(F.transform("claims", lambda c: F.concat_ws("\n", F.nullif(c["statement"], F.lit("")), F.nullif(c["original_text"], F.lit("")), F.nullif(c["translated_text"], F.lit("")))), "\n")
    rows = entries.select("id", "title", said.alias("said"), F.lit("other").alias("type"))
    return tx.only(tx.with_structural_reason(rows, "type", "title", F.lit(""), F.col("said")), F.col("reason").isNotNull()).select("id", "reason")


def sized_report(rows: DataFrame, sizes: tuple[int, ...] = (40, 10, 3, 0), most: int = 48_000) -> DataFrame:
    """source_id, kept, report: JSON of a source's first rows (source_id, item), of the largest preset that fits ``most`` characters."""
    order = Window.partitionBy("source_id").orderBy("item")
    held = rows.withColumn("no", F.row_number().over(order)).where(F.col("no") <= max(sizes))
    grouped = held.groupBy("source_id").agg(F.array_sort(F.collect_list("item")).alias("items"))
    forms = [(n, F.to_json(F.struct(F.slice("items", 1, n).alias("items")))) for n in sizes]
    chosen = F.coalesce(*[F.when(F.length(j) <= most, F.struct(F.lit(n).alias("kept"), j.alias("report"))) for n, j in forms])
    return grouped.select("source_id", chosen.alias("c")).select("source_id", "c.kept", "c.report")


def tallied(rows: DataFrame, key: str, measures: list[str]) -> DataFrame:
    """``key``, ``n`` and for each measure a list of {k, n} by k, counted over all grains in one pass.

    The grains are grouping sets, so a key of any size is summed in parts before it is brought together; what is gathered
    for a key is one row for each value of a measure.
    """
    sets = [[key], *[[key, m] for m in measures]]
    grains = rows.groupingSets(sets, key, *measures).agg(F.count("*").alias("n"), F.grouping_id(key, *measures).alias("grain"))
    # a bit of the id is set for each column that a grain leaves out
    bits = [1 << i for i in reversed(range(len(measures)))]
    whole = sum(bits)
    held = lambda bit, m: F.array_sort(F.collect_list(F.when(F.col("grain") == whole - bit, F.struct(F.coalesce(F.col(m), F.lit("none")).alias("k"), "n"))))
    return grains.groupBy(key).agg(F.max(F.when(F.col("grain") == whole, F.col("n"))).alias("n"), *[held(b, m).alias(m) for b, m in zip(bits, measures)])


def run_reports(cards: DataFrame, pages: DataFrame, batches: DataFrame) -> DataFrame:
    """source_id, report (JSON): what a run found in each source.

    From cards (source_id, type, action, decision), pages (source_id, page), and batches (source_id, status), with failures
    by kind: what isn't ``ok`` or ``recovered``.
    """
    found = tallied(cards, "source_id", ["type", "action", "decision"])
    last = pages.groupBy("source_id").agg(F.max("page").alias("pages"))
    ran = tallied(batches.withColumn("failure", F.when(~F.col("status").isin("ok", "recovered"), F.col("status"))), "source_id", ["failure"]).withColumnsRenamed({"n": "batches"})
    joined = last.join(found, "source_id", "full_outer").join(ran, "source_id", "full_outer")
    none = F.array().cast("array<struct<k: string, n: bigint>>")
    lists = [F.coalesce(c, none).alias(f"by_{c}") for c in ("type", "action", "decision")]
    failures = F.filter(F.coalesce("failure", none), lambda x: x["k"] != "none").alias("failures")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias("cards" if c == "n" else c)
    return joined.select("source_id", F.to_json(F.struct(F.col("source_id").alias("source"), count("pages"), count("n"), *lists, count("batches"), failures)).alias("report"))
