"""Line dedup by a segment-partition edit join.

Two lines are linked if they are within ``TAU`` edits and a similarity of 0.8: an
edit for each whole ``PER_EDIT`` code points of the shorter one at most, so that
lines under ``PER_EDIT`` are linked by equality alone.  Linked lines are one class,
as far as links reach; of a class the first line in document order stays.

A line is cut into a segment more than it may have edits.  Of the segments of two
linked lines one is untouched, with at most i - 1 edits before the i-th and as many
after it as segments.  So the first segment is looked up at the line's begin, the
last counted from its end, and the middle one, less its last code point, where it
begins and a place later: of two lines one has the other's there.  Segments are
laid out by classes of length, and a line so near the end of its class that
linked lines may lie beyond also probes the next class.  Candidates share an
indexed segment.  They are verified by equal leading and trailing blocks, then by a
bit-parallel simulation of the 2 * TAU + 1 diagonals around the main one.

A segment that more than ``GROUP`` lines share says little of them.  Two linked
lines with a first (or last) segment in common are as many edits apart as what is
left of them, so the rest is cut into segments again, and so on while groups are
large; with the middle one in common there is one edit on either side, and one
half of either side is untouched, so the side that differs more is halved.  What is
left in groups that can't be refined any more, as their lines have next to
nothing of their own, is dealt in tiles.  Neighbours in text order are linked first, and
then only pairs of different classes are verified, so that dense groups don't emit all
their pairs.  A pair is verified if as few of the lines' 256 bigram bits differ as the
edits may change.  All steps are DataFrame operations.

Cases: null and blank lines are never duplicates; lines are compared without
the white space at their ends; repeated rows are duplicates of each other; ties
go by id, line number, then a hash of the row, then the number of the repeated row; an
empty table gives no rows; a line of any length is compared whole.  Columns of
``docs`` keep their names and values in ``keep_first_lines``, whatever they are
called.  Equal lines are told by a 64-bit hash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, may_be_in, packed
from .components import components

TAU = 2
#: Code points of the shorter line for each edit.
PER_EDIT = 5
TILE = 128
#: Classes of lines of a segment that are compared with each other.
GROUP = 512
#: Rows of a line, in the mean, up to which groups are refined.
COPIES = 64
_BLOCK = 32
_ENDS = " \t\r\x0b\x0c"


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, doc_id, ln, line): the lines with a word, from 0, without white space at their ends."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.select(F.xxhash64(F.col(id_col), text).alias("key"), F.col(id_col).alias("doc_id"), F.posexplode(F.split(text, "\n")).alias("ln", "line"))
    return split.select("key", "doc_id", "ln", F.btrim("line", F.lit(_ENDS)).alias("line")).where("line <> ''")


def _class(size: Column) -> Column:
    """The least length of the lines laid out as one of ``size`` code points."""
    return F.when(size < 2 * PER_EDIT, F.lit(PER_EDIT)).when(size < 16, F.lit(2 * PER_EDIT)).when(size < 32, size - size % 4).otherwise(size - size % 16).cast("int")


#: What of a line a key leaves open: one part from ``c`` to ``d`` before the end, of ``y`` code points at least; or, if not ``one``, that and a part from ``a`` to ``b`` of ``x``.
_OPEN = ("one", "a", "b", "x", "c", "d", "y")


def _open(one: bool, **values) -> Column:
    return F.struct(F.lit(one).alias("one"), *[F.coalesce(values.get(n, F.lit(0)), F.lit(0)).cast("int").alias(n) for n in _OPEN[1:]])


def _entry(hashed: list[Column], index: Column, left: Column | None) -> Column:
    e = F.shiftleft(F.xxhash64(*hashed), 1).bitwiseOR(index.cast("long"))
    return e if left is None else F.struct(e.alias("e"), left.alias("open"))


def _segments(line: Column, opened: bool = True) -> Column:
    """The keys of a line, an array of (e, open), or of e alone; those with an odd number are indexed, the others only probe.

    A key behind the begin of the middle segment is met by one at it, of whichever class its line is.
    """
    size = F.length(line)
    own, above = _class(size), _class(size + TAU)

    def keys(cls: Column, indexed: bool, few: bool) -> list[Column]:
        """Of the class's layout: two segments if it has ``few``, else three."""
        width = F.lit(2) if few else F.floor(cls / 3).cast("int")
        entry = lambda i, at, n, index, left: _entry([cls, F.lit(i), F.substring(line, at, n)], F.lit(int(index)), left if opened else None)
        rest = F.lit(0) if few else cls - width
        ends = [entry(1, F.lit(1), width, indexed, _open(True, c=width, y=rest)), entry(3, size - width + 1, width, indexed, _open(True, d=width, y=rest))]
        middle = lambda s: _open(False, b=width + s, x=width, c=2 * width - 1 + s, y=cls - 2 * width)
        return ends if few else [*ends, entry(2, width + 1, width - 1, True, middle(0)), entry(2, width + 2, width - 1, False, middle(1))]

    none = F.slice(F.array(*keys(own, True, True)), 1, 0) if opened else F.array().cast("array<bigint>")
    beyond = F.when(above > own, F.array(*keys(above, False, False))).otherwise(none)
    short = F.concat(F.array(*keys(own, True, True)), beyond)
    return F.when(size < PER_EDIT, none).when(size < 2 * PER_EDIT, short).when(above > own, F.concat(F.array(*keys(own, True, False)), beyond)).otherwise(F.array(*keys(own, True, False)))


def _segment_keys(line: Column) -> Column:
    return _segments(line, False)


def _finer(left_first: Column) -> Column:
    """The keys of rows (k, line, index, open) inside their group, as _segments gives them; none if next to nothing is left open."""
    o, k, size, index = F.col("open"), F.col("k"), F.length("line"), F.col("index").cast("long")
    cut = lambda at, n: F.substring(F.col("line"), at + 1, n)
    w, h, g = F.floor(o["y"] / 3).cast("int"), F.floor(o["y"] / 2).cast("int"), F.floor(o["x"] / 2).cast("int")
    entry = lambda i, part, flag, left: _entry([k, F.lit(i), part], flag, left)
    middle = lambda s: _open(False, a=o["c"], b=o["c"] + w + s, x=w, c=o["c"] + 2 * w - 1 + s, d=o["d"], y=o["y"] - 2 * w)
    whole = F.array(
        entry(1, cut(o["c"], w), index, _open(True, c=o["c"] + w, d=o["d"], y=o["y"] - w)),
        entry(3, cut(size - o["d"] - w, w), index, _open(True, c=o["c"], d=o["d"] + w, y=o["y"] - w)),
        entry(2, cut(o["c"] + w, w - 1), F.lit(1), middle(0)),
        entry(2, cut(o["c"] + w + 1, w - 1), F.lit(0), middle(1)),
    )
    kept = {n: o[n] for n in _OPEN[1:]}
    side = lambda **new: _open(False, **(kept | new))
    left = F.array(entry(4, cut(o["a"], g), index, side(a=o["a"] + g, x=o["x"] - g)), entry(5, cut(o["b"] - g, g), index, side(b=o["b"] - g, x=o["x"] - g)))
    right = F.array(entry(6, cut(o["c"], h), index, side(c=o["c"] + h, y=o["y"] - h)), entry(7, cut(size - o["d"] - h, h), index, side(d=o["d"] + h, y=o["y"] - h)))
    none = F.slice(left, 1, 0)
    both = F.when((g >= 1) & ((h < 1) | left_first), left).when(h >= 1, right).otherwise(none)
    return F.when(o["one"] & (w >= 2), whole).when(o["one"], none).otherwise(both)


def _groups(keyed: DataFrame) -> DataFrame:
    """(k, n, kinds) of the keys of rows (k, lid, root, index) that lines of different classes share, one of them indexed; ``kinds`` is about the number of classes."""
    shared = keyed.groupBy("k").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.max("index").alias("index"), F.count("*").alias("n"), F.approx_count_distinct("root").alias("kinds"))
    return shared.where("least <> most and index").select("k", "n", "kinds")


def refined(hot: DataFrame, texts: DataFrame, group: int) -> DataFrame:
    """Rows (k, lid, root, index, n) in groups of up to ``group`` classes, or such as can't be refined, instead of ``hot`` (k, lid, root, index, n) from larger ones.

    A group goes on being refined while not all of its keys are met by all of its lines, and until a line has some
    ``COPIES`` rows; beyond that, which is a matter of cost alone, it stays as it is.
    """
    lines_ = texts.dropDuplicates(["lid"]).join(hot.select("lid").distinct(), "lid", "left_semi")
    segments = F.explode(F.filter(_segments(F.col("line")), lambda s: F.shiftright(s["e"], 1) == F.col("k"))).alias("s")
    hot = hot.join(lines_, "lid").select("k", "lid", "root", "n", "line", segments).select("k", "lid", "root", "n", "line", (F.col("s.e") % 2 != 0).alias("index"), "s.open")
    hot = checkpoint(hot)
    most, out, done = COPIES * hot.count(), ["k", "lid", "root", "index", "n"], []
    while not hot.isEmpty():
        # of two open parts, the one that more lines differ in
        o = F.col("open")
        parts = hot.where(~o["one"]).groupBy("k").agg(F.approx_count_distinct(F.expr("substring(line, open.a + 1, open.b - open.a)")).alias("l"), F.approx_count_distinct(F.expr("substring(line, open.c + 1, length(line) - open.d - open.c)")).alias("r"))
        finer = checkpoint(hot.join(parts.select("k", (F.col("l") >= F.col("r")).alias("left_first")), "k", "left").withColumn("ks", _finer(F.coalesce("left_first", F.lit(True)))))
        keyed = finer.select(F.col("k").alias("of"), F.col("n").alias("of_n"), "lid", "root", "line", F.size("ks").alias("n_ks"), F.explode("ks").alias("s")).select("of", "of_n", "n_ks", "lid", "root", "line", F.shiftright("s.e", 1).alias("k"), (F.col("s.e") % 2 != 0).alias("index"), "s.open")
        keyed = checkpoint(keyed.join(_groups(keyed), "k"))
        # a group whose lines meet in nearly all their keys again is dense: more keys would only copy it
        met = checkpoint(keyed.groupBy("of").agg((F.sum("n") >= F.first("of_n") * F.first("of_n") * F.first("n_ks") * 0.7).alias("dense")))
        if keyed.count() > most:
            done.append(hot.select(*out))
            break
        judged = finer.join(met.where("dense").select(F.col("of").alias("k"), "dense"), "k", "left")
        done.append(checkpoint(judged.where((F.size("ks") == 0) | F.col("dense")).select(*out)))
        keyed = checkpoint(keyed.join(met.where("not dense").select("of"), "of", "left_semi"))
        done.append(keyed.where(F.col("kinds") <= group).select(*out))
        hot = checkpoint(keyed.where(F.col("kinds") > group).select(*out, "line", "open"))
    return reduce(DataFrame.unionByName, done)


def with_bits(rows: DataFrame, large: Column) -> DataFrame:
    """``rows`` with 256 bits in four longs, one for the hash of each bigram of ``line``; null if not ``large``. An edit changes four at most."""
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length("line") - 1, F.lit(1))), lambda i: F.xxhash64(F.substring(F.col("line"), i, F.lit(2))))
    one = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 2).bitwiseAND(F.lit(63)).cast("int"))

    def bits(i: int) -> Column:
        return F.when(large, F.aggregate("grams", F.lit(0).cast("long"), lambda s, h: F.when(h.bitwiseAND(F.lit(3)) == i, s.bitwiseOR(one(h))).otherwise(s))).alias(f"s{i}")

    return rows.withColumn("grams", F.when(large, grams)).select(*rows.columns, *map(bits, range(4)))


def _same_ends() -> tuple[Column, Column]:
    """Hashes of a line's blocks from its begin, and from its end (reversed)."""
    blocks = lambda c: F.transform(F.regexp_extract_all(c, F.lit("(?s).{1,%d}" % _BLOCK), F.lit(0)), lambda b: F.xxhash64(b))
    return blocks(F.col("line")), blocks(F.reverse("line"))


def _verified(tau: int) -> str:
    """SQL: the lines of rows ``x`` and ``y`` are within ``tau`` edits and one for each ``PER_EDIT`` code points."""
    band = 2 * tau + 1
    mask = (1 << band) - 1
    head = "coalesce(nullif(array_position(zip_with(x.head, y.head, (p, q) -> p <=> q), false), 0) - 1, size(x.head))"
    tail = "coalesce(nullif(array_position(zip_with(x.tail, y.tail, (p, q) -> p <=> q), false), 0) - 1, size(x.tail))"
    least = "least(x.n, y.n)"
    limit = f"least({tau}, floor({least} / {PER_EDIT}))"
    cut = f"named_struct('h', cast(least({_BLOCK} * {head}, {least}) as int), 't', cast({_BLOCK} * {tail} as int))"
    mid = "named_struct('a', substring(x.line, c.h + 1, x.n - c.h - least(c.t, {0} - c.h)), 'b', substring(y.line, c.h + 1, y.n - c.h - least(c.t, {0} - c.h)))".format(least)
    # both ends of the middles differ within a block; with two edits at most what lies between is equal but for a shift of one
    inner = f"substring(m.a, {_BLOCK + 1}, length(m.a) - {2 * _BLOCK})"
    shifted = " or ".join(f"substring(m.b, {_BLOCK + 1 + s}, length(m.a) - {2 * _BLOCK}) = {inner}" for s in (0, -1, 1))
    quick = f"(length(m.a) <= {3 * _BLOCK} or {shifted})" if tau == 2 else "true"
    # r[d] has a bit for each diagonal reached with d edits or fewer; v.a and v.b are arrays of characters
    match = " | ".join(f"if(get(v.a, j - 1 + {k - tau}) <=> get(v.b, j - 1) and j - 1 + {k - tau} >= 0 and j - 1 + {k - tau} < size(v.a), {1 << k}, 0)" for k in range(band))
    state = [f"s.r{d}" for d in range(tau + 1)]
    steps = f"transform(array(named_struct('m', {match}, 's', s)), z -> "
    new = []
    for d in range(tau + 1):
        old = f"(z.{state[d]} & z.m)"
        new.append(old if d == 0 else f"(({old} | z.{state[d - 1]} | shiftright(z.{state[d - 1]}, 1) | shiftleft({new[d - 1]}, 1)) & {mask})")
    steps += "named_struct(" + ", ".join(f"'r{d}', {e}" for d, e in enumerate(new)) + "))[0]"
    start = "named_struct(" + ", ".join(f"'r{d}', {sum(1 << (tau + i) for i in range(d + 1))}" for d in range(tau + 1)) + ")"
    reached = "case " + " ".join(f"when least(x.n, y.n) < {PER_EDIT * (d + 1)} then s.r{d}" for d in range(tau)) + f" else s.r{tau} end"
    walk = f"aggregate(sequence(1, size(v.b)), {start}, (s, j) -> {steps}, s -> ({reached}) & shiftleft(1, size(v.a) - size(v.b) + {tau}) <> 0)"
    chars = "named_struct('a', if(m.a = '', array(), split(m.a, '')), 'b', if(m.b = '', array(), split(m.b, '')))"
    deep = f"case when m.a = m.b then true when size(v.b) = 0 then size(v.a) <= {limit} else {walk} end"
    let = lambda name, value, body: f"exists(array({value}), {name} -> {body})"
    return let("c", cut, let("m", mid, f"{quick} and abs(x.n - y.n) <= {limit} and " + let("v", chars, deep)))


def within(pairs: DataFrame, tau: int = TAU) -> DataFrame:
    """The rows of ``pairs`` (structs x, y with ``line``, ``n``, ``head``, ``tail``) whose lines are within ``tau`` edits."""
    return pairs.where(F.expr(f"abs(x.n - y.n) <= {tau} and {_verified(tau)}"))


def prepared(texts: DataFrame) -> DataFrame:
    head, tail = _same_ends()
    return texts.select("*", F.length("line").alias("n"), head.alias("head"), tail.alias("tail"))


def near_links(keyed: DataFrame, texts: DataFrame, tau: int = TAU) -> DataFrame:
    """(a, b): links between different lines that connect all linked ones, from their keys (lid, ks) and texts (lid, line); repeats may come."""
    keyed = keyed.select("lid", F.col("lid").alias("root"), F.explode("ks").alias("e")).select("lid", "root", F.shiftright("e", 1).alias("k"), (F.col("e") % 2 != 0).alias("index"))
    shared = keyed.groupBy("k").agg(F.min("lid").alias("least"), F.max("lid").alias("most"), F.max("index").alias("index"), F.count("*").alias("n_rows"))
    shared = checkpoint(shared.where("least <> most and index").select("k", "n_rows"))
    members = may_be_in(keyed, "k", shared.drop("n_rows"), shared.count()).groupBy("k", "lid").agg(F.max("index").alias("index")).join(shared, "k")
    members = checkpoint(members)
    texts = may_be_in(texts, "lid", members, members.count()).dropDuplicates(["lid"])
    rows = prepared(checkpoint(texts.join(members, "lid").select("k", "lid", "index", "n_rows", "line")))

    tiled = lambda df: df.withColumn("tiles", F.ceil(F.col("n_rows") / TILE).cast("int")).withColumn("tile", F.pmod(F.xxhash64("lid"), "tiles").cast("int"))
    one = F.struct("lid", "line", "n", "head", "tail")
    order = Window.partitionBy("k", "tile").orderBy("line")
    beside = tiled(rows).select(F.lag(one).over(order).alias("x"), one.alias("y")).where("x is not null and x.lid <> y.lid")
    first = within(beside, tau).select(F.col("x.lid").alias("a"), F.col("y.lid").alias("b"))
    known = components(first)

    rows = rows.join(known.withColumnRenamed("node", "lid"), "lid", "left").withColumn("root", F.coalesce("root", "lid"))
    large = checkpoint(rows.where(F.col("n_rows") > GROUP).groupBy("k").agg(F.approx_count_distinct("root").alias("kinds")).where(F.col("kinds") > GROUP).select("k"))
    if not large.isEmpty():
        hot = checkpoint(rows.join(large, "k", "left_semi"))
        finer = refined(hot.select("k", "lid", "root", "index", F.col("n_rows").alias("n")), hot.select("lid", "line"), GROUP).groupBy("k", "lid").agg(F.max("index").alias("index"), F.max("n").cast("long").alias("n_rows"))
        whole = hot.drop("k", "index", "n_rows").dropDuplicates(["lid"])
        rows = rows.join(large, "k", "left_anti").unionByName(whole.join(finer, "lid").select(*rows.columns))
    rows = with_bits(tiled(rows), F.col("n_rows") > TILE)
    one = F.struct("lid", "line", "n", "head", "tail", "root", "s0", "s1", "s2", "s3")
    spread = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    index = rows.where("index").select("k", F.col("tile").alias("i"), spread.alias("j"), one.alias("x"))
    probe = rows.select(F.col("k").alias("pk"), spread.alias("pi"), F.col("tile").alias("pj"), one.alias("y"), F.col("index").alias("both"))
    same = (F.col("k") == F.col("pk")) & (F.col("i") == F.col("pi")) & (F.col("j") == F.col("pj"))
    alike = " + ".join(f"bit_count(x.s{i} ^ y.s{i})" for i in range(4))
    alike = f"coalesce({alike} <= {4 * tau}, true)"
    # two indexed lines meet twice: one of the meetings is enough
    pairs = index.join(probe, same & F.expr(f"abs(x.n - y.n) <= {tau} and (not both or x.lid < y.lid) and x.root <> y.root and {alike} and {_verified(tau)}"))
    return first.unionByName(pairs.select(F.col("x.lid").alias("a"), F.col("y.lid").alias("b"))).unionByName(known.select(F.col("node").alias("a"), F.col("root").alias("b")))


def duplicate_lines(docs: DataFrame, tau: int = TAU, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, ln, near, all_rows; once for each row of a key): lines of classes with several.

    ``near`` if the class's first line is another text; ``all_rows`` if the line goes from all rows of
    its key, else it is the first of its class and goes from those after the first row only.
    """
    split = lines(docs, id_col, text_col).withColumn("lid", F.xxhash64("line"))
    placed = checkpoint(split.select("key", "doc_id", "ln", "lid", _segment_keys(F.col("line")).alias("ks")))
    at = F.struct(F.col("doc_id").isNull(), "doc_id", "ln", "key").alias("at")
    firsts = checkpoint(placed.select("lid", at).groupBy("lid").agg(F.min(F.struct("at", "lid")).alias("first"), F.count("*").alias("n")))
    classes = components(near_links(placed.select("lid", "ks"), split.select("lid", "line"), tau)).withColumnRenamed("node", "lid")
    rooted = firsts.join(classes, "lid", "left").where("n > 1 or root is not null").select("lid", "first", F.coalesce("root", "lid").alias("root"))
    leads = rooted.groupBy("root").agg(F.min("first").alias("lead"))
    judged = rooted.select("lid", "root").join(leads, "root").select("lid", F.col("lead.at").alias("lead"), (F.col("lead.lid") != F.col("lid")).alias("near"))
    again = placed.select("key", "ln", "lid", at).join(judged, "lid")
    return again.select("key", "ln", "near", F.expr("at <> lead").alias("all_rows"))


def _gone_by_key(docs: DataFrame, tau: int = TAU) -> DataFrame:
    return duplicate_lines(docs, tau).groupBy("key").agg(F.array_sort(F.collect_set(F.struct("ln", "near", "all_rows"))).alias("line_gone"))


def _row_no(key: str) -> Column:
    """Numbers rows of equal id and text, from 1."""
    return F.row_number().over(Window.partitionBy(key).orderBy(key))


#: SQL: the lines to remove from a row.
_GONE = "filter(line_gone, g -> g.all_rows or line_row_no > 1)"


def keep_first_lines(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """``docs`` (doc_id, text, ...) without their duplicate lines; rows that had words and lose them all go."""
    numbered = packed(docs).withColumn("line_row_no", _row_no("key"))
    joined = numbered.join(_gone_by_key(docs.select("doc_id", "text"), tau), "key", "left").withColumn("gone", F.expr(f"transform({_GONE}, g -> g.ln)"))
    text = F.expr("if(gone is null, row.text, array_join(filter(split(row.text, '\\n'), (l, i) -> not array_contains(gone, i)), '\\n'))")
    kept = joined.withColumn("text", text).where(F.col("gone").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return kept.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def op1_line_dedup(docs: DataFrame) -> DataFrame:
    """For each document row: its lines with words, those to remove, those of them like an earlier line but not equal, and their numbers."""
    text = F.coalesce(F.col("text"), F.lit(""))
    n_lines = F.size(F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_ENDS)) != ""))
    base = docs.select("doc_id", F.xxhash64("doc_id", text).alias("key"), n_lines.cast("long").alias("n_lines"))
    joined = base.withColumn("line_row_no", _row_no("key")).join(_gone_by_key(docs), "key", "left").withColumn("line_gone", F.expr(f"coalesce({_GONE}, array())"))
    return joined.select("doc_id", "n_lines", F.size("line_gone").cast("long").alias("n_removed"), F.expr("cast(size(filter(line_gone, g -> g.near)) as bigint)").alias("n_near"), F.array_join(F.transform("line_gone", lambda g: g["ln"].cast("string")), ",").alias("removed_lines"))
