import random

from pyspark.sql import functions as F

from gleanery.llm import line_dedup


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def limit(a, b):
    return min(2, min(len(a), len(b)) // 5)


def brute(rows):
    found = [(d, ln, s) for d, t in rows for ln, s in enumerate(x.strip(" \t\r\x0b\x0c") for x in (t or "").split("\n")) if s]
    texts = sorted({s for _, _, s in found})
    root = {s: s for s in texts}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            if abs(len(a) - len(b)) <= limit(a, b) and edits(a, b) <= limit(a, b):
                root[find(a)] = find(b)
    seen, gone = {}, {}
    for d, ln, s in sorted(found, key=lambda x: x[:2]):
        if find(s) in seen:
            gone.setdefault(d, []).append((ln, seen[find(s)] != s))
        else:
            seen[find(s)] = s
    return gone


def change(rng, s, k):
    for _ in range(k):
        i = rng.randrange(len(s) or 1)
        s = rng.choice([s[:i] + s[i + 1 :], s[:i] + rng.choice("abcé😀") + s[i:], s[:i] + rng.choice("xyz") + s[i + 1 :]])
    return s


def corpus(seed):
    rng = random.Random(seed)
    line = lambda n: "".join(rng.choices("abcdefgh ", k=n)).strip() or "a"
    base = [line(rng.choice([3, 4, 5, 8, 9, 10, 12, 15, 16, 19, 20, 23, 28, 31, 32, 33, 46, 47, 48, 49, 63, 64, 65, 100, 200])) for _ in range(60)]
    pool = base + [change(rng, rng.choice(base), rng.randint(1, 4)) for _ in range(240)]
    return [(d, "\n".join(rng.choices(pool + ["", "  "], k=rng.randint(1, 6)))) for d in range(120)]


def test_fixture_against_brute_force(spark, monkeypatch):
    for tile in (128, 3):
        monkeypatch.setattr(line_dedup, "TILE", tile)
        rows = corpus(tile)
        docs = spark.createDataFrame(rows + [(900, None), (901, "")], "doc_id long, text string")
        got = {r.doc_id: (r.n_removed, r.n_near, r.removed_lines) for r in line_dedup.op1_line_dedup(docs).collect()}
        want = brute(rows)
        assert got == {d: (len(g := want.get(d, [])), sum(n for _, n in g), ",".join(str(x) for x, _ in g)) for d in [*range(120), 900, 901]}


def test_bit_parallel_distance(spark):
    rng = random.Random(9)
    pairs = []
    for _ in range(300):
        a = "".join(rng.choices("abc", k=rng.randint(1, 90)))
        pairs.append((a, change(rng, a, rng.randint(0, 4)) or "a"))
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    sides = [line_dedup.prepared(df.select("i", F.col(c).alias("line"))).select(F.col("i").alias(f"i_{c}"), F.struct("line", "n", "head", "tail").alias(n)) for c, n in (("a", "x"), ("b", "y"))]
    near = {r.i_a for r in line_dedup.within(sides[0].join(sides[1], F.col("i_a") == F.col("i_b"))).collect()}
    assert near == {i for i, (a, b) in enumerate(pairs) if edits(a, b) <= limit(a, b)}


def test_stage_rewrites_and_keeps_columns(spark):
    long = "this line is long enough to be compared by edits, one two three"
    rows = [(1, f"{long}\nown", "x"), (2, f"{long}!\nother", "x"), (3, long, "y"), (4, None, "y"), (5, "", None), (5, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ln string")
    kept = line_dedup.keep_first_lines(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.doc_id < 4) == [(1, f"{long}\nown"), (2, "other")]
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4, 5, 5]
    assert line_dedup.op1_line_dedup(spark.createDataFrame([], "doc_id long, text string, lid int")).count() == 0


def test_repeated_rows_are_duplicates_of_each_other(spark):
    long = "this line is long enough to be compared by edits, one two three"
    rows = [(1, f"{long}\nown"), (2, f"{long}!\nother\n"), (2, f"{long}!\nother\n"), (2, f"{long}!\nother\n"), (3, "alone"), (3, "alone"), (4, None), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_lines, r.n_removed, r.n_near, r.removed_lines) for r in line_dedup.op1_line_dedup(docs).collect())
    assert got == [(1, 2, 0, 0, ""), (2, 2, 1, 1, "0"), (2, 2, 2, 1, "0,1"), (2, 2, 2, 1, "0,1"), (3, 1, 0, 0, ""), (3, 1, 1, 0, "0"), (4, 0, 0, 0, ""), (4, 0, 0, 0, "")]
    kept = sorted((r.doc_id, r.text or "") for r in line_dedup.keep_first_lines(docs).collect())
    assert kept == [(1, f"{long}\nown"), (2, "other\n"), (3, "alone"), (4, ""), (4, "")]


def test_linked_across_classes_of_length(spark):
    """A line of 96 and one of 95 code points: one deletion before the middle segment, one change behind it."""
    rng = random.Random(1)
    rows = []
    for t in range(25):
        x = "a" + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=94)) + "z"
        rows += [(2 * t, x), (2 * t + 1, x[:10] + x[11:80] + "#" + x[81:])]
    got = {r.doc_id: r.n_near for r in line_dedup.op1_line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: d % 2 for d in range(50)}


def shared(rng, n):
    """Lines with a begin, an end or a middle in common, some of them near copies of others."""
    own = lambda k: "".join(rng.choices("0123456789abcdef", k=k))
    kinds = [lambda: "one begin is on every line of this kind " + own(20), lambda: own(20) + " one end is on every line of this kind", lambda: own(12) + " a middle is on all lines " + own(12), lambda: "counted line number " + own(3)]
    texts = [rng.choice(kinds)() for _ in range(n)]
    return texts + [change(rng, rng.choice(texts), rng.randint(1, 3)) for _ in range(n // 2)]


def test_shared_segments_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "GROUP", 4)
    rows = list(enumerate(shared(random.Random(7), 160)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_near) for r in line_dedup.op1_line_dedup(docs).collect()}
    want = brute(rows)
    assert got == {d: (len(g := want.get(d, [])), sum(n for _, n in g)) for d in range(len(rows))}


def test_shared_segments_are_refined(spark):
    """Of lines with one begin, few are left in groups that are compared whole, and no line is in many of them."""
    rng = random.Random(3)
    rows = [(i, "This boilerplate prefix is on every line of the corpus " + "".join(rng.choices("0123456789abcdef", k=32))) for i in range(2950)]
    rows += [(2950 + i, t[:70] + t[71:]) for i, t in rows[:50]]
    texts = spark.createDataFrame(rows, "lid long, line string")
    keyed = texts.select("lid", F.col("lid").alias("root"), F.explode(line_dedup._segment_keys(F.col("line"))).alias("e")).select("lid", "root", F.shiftright("e", 1).alias("k"), (F.col("e") % 2 != 0).alias("index"))
    groups = line_dedup._groups(keyed)
    assert groups.agg(F.max("n")).first()[0] == 3000
    found = line_dedup.refined(keyed.join(groups.where("n > 64").drop("kinds"), "k"), texts, 64)
    sizes = found.groupBy("k").agg(F.countDistinct("lid").alias("n"))
    assert sizes.agg(F.max("n")).first()[0] <= 70  # the number of classes is approximate
    assert found.groupBy("lid").count().agg(F.max("count")).first()[0] <= 100
    assert sizes.agg(F.sum(F.col("n") * F.col("n"))).first()[0] < 3000 * 3000 / 20


def test_dense_groups_are_not_copied(spark):
    """Lines that differ in a change or two each stay in the groups that they are in."""
    rng = random.Random(5)
    base = "".join(rng.choices("abcdefghijklmnop ", k=150))
    rows = [(i, change(rng, base, 2)) for i in range(400)]
    texts = spark.createDataFrame(rows, "lid long, line string")
    keyed = texts.select("lid", F.col("lid").alias("root"), F.explode(line_dedup._segment_keys(F.col("line"))).alias("e")).select("lid", "root", F.shiftright("e", 1).alias("k"), (F.col("e") % 2 != 0).alias("index"))
    hot = keyed.join(line_dedup._groups(keyed).where("n > 16").drop("kinds"), "k")
    assert line_dedup.refined(hot, texts, 16).count() <= 64 * hot.count()
