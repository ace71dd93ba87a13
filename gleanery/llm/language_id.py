"""Language identification of web pages by Bayesian evidence fusion.

A naive Bayes model over hashed letter trigrams is fitted on at most
``SAMPLE_ROWS`` labelled documents (those of least hashes of id and content).  For each
page it gives the likelihood of its text under each language.  The page's
posterior joins that with the declared language of its markup and with priors
of its address: suffix, registered domain and host.  The priors and the
declarations' reliability are grouped sums of the text posteriors over all
pages; each level is smoothed towards the one above, and a page's own share is
taken out of its host's sums.

Cases: null or empty pages, and pages without letters, are decided by address
and declaration alone; a null or odd address has empty host, domain and suffix;
repeated rows each give their row, and count once in the sample; without labelled
documents no language is known and ``lang`` is null; an empty table of pages gives
no rows; a page or document of any length is read whole, in one row; other columns
aren't read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: Bound of the labelled rows that the text model is fitted on.
SAMPLE_ROWS = 4_000
#: Hash buckets of trigrams: the model has as many weights for each language.
BUCKETS = 1 << 15
#: Trigrams are dependent; so many count as one observation.
THINNING = 8.0
#: Pseudo-counts that a level of the address takes from the level above.
STRENGTH = 4.0


def trigrams(text: str | None) -> np.ndarray:
    """Buckets of a text's letter trigrams, in lower case, with one space between words."""
    letters = " ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).split())
    if not letters:
        return np.zeros(0, np.int64)
    c = np.frombuffer(f" {letters} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    h = c[:-2] * np.uint64(0x9E3779B97F4A7C15) + c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + c[2:] * np.uint64(0x165667B19E3779F9)
    return ((h ^ (h >> np.uint64(32))) % np.uint64(BUCKETS)).astype(np.int64)


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages, and log-probabilities (languages x buckets) of trigrams, from a bounded sample."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(text_col).alias("t"), F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col)).alias("h"), F.xxhash64(F.col(text_col), F.col(lang_col)).alias("h2"))
    # the hashes alone are put in order, and of them those below a bound that some eight times the sample should fall under
    n = rows.count()
    below = F.col("h") < min(2**63 - 1, int(-(2**63) + 2**64 * min(1.0, (8 * sample_rows + 1000) / max(n, 1))))
    held = rows.where(below).select("h", "h2").distinct().orderBy("h", "h2").limit(sample_rows).collect()  # sample_rows pairs of numbers
    if len(held) < min(sample_rows, n):
        held = rows.select("h", "h2").distinct().orderBy("h", "h2").limit(sample_rows).collect()
    last = max(((r["h"], r["h2"]) for r in held), default=(-(2**63), -(2**63)))
    sample = rows.where((F.col("h") < last[0]) | ((F.col("h") == last[0]) & (F.col("h2") <= last[1]))).dropDuplicates(["h", "h2"]).select("lang", "t")

    def count(batches):
        for b in batches:
            lang = np.array(b.column(0).to_pylist(), dtype=object)
            grams = [trigrams(t) for t in b.column(1).to_pylist()]
            for name in sorted(set(lang)):
                n = np.bincount(np.concatenate([g for g, x in zip(grams, lang) if x == name]), minlength=BUCKETS)
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(n[at])], names=["lang", "bucket", "n"])

    # the sample bounds the languages, and BUCKETS the rows of each
    counts = sample.repartition(8, "t").mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(counts["lang"].to_pylist()))
    table = np.full((len(names), BUCKETS), 0.5)
    if names:
        at = np.searchsorted(names, counts["lang"].to_numpy(zero_copy_only=False))
        table[at, counts["bucket"].to_numpy()] += counts["n"].to_numpy()
    return names, np.log(table / table.sum(axis=1, keepdims=True)) if names else table


def page_text(html: Column) -> Column:
    """What a page says: without scripts, styles, comments, navigation and tags."""
    text = F.coalesce(html, F.lit(""))
    text = F.regexp_replace(text, r"(?is)<(script|style|nav)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(text, "<[^>]*>", " "), r"&[A-Za-z0-9#]{1,8};", " ")


def evidence(pages: DataFrame, names: list[str], model: np.ndarray, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, host, domain, suffix, declared, ll): parts of the address, declared language, log-likelihood of the text under each language."""
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), F.lower(F.regexp_extract(F.coalesce(F.col(html_col), F.lit("")), r"(?i)<html\b[^>]*?\slang\s*=\s*[\"']?([a-zA-Z]{2,3})\b", 1)).alias("declared"), page_text(F.col(html_col)).alias("t"))

    def score(batches):
        for b in batches:
            ll = []
            for t in b.column(3):
                g = trigrams(t.as_py())
                s = model[:, g].sum(axis=1) / THINNING if len(names) else np.zeros(0)
                ll.append(np.round(s - s.max(), 6) if len(s) else s)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(3)), pa.array(ll, pa.list_(pa.float64()))], names=["page_id", "host", "declared", "ll"])

    scored = rows.mapInArrow(score, f"page_id {rows.schema['page_id'].dataType.simpleString()}, host string, declared string, ll array<double>")
    domain, suffix = F.substring_index("host", ".", -2), F.substring_index("host", ".", -1)
    return scored.select("page_id", "host", domain.alias("domain"), suffix.alias("suffix"), "declared", "ll")


def fuse(found: DataFrame, names: list[str], strength: float = STRENGTH) -> DataFrame:
    """``page_id``, ``lang``, ``prob``, ``text_lang``, ``declared``, ``host`` from :func:`evidence`."""
    if not names:
        none = F.lit(None).cast("string")
        return found.select("page_id", none.alias("lang"), F.lit(None).cast("double").alias("prob"), none.alias("text_lang"), "declared", "host")
    found = checkpoint(found)
    langs = range(len(names))
    lse = F.expr("aggregate(ll, 0D, (a, x) -> a + exp(x))")
    soft = found.select("*", *[F.round(F.exp(F.get("ll", F.lit(k))) / lse, 9).cast("decimal(20,9)").alias(f"p{k}") for k in langs])
    # exact sums, so that reruns agree; every level comes from the one below it
    sums = lambda df, *by: df.groupBy(*by).agg(F.sum("n").alias("n"), *[F.sum(f"p{k}").cast("decimal(38,9)").alias(f"p{k}") for k in langs])
    hosts = checkpoint(sums(soft.withColumn("n", F.lit(1)), "host", "domain", "suffix", "declared"))
    declared = _rows(sums(hosts, "declared"), "declared", langs)
    host = sums(hosts, "host", "domain", "suffix")
    domain, suffix = sums(host, "domain", "suffix"), sums(host, "suffix")
    world = sums(suffix)

    def smoothed(df: DataFrame, name: str, above: DataFrame, over: str | None, tag: str, up: str) -> DataFrame:
        """The level's prior for each language: its sums and ``strength`` pseudo-counts of the level above."""
        joined = df.crossJoin(F.broadcast(above)) if over is None else df.join(above, over)
        keys = [c for c in (name, "domain", "suffix") if c in df.columns]
        return joined.select(*dict.fromkeys(keys), *[((F.col(f"p{k}").cast("double") + strength * F.col(f"{up}{k}")) / (F.col("n") + strength)).alias(f"{tag}{k}") for k in langs])

    total = world.select(*[((F.col(f"p{k}").cast("double") + 1) / (F.col("n") + len(names))).alias(f"w{k}") for k in langs])  # one row
    suffixes = smoothed(suffix, "suffix", total, None, "s", "w")
    domains = smoothed(domain, "domain", suffixes, "suffix", "d", "s").drop("suffix")
    priors = host.join(domains, "domain").select("host", F.col("n").alias("hn"), *[F.col(f"p{k}").cast("double").alias(f"h{k}") for k in langs], *[f"d{k}" for k in langs])
    joined = soft.join(priors, "host").join(F.broadcast(declared), "declared")  # two or three letters: 18,279 values at most
    # the host's sums without this page, smoothed towards its domain
    post = [F.get("ll", F.lit(k)) + F.log((F.greatest(F.col(f"h{k}") - F.col(f"p{k}").cast("double"), F.lit(0.0)) + strength * F.col(f"d{k}")) / (F.col("hn") - 1 + strength)) + F.col(f"c{k}") for k in langs]
    scored = joined.select("page_id", "declared", "host", F.array(*post).alias("lp"), "ll")
    best = F.array_max("lp")
    prob = F.lit(1.0) / F.aggregate("lp", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("lp")))
    name = F.array(*[F.lit(n) for n in names])
    return scored.select("page_id", F.get(name, (F.array_position("lp", best) - 1).cast("int")).alias("lang"), F.round(prob, 6).alias("prob"), F.get(name, (F.array_position("ll", F.array_max("ll")) - 1).cast("int")).alias("text_lang"), "declared", "host")


def _rows(counts: DataFrame, name: str, langs) -> DataFrame:
    """For each declared value the log of how often pages of each language declare it; none declared says nothing."""
    totals = counts.agg(*[F.sum(f"p{k}").cast("double").alias(f"t{k}") for k in langs], F.count("*").alias("kinds"))
    said = counts.crossJoin(F.broadcast(totals))  # one row
    logs = [F.when(F.col(name) == "", F.lit(0.0)).otherwise(F.log((F.col(f"p{k}").cast("double") + 0.5) / (F.col(f"t{k}") + 0.5 * F.col("kinds")))).alias(f"c{k}") for k in langs]
    return said.select(name, *logs)


def identify(pages: DataFrame, labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    names, model = fit(labelled, sample_rows=sample_rows)
    return fuse(evidence(pages, names, model), names)


def op5_language_id(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    return identify(pages, labelled)
