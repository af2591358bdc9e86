"""Language identification by Bayesian fusion of text, declared language, address suffix and host."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import columns, fresh, numbered, prepare

#: The languages told apart, in order of preference on ties, and the name of none of them.
LANGUAGES = ("de", "en", "es", "fr")
UNKNOWN = "und"
#: Hash buckets of character trigrams; share of a text's log-likelihood that counts (its trigrams overlap); strength of each level's prior.
BUCKETS, TEMPER, STRENGTH = 1 << 16, 0.25, 8.0


def trigrams(text: str | None) -> np.ndarray:
    """The buckets of a whole text's character trigrams; a text of letters is padded with a space at either end, others have none."""
    if not text or text.isspace():
        return np.zeros(0, np.int64)
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = (c[:-2] * np.uint64(0x9E3779B1) + c[1:-1]) * np.uint64(0x85EBCA77) + c[2:]
    return ((h * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(48)).astype(np.int64)


def learn(docs: DataFrame, text: str = "text", declared: str = "lang") -> np.ndarray:
    """Log-probabilities (languages x buckets) from every row with one of the declared languages: per-task counts, then a grouped sum.

    What reaches the driver is at most a row for each language and bucket, at any size.
    """
    rows = docs.select(F.col(text).cast("string").alias("text"), F.lower(F.col(declared).cast("string")).alias("lang")).where(F.col("lang").isin(*LANGUAGES))

    def count(batches):
        total = np.zeros((len(LANGUAGES), BUCKETS), np.int64)
        for b in batches:
            texts, langs = b.column("text").to_pylist(), b.column("lang").to_pylist()
            for k, lang in enumerate(LANGUAGES):
                for i in range(0, len(texts), 64):
                    own = [trigrams(t) for t, x in zip(texts[i : i + 64], langs[i : i + 64]) if x == lang]
                    if own:
                        total[k] += np.bincount(np.concatenate(own), minlength=BUCKETS)
        k, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(bucket, pa.int32()), pa.array(total[k, bucket])], names=["k", "bucket", "n"])

    table = np.full((len(LANGUAGES), BUCKETS), 0.05)
    for r in rows.mapInArrow(count, "k int, bucket int, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n")).collect():
        table[r.k, r.bucket] += r.n
    return np.log(table / table.sum(axis=1, keepdims=True))


def likelihoods(rows: DataFrame, model: np.ndarray) -> DataFrame:
    """rows (without text) and ll: array of a tempered log-likelihood for each language and, last, for UNKNOWN (all buckets alike)."""
    shared = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(model.T))
    keep = [(f.name, f.dataType.simpleString()) for f in rows.schema.fields if f.name != "text"]

    def run(batches):
        table, flat = shared.value, -np.log(BUCKETS)
        for b in batches:
            out = []
            for text in b.column("text").to_pylist():
                g = trigrams(text)
                ll = sum((table[g[i : i + 65536]].sum(axis=0) for i in range(0, len(g), 65536)), np.zeros(len(LANGUAGES)))
                out.append((np.append(ll, flat * len(g)) * TEMPER).tolist())
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n, _ in keep), pa.array(out, pa.list_(pa.float64()))], names=[*(n for n, _ in keep), "ll"])

    return rows.select(*(n for n, _ in keep), "text").mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in keep) + ", ll array<double>")


def _top(scores: Column) -> Column:
    """The name of the largest of an array of scores; the first of equals."""
    names = F.array(*map(F.lit, (*LANGUAGES, UNKNOWN)))
    return F.element_at(names, F.array_position(scores, F.array_max(scores)).cast("int"))


def identify(rows: DataFrame, model: np.ndarray) -> DataFrame:
    """The rows of (text, declared, host, and any keys) with language, probability and accepted instead of text and evidence.

    Posterior: tempered text likelihood x P(declared | language) x prior of the host.  Hosts' counts of the texts' likeliest languages are
    summed by host, by its registered domain, by its address suffix and over all; each level is smoothed towards the one above with STRENGTH
    pseudo-counts.  P(declared | language) comes from the same counts.  Null or empty evidence drops out of the product; a text without
    trigrams gives no likelihood, and rows whose likeliest language is UNKNOWN, or with such a text, are not accepted.
    """
    spark = prepare(rows.sparkSession)
    known = F.lower(F.regexp_extract(F.coalesce("declared", F.lit("")), "^[A-Za-z]{2,3}", 0))
    host = F.lower(F.coalesce("host", F.lit("")))
    base = rows.withColumn("declared", F.when(known == "", "none").when(known.isin(*LANGUAGES), known).otherwise("other")).withColumn("host", host)
    scored = likelihoods(base, model).withColumn("guess", _top(F.col("ll"))).withColumn("has", F.element_at("ll", -1) < 0).checkpoint()
    voted = scored.where("has").where(F.col("guess") != UNKNOWN)
    counts = voted.groupBy("host", "guess").agg(F.count("*").alias("n"))
    domain, suffix = F.regexp_extract("host", r"[^.]+\.[^.]+$|^[^.]*$", 0), F.regexp_extract("host", r"[^.]*$", 0)
    wide = counts.groupBy("host").agg(F.array(*(F.coalesce(F.sum(F.when(F.col("guess") == g, F.col("n"))), F.lit(0)).cast("double") for g in LANGUAGES)).alias("n")).withColumn("domain", domain).withColumn("suffix", suffix)

    def summed(by: str) -> DataFrame:
        return wide.groupBy(by).agg(F.array(*(F.sum(F.col("n")[i]) for i in range(len(LANGUAGES)))).alias(f"n_{by}"))

    def smooth(n: str, above: Column) -> Column:
        whole = F.aggregate(n, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(F.col(n), above, lambda x, p: (x + STRENGTH * p) / (whole + STRENGTH))

    top = voted.groupBy("guess").agg(F.count("*").alias("n")).collect()
    votes = {r.guess: r.n for r in top}
    whole = sum(votes.values()) + len(LANGUAGES)
    everywhere = F.array(*(F.lit((votes.get(g, 0) + 1) / whole) for g in LANGUAGES))
    priors = wide.join(summed("domain"), "domain").join(summed("suffix"), "suffix").select("host", smooth("n", smooth("n_domain", smooth("n_suffix", everywhere))).alias("prior"))
    seen = {(r.guess, r.declared): r.n for r in voted.groupBy("guess", "declared").agg(F.count("*").alias("n")).collect()}
    tags = (*LANGUAGES, "other")
    said = {d: [np.log((seen.get((g, d), 0) + 1) / (sum(seen.get((g, x), 0) for x in tags) + len(tags))) for g in LANGUAGES] + [-np.log(len(tags))] for d in tags} | {"none": [0.0] * (len(LANGUAGES) + 1)}
    declared = F.create_map(*(x for d, v in said.items() for x in (F.lit(d), F.array(*map(F.lit, map(float, v))))))[F.col("declared")]
    prior = F.concat(F.transform(F.coalesce("prior", everywhere), lambda p: F.log(p * 0.99)), F.array(F.lit(float(np.log(0.01)))))
    joined = scored.join(priors, "host", "left").withColumn("s", F.zip_with(F.zip_with("ll", declared, lambda a, b: a + b), prior, lambda a, b: a + b))
    best = F.array_max("s")
    probability = 1 / F.aggregate("s", F.lit(0.0), lambda a, x: a + F.exp(x - best))
    keys = [c for c in rows.columns if c not in ("text", "declared", "host")]
    return joined.select(*keys, _top(F.col("s")).alias("language"), probability.alias("probability"), (F.col("has") & (_top(F.col("s")) != UNKNOWN)).alias("accepted"))


def page_rows(pages: DataFrame) -> DataFrame:
    """page_id, text, declared, host from pages of (page_id, url, html): the visible text, the html element's lang and the address's host."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    body = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>|&[#a-zA-Z0-9]+;", " ")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), body.alias("text"), F.regexp_extract(html, r"(?i)<html[^>]*\blang\s*=\s*[\"']?([A-Za-z-]+)", 1).alias("declared"), F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[a-zA-Z]+://([^/:?#]+)", 1).alias("host"))


def document_rows(docs: DataFrame, **keys: str) -> DataFrame:
    """The key columns, text, declared (lang) and host (source) of documents."""
    d = columns(docs, **keys, text="string", lang="string", source="string")
    return d.withColumnsRenamed({"lang": "declared", "source": "host"})


def identify_all(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """One row for each document and each page: doc_id or page_id, language, probability, accepted."""
    prepare(docs.sparkSession)
    nothing = F.lit(None).cast("long")
    model = learn(docs)
    both = document_rows(docs, doc_id="long").withColumn("page_id", nothing).unionByName(page_rows(pages).withColumn("doc_id", nothing))
    return identify(both.select("doc_id", "page_id", "text", "declared", "host"), model)


def accepted_documents(docs: DataFrame) -> DataFrame:
    """docs without those of no language (junk, and null or empty texts); the others are unchanged, with all their columns."""
    prepare(docs.sparkSession)
    (place,) = fresh(docs, "place")
    keyed = numbered(docs, place)
    found = identify(document_rows(keyed, **{place: "long"}), learn(docs))
    return keyed.join(found.where(~F.col("accepted")).select(place), place, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
