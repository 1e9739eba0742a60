"""Language identification by Bayesian evidence fusion.

posterior(l) ~ prior(l | host) * P(markup language | l) * P(address suffix | l) * P(text | l) ** tempering

* Text: naive Bayes over hashed byte trigrams, trained here on a bounded sample of labelled documents (`SAMPLE` documents, the
  smallest by a hash of doc_id, and a few of each label). Trigrams overlap, so the likelihood is tempered: it counts as `EVIDENCE` independent
  trigrams at most. One more hypothesis, "und", gives all trigrams one likelihood.
* Markup language and suffix: tables of counts against the language that the text alone gives, summed over all rows by
  grouped aggregation and smoothed; both have a bounded number of values (those that name a known language, other, none).
* Host prior: counts of the text-only language by host, summed over all rows, each row's own count left out, smoothed with
  the domain's, and those with all rows' (`KAPPA` rows' worth each).

What the driver collects is bounded by the number of languages. Hosts are joined back by a plain join, which Spark can
split where one host has a large part of the rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, cut, documents_only, table, text_key, unused

SAMPLE, BUCKETS, SMOOTH = 2_000, 1 << 15, 0.5
EVIDENCE, KAPPA, UND_PRIOR, MOST_LANGUAGES = 60.0, 5.0, 1e-6, 64
UND = "und"
#: Country suffixes whose main language is another code.
SUFFIXES = {"uk": "en", "us": "en", "au": "en", "nz": "en", "ie": "en", "at": "de", "mx": "es", "ar": "es", "cl": "es", "br": "pt", "cn": "zh", "jp": "ja", "kr": "ko", "cz": "cs", "dk": "da", "se": "sv", "gr": "el", "ua": "uk"}
_DROP = re.compile(rb"(?is)<(script|style|nav|header|footer|aside)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[#0-9a-z]{1,10};")


def page_text(html: bytes) -> bytes:
    """What a page says, roughly: without scripts, styles, navigation, comments, tags and entities."""
    return _DROP.sub(b" ", html)


def buckets(text: bytes) -> np.ndarray:
    """Hashed byte trigrams of the text, ASCII lower case, blanks and digits made one; empty below three bytes or without a letter."""
    a = np.frombuffer(b" " + b" ".join(text.lower().split()) + b" ", np.uint8)
    a = np.where((a >= 48) & (a <= 57), np.uint8(48), a).astype(np.uint32)
    if len(a) < 3 or not ((a >= 97) & (a <= 122) | (a >= 128)).any():
        return np.empty(0, np.uint32)
    return ((a[:-2] * np.uint32(0x9E3779B1) ^ a[1:-1] * np.uint32(0x85EBCA77) ^ a[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(7)) % np.uint32(BUCKETS)


@dataclass(frozen=True)
class TextModel:
    languages: tuple[str, ...]
    logs: np.ndarray  # (languages, BUCKETS) natural logs

    def score(self, text: bytes) -> tuple[np.ndarray, int]:
        """Log likelihoods by language, then of "und"; the number of trigrams."""
        found = buckets(text)
        if not len(found):
            return np.zeros(len(self.languages) + 1), 0
        some = self.logs @ np.bincount(found, minlength=BUCKETS) if len(found) > 4096 else self.logs[:, found].sum(axis=1)
        return np.append(some, -np.log(BUCKETS) * len(found)), len(found)


def train(labelled: DataFrame, sample: int = SAMPLE) -> TextModel:
    """Fit the text model on labelled (doc_id, text, lang): the `sample` documents of the smallest hash of doc_id.

    So that no label goes unseen, the sample // MOST_LANGUAGES smallest of each label come besides, over all rows. Null labels, ids and texts are left out; with no labelled row the model knows no language and every text is "und". More than MOST_LANGUAGES labels are an error, told
    before anything is gathered.
    """
    rows = documents_only(labelled, "doc_id", "text", "lang").where("lang is not null and text is not null and doc_id is not null")
    if rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages among the labels")
    ids = rows.select("doc_id", F.xxhash64("doc_id").alias("h")).distinct().orderBy("h", "doc_id").limit(sample).select(F.col("doc_id").alias("_id"), F.lit(None).cast("string").alias("_lang"))
    by_label = rows.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).distinct().withColumn("_rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id")))
    ids = ids.union(by_label.where(F.col("_rank") <= max(1, sample // MOST_LANGUAGES)).select("doc_id", "lang"))
    chosen = rows.join(F.broadcast(ids), (F.col("doc_id") == F.col("_id")) & (F.col("_lang").isNull() | (F.col("lang") == F.col("_lang"))), "left_semi").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[lang] = sums.get(lang, 0) + np.bincount(buckets(text.as_py().encode()), minlength=BUCKETS)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "bucket", "n"])

    counts = chosen.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(counts["lang"].unique()))
    sums = np.full((len(languages), BUCKETS), SMOOTH)
    for k, lang in enumerate(languages):
        own = counts[counts["lang"] == lang]
        sums[k, own["bucket"].to_numpy()] += own["n"].to_numpy()
    return TextModel(languages, np.log(sums / sums.sum(axis=1, keepdims=True)))


def _first_pass(rows: DataFrame, model: TextModel, html: bool) -> DataFrame:
    """Adds to rows (..., text) text_ll (tempered log likelihoods, "und" last), n_grams and said (best language by text, -1: none)."""
    keep = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lls, counts, said = [], [], []
            for x in batch.column(batch.num_columns - 1):
                data = (x.as_py() or "").encode()
                ll, n = model.score(page_text(data) if html else data)
                lls.append(ll * (min(n, EVIDENCE) / n if n else 0.0))
                counts.append(n)
                best = int(np.argmax(ll)) if n else len(model.languages)
                said.append(best if best < len(model.languages) else -1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([x.tolist() for x in lls], pa.list_(pa.float64())), pa.array(counts, pa.int64()), pa.array(said, pa.int32())], [*keep, "text_ll", "n_grams", "said"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.select(*keep, "text").mapInArrow(run, f"{kinds}, text_ll array<double>, n_grams long, said int")


def _code(value: Column, languages: tuple[str, ...], also: dict[str, str] | None = None) -> Column:
    """0, 1, ...: the known language that value names; then "other"; then "none"."""
    low = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    codes = {"": len(languages) + 1} | {lang: k for k, lang in enumerate(languages)}
    codes |= {a: codes[b] for a, b in (also or {}).items() if b in codes}
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in codes.items() for x in pair]), low), F.lit(len(languages)))


def _evidence(first: DataFrame, column: str, n: int) -> np.ndarray:
    """(n + 2 codes, n + 1 languages) log P(code | language); counts over all rows, smoothed with the codes' shares."""
    counts = np.zeros((n + 2, n))
    for code, said, k in first.where("said >= 0").groupBy(column, "said").agg(F.count("*")).collect():
        counts[code, said] = k
    share = (counts.sum(axis=1) + 1) / (counts.sum() + n + 2)
    p = (counts + KAPPA * share[:, None]) / (counts.sum(axis=0) + KAPPA)
    return np.log(np.column_stack([p, share]))


def _pick(rows: np.ndarray, code: str) -> Column:
    literal = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in rows])
    return F.get(literal, F.col(code))


def _counts(n: int) -> list[Column]:
    return [F.count_if(F.col("said") == k).alias(f"n{k}") for k in range(n)]


def identify(rows: DataFrame, model: TextModel, *, html: bool = False) -> DataFrame:
    """rows (id, key, text, host, markup, suffix; any may be null) -> id, key, lang, confidence, text_lang.

    lang is "und" where the text has no letter, or where that hypothesis wins; confidence is the posterior of lang. A null
    host has the prior of all rows; null markup or suffix is evidence of its own kind ("none"), learnt as any other.
    """
    n = len(model.languages)
    rows = rows.withColumns({"markup": _code(F.col("markup"), model.languages), "code": _code(F.col("suffix"), model.languages, SUFFIXES), "domain": F.regexp_extract(F.coalesce("host", F.lit("")), r"([^.]*\.)?[^.]*$", 0)})
    first = cut(_first_pass(rows.select("id", "key", "host", "domain", "markup", "code", "text"), model, html))
    names = F.array(*[F.lit(x) for x in (*model.languages, UND)])
    if not n:
        return first.select("id", "key", F.lit(UND).alias("lang"), F.lit(1.0).alias("confidence"), F.lit(UND).alias("text_lang"))
    hosts = first.where("host is not null").groupBy("host", "domain").agg(*_counts(n))
    sums = [F.sum(f"n{k}").alias(f"n{k}") for k in range(n)]
    domains = hosts.groupBy("domain").agg(*sums)
    total = first.agg(*_counts(n)).first()
    base = [(total[k] + 1.0) / (sum(total) + n) for k in range(n)]

    def smoothed(counts: list[Column], prior: list[Column]) -> list[Column]:
        size = sum(counts[1:], counts[0])
        return [(c + KAPPA * p) / (size + KAPPA) for c, p in zip(counts, prior, strict=True)]

    tables = [_evidence(first, c, n) for c in ("markup", "code")]
    of_domain = domains.select(F.col("domain").alias("_domain"), *[F.col(f"n{k}").alias(f"d{k}") for k in range(n)])
    of_host = hosts.join(of_domain, F.col("domain") == F.col("_domain")).select(F.col("host").alias("_host"), F.array(*[f"n{k}" for k in range(n)]).alias("nh"), F.array(*[f"d{k}" for k in range(n)]).alias("nd"))
    met = first.join(bounded(cut(of_host)), F.col("host") == F.col("_host"), "left")

    def less_own(column: str) -> list[Column]:
        return [F.coalesce(F.col(column)[k], F.lit(0)) - F.when((F.col("said") == k) & F.col("host").isNotNull(), 1).otherwise(0) for k in range(n)]

    prior = smoothed(less_own("nh"), smoothed(less_own("nd"), [F.lit(p) for p in base]))
    log_prior = F.array(*[F.log(p * (1 - UND_PRIOR)) for p in prior], F.lit(float(np.log(UND_PRIOR))))
    parts = met.select("id", "key", "text_ll", "n_grams", "said", log_prior.alias("a"), _pick(tables[0], "markup").alias("b"), _pick(tables[1], "code").alias("c"))
    fused = parts.withColumn("f", F.zip_with(F.zip_with("a", "b", lambda x, y: x + y), F.zip_with("c", "text_ll", lambda x, y: x + y), lambda x, y: x + y))
    best = fused.withColumn("top", F.array_max("f"))
    mass = F.aggregate("f", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    at = F.when(F.col("n_grams") == 0, n).otherwise(F.array_position("f", F.col("top")).cast("int") - 1)
    said = F.when(F.col("said") < 0, n).otherwise(F.col("said"))
    return best.select("id", "key", F.get(names, at).alias("lang"), F.when(F.col("n_grams") == 0, 1.0).otherwise(1 / mass).alias("confidence"), F.get(names, said).alias("text_lang"))


def identify_pages(pages: DataFrame, model: TextModel) -> DataFrame:
    """page_id, lang, confidence, text_lang for every row of pages (page_id, url, html)."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    markup = F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]{2,3})", 1)
    rows = documents_only(pages, "page_id", "url", "html").select(F.col("page_id").alias("id"), text_key(F.col("html")).alias("key"), F.when(host != "", host).alias("host"), markup.alias("markup"), F.regexp_extract(host, r"\.([a-z]+)$", 1).alias("suffix"), F.col("html").alias("text"))
    return identify(rows, model, html=True).withColumnRenamed("id", "page_id").drop("key")


def identify_documents(docs: DataFrame, model: TextModel) -> DataFrame:
    """id, key, lang, confidence, text_lang for every row of docs (doc_id, text, source); the source takes the host's place."""
    rows = documents_only(docs, "doc_id", "text", "source").select(F.col("doc_id").alias("id"), text_key(F.col("text")).alias("key"), F.col("source").alias("host"), F.lit(None).cast("string").alias("markup"), F.lit(None).cast("string").alias("suffix"), "text")
    return identify(rows, model)


def clean(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose language is one of those that labelled (doc_id, text, lang) knows.

    Texts that are null, empty or without a letter go; rows with a null doc_id or source are judged like any other; rows
    that repeat another's doc_id and text share its fate, whatever their source says, if either is "und". An empty table
    gives an empty one.
    """
    d, k = unused(docs, "d", "k")
    found = identify_documents(docs, train(labelled)).where(F.col("lang") == UND).select(F.col("id").alias(d), F.col("key").alias(k)).distinct()
    return docs.join(bounded(cut(found)), F.col("doc_id").eqNullSafe(F.col(d)) & (text_key(F.col("text")) == F.col(k)), "left_anti")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify_pages(table(spark, sf_dir, "pages"), train(table(spark, sf_dir, "documents")))
    return found.select("page_id", "lang", F.round("confidence", 6).alias("confidence"), "text_lang")
