"""Benchmark decontamination by winnowing, in DataFrame functions only.

Of every 7 consecutive 4-word hashes the smallest is kept. A shared span of 10 words holds 7 such hashes, so document and
item keep the same one: the join of kept hashes misses no shared window. Items under 10 words are one window each; for the
few lengths that occur (9 at most) all hashes of that many words are kept on both sides. Documents with a hit are read
once more: windows around their hits are compared word by word with the items' windows.

Benchmark tables are broadcast up to a counted bound and joined by shuffle beyond it; each document is otherwise handled
where it is read, so a common passage makes no hot key before the hits, and hits are summed per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, bounded, cut, documents_only, table, text_key, unused

GRAM, WINDOW, SPAN = 4, 7, 10  # SPAN = GRAM + WINDOW - 1
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # what stands between words, upper case not yet folded


def split_words(text: Column) -> Column:
    """Words of a text; by split, since regexp_extract_all copies the whole text for each match."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BREAK, -1), "")


def words(text: Column) -> Column:
    return split_words(ascii_lower(text))


def _upto(last: Column) -> Column:
    """1..last; empty if last < 1."""
    return F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))


def _hashes(w: Column, n: int) -> Column:
    return F.transform(_upto(F.size(w) - (n - 1)), lambda i: F.xxhash64(F.lit(n), *[w[i + j - 1] for j in range(n)]))


def _winnowed(grams: Column) -> Column:
    return F.transform(_upto(F.greatest(F.size(grams) - (WINDOW - 1), F.least(F.size(grams), F.lit(1)))), lambda i: F.array_min(F.slice(grams, i, WINDOW)))


def _marks(df: DataFrame, short: list[int]) -> Column:
    """All kept hashes of the columns w (words) and grams; short: lengths of items under SPAN words."""
    kept = _winnowed(F.col("grams"))
    return F.array_distinct(F.concat(kept, *[_hashes(F.col("w"), n) for n in short]) if short else kept)


def _tokens(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, words(F.col("text")).alias("w")).withColumn("grams", _hashes(F.col("w"), GRAM))


def _spots(starts: Column, n: int) -> Column:
    """Windows of n words of w from each start."""
    return F.transform(starts, lambda i: F.struct(i.alias("at"), F.lit(n).alias("n"), F.array_join(F.slice("w", i, n), " ").alias("window")))


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, key, n_hit, item_ids (sorted strings) of the documents that hold a window of an item.

    docs (doc_id, text), benchmark (item_id, text); key = text_key(text). Null texts have no words; items that share an
    item_id count as one; an item with a null id contaminates but is not listed; items without words are left out.
    """
    items = _tokens(documents_only(benchmark, "item_id", "text"), "item_id").where(F.size("w") > 0)
    short = sorted(r[0] for r in items.where(F.size("w") < SPAN).select(F.size("w")).distinct().collect())
    length = F.least(F.size("w"), F.lit(SPAN))
    windows = items.select(F.col("item_id").cast("string").alias("item"), length.alias("n"), F.explode(F.transform(_upto(F.size("w") - length + 1), lambda i: F.array_join(F.slice("w", i, SPAN), " "))).alias("window"))
    windows = bounded(cut(windows.groupBy("n", "window").agg(F.collect_set("item").alias("items"))))
    own = F.when(F.size("w") >= SPAN, _winnowed(F.col("grams"))).otherwise(F.coalesce(*[F.when(F.size("w") == n, _hashes(F.col("w"), n)) for n in short], F.array().cast("array<bigint>")))
    marks = bounded(cut(items.select(F.explode(own).alias("mark")).distinct()))

    rows = documents_only(docs, "doc_id", "text").withColumn("key", text_key(F.col("text")))
    read = _tokens(rows, "doc_id", "key")
    met = read.select("doc_id", "key", F.explode(_marks(read, short)).alias("mark")).join(marks, "mark", "left_semi")
    met = cut(met.groupBy("doc_id", "key").agg(F.collect_set("mark").alias("marks")))
    small = met.agg(F.coalesce(F.sum(F.size("marks") + 4), F.lit(0))).first()[0] <= 1_000_000
    met = met.withColumnsRenamed({"doc_id": "d", "key": "k"})
    again = rows.join(F.broadcast(met) if small else met, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")))
    again = _tokens(again, "doc_id", "key", "marks")
    size = F.size("w")
    near = F.filter(_upto(size - (SPAN - 1)), lambda i: F.arrays_overlap(F.slice("grams", i, WINDOW), F.col("marks")))
    spots = [_spots(near, SPAN)]
    for n in short:
        start = F.filter(F.transform(_hashes(F.col("w"), n), lambda h, i: F.when(F.array_contains("marks", h), i + 1)), lambda i: i.isNotNull())
        spots.append(_spots(start, n))
    found = again.select("doc_id", "key", F.explode(F.concat(*spots)).alias("s")).select("doc_id", "key", "s.*").join(windows, ["n", "window"])
    found = found.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set(F.struct("at", "n"))).alias("spans"), F.flatten(F.collect_set("items")).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(1).alias("upto"))
    covered = F.aggregate("spans", start, lambda a, s: F.struct((a["total"] + F.greatest(s["at"] + s["n"] - F.greatest(a["upto"], s["at"]), F.lit(0))).alias("total"), F.greatest(a["upto"], s["at"] + s["n"]).alias("upto")))
    return found.select("doc_id", "key", covered["total"].alias("n_hit"), F.array_sort(F.array_distinct("items")).alias("item_ids"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids for every row of docs; repeated rows repeat their result."""
    found = cut(hits(docs, benchmark)).withColumnsRenamed({"doc_id": "d", "key": "k"})
    rows = documents_only(docs, "doc_id", "text").select("doc_id", text_key(F.col("text")).alias("key"), F.size(split_words(F.col("text"))).cast("long").alias("n_words"))
    out = rows.join(bounded(found), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that hold no window of an item."""
    d, k = unused(docs, "d", "k")
    found = bounded(cut(hits(docs, benchmark).select(F.col("doc_id").alias(d), F.col("key").alias(k))))
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col(d)) & (text_key(F.col("text")) == F.col(k)), "left_anti")


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = {
    "op9_winnowing": r"""
WITH lowered AS (SELECT 0 AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
items AS (SELECT DISTINCT CAST(id AS VARCHAR) AS item, least(len(w), 10) AS n, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS win FROM lowered WHERE side = 1 AND len(w) > 0),
lengths AS (SELECT DISTINCT n FROM items),
spots AS (SELECT id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: {'pos': i, 'win': array_to_string(w[i:i + n - 1], ' ')})) AS s FROM lowered, lengths WHERE side = 0),
met AS (SELECT id, s.pos AS pos, spots.n AS n, item FROM spots JOIN items ON spots.n = items.n AND s.win = items.win),
hit AS (SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT id, unnest(range(pos, pos + n)) AS p FROM met) GROUP BY id),
named AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT id, item FROM met) GROUP BY id)
SELECT l.id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM lowered l LEFT JOIN hit ON hit.id = l.id LEFT JOIN named ON named.id = l.id WHERE side = 0
""",
}
