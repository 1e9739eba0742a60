"""Taking byte spans out of texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, documents_only, text_key

SPAN = "struct<start:bigint,end:bigint>"


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id (long), key, text (null: empty)."""
    rows = documents_only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("doc_id", text_key(F.col("text")).alias("key"), "text")


def merged(spans: Column) -> Column:
    """Sorted spans, those that overlap or touch made one."""
    start = F.expr(f"struct(cast(null as bigint) as a, cast(null as bigint) as b, cast(array() as array<{SPAN}>) as done)")
    close = lambda x: F.concat(x["done"], F.array(F.struct(x["a"].alias("start"), x["b"].alias("end"))))
    longer = lambda x, s: F.struct(x["a"].alias("a"), F.greatest(x["b"], s["end"]).alias("b"), x["done"].alias("done"))
    fresh = lambda x, s: F.struct(s["start"].alias("a"), s["end"].alias("b"), F.when(x["a"].isNull(), x["done"]).otherwise(close(x)).alias("done"))
    return F.aggregate(spans, start, lambda x, s: F.when(s["start"] <= x["b"], longer(x, s)).otherwise(fresh(x, s)), lambda x: F.when(x["a"].isNull(), x["done"]).otherwise(close(x)))


def with_spans(docs: DataFrame, spans: DataFrame, most: int = 1_000_000, inner: bool = False) -> DataFrame:
    """keyed(docs) and, by (doc_id, key), the column spans of spans (doc_id, key, spans: array of SPAN, or of others if inner).

    Rows without spans get an empty array or, if inner, are left out. With `most` spans or fewer, counted, they are
    broadcast and texts stay where they are.
    """
    found = cut(spans.select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), "spans"))
    small = found.agg(F.coalesce(F.sum(F.size("spans") + 4), F.lit(0))).first()[0] <= most
    rows = keyed(docs)
    met = rows.join(F.broadcast(found) if small else found, rows["doc_id"].eqNullSafe(found["_d"]) & (rows["key"] == found["_k"]), "inner" if inner else "left")
    return met.select("doc_id", "key", "text", "spans" if inner else F.coalesce("spans", F.expr(f"cast(array() as array<{SPAN}>)")).alias("spans"))


def without(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """The bytes outside of sorted spans, the bytes taken out, and the number of maximal runs of them."""
    kept, upto, removed, runs = [], 0, 0, 0
    for start, end in spans:
        if start > upto or not runs:
            kept.append(data[upto:start])
            runs += 1
            removed += end - start
        elif end > upto:
            removed += end - upto
        upto = max(upto, end)
    kept.append(data[upto:])
    return b"".join(kept), removed, runs


def removal(docs: DataFrame, spans: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 [, kept binary] for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, found in zip(batch.column(1), batch.column(2), strict=True):
                data = text.as_py().encode()
                kept, removed, runs = without(data, [(s["start"], s["end"]) for s in found.as_py()])
                out.append((len(data), removed, runs, hashlib.sha256(kept).hexdigest(), kept))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            arrays = [pa.array([x[j] for x in out], kinds[j]) for j in range(5 if with_text else 4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 1 + len(arrays)])

    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return with_spans(docs, spans).select("doc_id", "text", "spans").mapInArrow(run, kind)
