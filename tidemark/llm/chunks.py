"""Substring dedup by content-defined chunking with a gear rolling hash.

A gear hash adds a table value per byte and shifts; 32 bytes back it has forgotten. Where its top bits are zero a chunk may
end, so an insertion moves boundaries only nearby. Chunks are named by a 128-bit digest. The first occurrence of a digest
(smallest doc_id, then text key, then place) stays; a run of adjacent later ones goes if it has `LEAST` bytes or more, so
that a short phrase that comes up again by chance is left alone.

Digests are counted with partial aggregation; only those that repeat are joined back to the chunks, by broadcast up to a
counted bound, else by a plain join that Spark can split where one passage fills many documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, cut, table
from .spans import keyed, removal

SHORTEST, BITS, LONGEST, LEAST = 16, 5, 160, 64
GEAR = np.array([xxhash.xxh64_intdigest(bytes([b]), 7) & 0xFFFFFFFF for b in range(256)], np.uint32)
PIECE = 1 << 20


def boundaries(data: bytes, bits: int = BITS) -> list[int]:
    """Ends of the chunks of data, the last one at its end; empty data has none."""
    ends, last = [], 0
    for at in range(0, len(data), PIECE):
        own = np.frombuffer(data, np.uint8)[max(0, at - 31) : at + PIECE]
        h = GEAR[own]
        for shift in (1, 2, 4, 8, 16):  # h[t] = sum of GEAR[byte t - i] << i for i < 2 * shift
            h[shift:] = h[shift:] + (h[:-shift] << np.uint32(shift))
        found = np.flatnonzero(h >> np.uint32(32 - bits) == 0) + max(0, at - 31) + 1
        for end in found[found > at].tolist():
            if end - last < SHORTEST:
                continue
            while end - last > LONGEST:
                last += LONGEST
                ends.append(last)
            if end - last >= SHORTEST:
                ends.append(end)
                last = end
    while len(data) - last > LONGEST:
        last += LONGEST
        ends.append(last)
    if last < len(data):
        ends.append(len(data))
    return ends


def chunks(docs: DataFrame) -> DataFrame:
    """keyed docs -> doc_id, key, start, end, h1, h2 (the digest) of every chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows, starts, stops, digests = [], [], [], []
                for i, text in enumerate(part.column(2)):
                    data = text.as_py().encode()
                    ends = boundaries(data)
                    begin = [0, *ends[:-1]] if ends else []
                    rows.append(np.full(len(ends), i))
                    starts += begin
                    stops += ends
                    digests += [xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(begin, ends, strict=True)]
                take = pa.array(np.concatenate(rows))
                halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(starts, pa.int64()), pa.array(stops, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1])], ["doc_id", "key", "start", "end", "h1", "h2"])

    return docs.mapInArrow(run, "doc_id long, key long, start long, end long, h1 long, h2 long")


def duplicate_spans(docs: DataFrame) -> DataFrame:
    """doc_id, key, spans: runs of chunks that occur before, in this or another document of docs (doc_id, text).

    Rows that repeat both doc_id and text count as one row; a null doc_id comes before all others; null text is empty.
    """
    found = chunks(keyed(docs))
    place = F.struct("doc_id", "key", "start")
    again = found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("not (first <=> last)")
    again = bounded(cut(again.select("h1", "h2", "first")))
    later = found.join(again, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    runs = later.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("s"))
    start = F.expr("struct(cast(-1 as bigint) as a, cast(-1 as bigint) as b, cast(array() as array<struct<start:bigint,end:bigint>>) as done)")

    def close(x):  # noqa: ANN001, ANN202
        return F.when(x["b"] - x["a"] >= LEAST, F.concat(x["done"], F.array(F.struct(x["a"].alias("start"), x["b"].alias("end"))))).otherwise(x["done"])

    merged = F.aggregate("s", start, lambda x, y: F.when(x["b"] == y["start"], F.struct(x["a"].alias("a"), y["end"].alias("b"), x["done"].alias("done"))).otherwise(F.struct(y["start"].alias("a"), y["end"].alias("b"), close(x).alias("done"))), close)
    return runs.select("doc_id", "key", merged.alias("spans")).where(F.size("spans") > 0)


def deduplicated(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 [, kept] for every row of docs (doc_id, text).

    Null text is empty, and an empty text has no chunk and stays empty. Of equal chunks the one of the smallest doc_id (null
    first), then text key, then place stays. Rows that repeat both doc_id and text are one row to that rule and get the
    same result. An empty table gives an empty one.
    """
    return removal(docs, duplicate_spans(docs), with_text)


def op7_gear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"), with_text=False)
