"""Suffix-array dedup by a run-compressed Burrows-Wheeler index: every byte covered by a string of 400 bytes or more that
also starts elsewhere.

1. Segments. Each window of `LEAST` bytes takes the smallest hash of its `GRAM`-byte strings; a run of windows with the same
   one is a segment. Equal windows have equal hashes, so a repeat can only be within or between segments of one hash. Only
   hashes with two segments, or with a segment that holds the hash twice, go on.
2. Contexts. A segment's text is its context; equal contexts are collapsed by digest, with a count.
3. Index. Contexts are dealt to buckets by hash. A bucket's texts, one that counts twice or more put in twice, get a suffix
   array and from it the run-compressed transform: suffixes at run ends are kept, with the length that they share with
   their neighbour over the run's boundary. Streaming over the texts, each position's matching statistic is the furthest
   reach of a run end seen so far: within a run the match of a position is that of the one before it, less its first byte.
   Positions that match `LEAST` bytes or more are marked. Texts of different hashes never meet (the hash is each suffix's
   first symbol), so no text is met with itself.
4. Marks are joined back to all places of a context.

A hash with more than `HOT` bytes of contexts (one passage in very many texts) would make its bucket grow with the data; for
those, every window's digest is counted instead, by grouped aggregation over distinct contexts: exact as well, and spread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import GEAR
from .common import bounded, cut, table
from .spans import SPAN, keyed, merged, removal, with_spans

LEAST, GRAM = 400, 64
WIDTH = LEAST - GRAM + 1  # hashes in a window
HOT, BUCKET, INDEX = 1 << 20, 3 << 18, 1 << 16
PLACE = 20  # bits of a place within a piece of a text
PIECE = (1 << PLACE) - 2 * LEAST
GEAR64 = GEAR.astype(np.uint64) << np.uint64(32) | np.array([xxhash.xxh32_intdigest(bytes([b]), 11) for b in range(256)], np.uint64)


def _window_minima(data: np.ndarray) -> np.ndarray:
    """For each window: the upper bits of its smallest hash, then PLACE bits: where it was met first."""
    h = GEAR64[data]
    for shift in (1, 2, 4, 8, 16, 32):
        h[shift:] = h[shift:] + (h[:-shift] << np.uint64(shift))
    h = h[GRAM - 1 :]
    h = (h ^ h >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15)
    h = h >> np.uint64(PLACE) << np.uint64(PLACE) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while span * 2 <= WIDTH:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return np.minimum(h[: len(h) - (WIDTH - span)], h[WIDTH - span :])


def segments_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, last window, whether the hash comes up in more than one place) of each segment."""
    n = len(data) - LEAST + 1
    if n < 1:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, bool),)
    found = [_window_minima(np.frombuffer(data, np.uint8)[at : at + PIECE + LEAST - 1]) for at in range(0, n, PIECE)]
    least = np.concatenate(found)[:n]
    value = least >> np.uint64(PLACE)
    first = np.concatenate([[0], np.flatnonzero(value[1:] != value[:-1]) + 1])
    moved = np.concatenate([[0], np.cumsum(least[1:] != least[:-1])])
    last = np.concatenate([first[1:] - 1, [n - 1]])
    return value[first].astype(np.int64), first, last, moved[last] > moved[first]


def segments(docs: DataFrame) -> DataFrame:
    """keyed docs -> m, doc_id, key, lo, hi, self."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                found = [segments_of(x.as_py().encode()) for x in part.column(2)]
                take = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
                columns = [np.concatenate([f[j] for f in found]) for j in range(4)]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0]), part.column(0).take(take), part.column(1).take(take), pa.array(columns[1]), pa.array(columns[2]), pa.array(columns[3])], ["m", "doc_id", "key", "lo", "hi", "self"])

    return docs.mapInArrow(run, "m long, doc_id long, key long, lo long, hi long, self boolean")


def suffix_array(text: np.ndarray, ends: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Positions of text by suffix; text: symbols from 1, 0 ends a string; ends: place of each position's end; group: most significant.

    Strings that end alike are told apart by their order in text. Prefix doubling over those not yet told apart.
    """
    n = len(text)
    bits = max(1, int(group[-1]).bit_length())
    chars = (63 - bits) // 9
    key, place = group.astype(np.int64), np.arange(n)
    alive = np.ones(n, bool)
    for j in range(chars):
        symbol = np.where(alive, text[np.minimum(place + j, n - 1)], 0).astype(np.int64)
        key = key << 9 | symbol
        alive &= symbol > 0
    order = np.argsort(key)
    ranked = key[order]
    new = np.ones(n, bool)
    new[1:] = ranked[1:] != ranked[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, place, 0))
    ended = np.flatnonzero(~alive[order])  # those that end within the key: by their order in text
    who = order[ended]
    who = who[np.lexsort((who, rank[who]))]
    order[ended], rank[who], new[ended] = who, ended, True
    h = chars
    while True:
        single = new & np.append(new[1:], True)
        slots = np.flatnonzero(~single)
        if not len(slots):
            return order
        who = order[slots]
        second = rank[who + h]
        again = np.argsort(rank[who] * n + second)
        who, second = who[again], second[again]
        order[slots] = who
        first = rank[who]
        fresh = np.ones(len(slots), bool)
        fresh[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        new[slots] = fresh
        rank[who] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))]
        h *= 2


def shared_lengths(data: np.ndarray, p: np.ndarray, q: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Bytes that data from p and from q have in common, up to most; data has eight bytes more than any place needs."""
    words = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    out = most.copy()
    live, at = np.arange(len(p)), 0
    while len(live):
        live = live[most[live] > at]
        x = words[p[live] + at] ^ words[q[live] + at]
        differ = x != 0
        x = x[differ]
        out[live[differ]] = np.minimum(most[live[differ]], at + (np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> 3).astype(np.int64))
        live = live[~differ]
        at += 8
    return out


def marked(texts: list[bytes], groups: list[int], counts: list[int], least: int = LEAST) -> list[list[tuple[int, int]]]:
    """For each text, spans covered by strings of `least` bytes that occur again in its group; groups must rise."""
    all_texts, owner = [], []
    for i, (t, c) in enumerate(zip(texts, counts, strict=True)):
        for _ in range(min(2, c)):
            all_texts.append(t)
            owner.append(i)
    sizes = np.array([len(t) + 1 for t in all_texts])
    stops = np.cumsum(sizes) - 1
    data = np.frombuffer(b"\0".join(all_texts) + b"\0" * 9, np.uint8)
    n = int(stops[-1]) + 1
    text = data[:n].astype(np.int16) + 1
    text[stops] = 0
    ends = np.repeat(stops, sizes)
    _, dense = np.unique(np.array(groups)[owner], return_inverse=True)
    group = np.repeat(dense, sizes)
    order = suffix_array(text, ends, group)
    begins = np.zeros(n, bool)
    begins[stops - sizes + 1] = True
    before = np.where(begins[order], -1, text[order - 1])  # the transform
    bound = np.flatnonzero(((before[1:] != before[:-1]) | (before[1:] < 0)) & (group[order[1:]] == group[order[:-1]])) + 1
    p, q = order[bound - 1], order[bound]
    shared = shared_lengths(data, p, q, np.minimum(ends[p] - p, ends[q] - q))
    reach = np.zeros(n, np.int64)
    np.maximum.at(reach, p, p + shared)
    np.maximum.at(reach, q, q + shared)
    long = np.maximum.accumulate(reach) - np.arange(n) >= least
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], long.astype(np.int8), [0]])))
    starts = stops - sizes + 1
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        k = int(np.searchsorted(starts, a, side="right")) - 1
        i = owner[k]
        if k == 0 or owner[k - 1] != i:
            out[i].append((a - int(starts[k]), b - 1 - int(starts[k]) + least))
    return out


def _contexts(places: DataFrame) -> DataFrame:
    """(doc_id, key, text, spans of windows by hash) -> m, d1, d2 (digest of the context), doc_id, key, lo, context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows, ms, los, texts, digests = [], [], [], [], []
                for i, (text, found) in enumerate(zip(part.column(2), part.column(3), strict=True)):
                    data = text.as_py().encode()
                    joined: list[list[int]] = []
                    for s in sorted((s["m"], s["lo"], s["hi"]) for s in found.as_py()):
                        if joined and joined[-1][0] == s[0] and s[1] < joined[-1][2] + LEAST:  # contexts that overlap are one text
                            joined[-1][2] = max(joined[-1][2], s[2])
                        else:
                            joined.append(list(s))
                    for m, lo, hi in joined:
                        own = data[lo : hi + LEAST]
                        rows.append(i)
                        ms.append(m)
                        los.append(lo)
                        texts.append(own)
                        digests.append(xxhash.xxh3_128_digest(own))
                take = pa.array(rows, pa.int64())
                halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(ms, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), part.column(0).take(take), part.column(1).take(take), pa.array(los, pa.int64()), pa.array(texts, pa.binary())], ["m", "d1", "d2", "doc_id", "key", "lo", "context"])

    return places.mapInArrow(run, "m long, d1 long, d2 long, doc_id long, key long, lo long, context binary")


def _indexed(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by([("m", "ascending"), ("d1", "ascending"), ("d2", "ascending")])
    m = rows.column("m").to_pylist()
    out: list[list[tuple[int, int]]] = []
    lo = 0
    while lo < len(m):  # hashes by hashes: small indices stay in the processor's cache
        hi, size = lo, 0
        texts: list[bytes] = []
        while hi < len(m) and (size < INDEX or m[hi] == m[hi - 1]):
            texts.append(rows.column("context")[hi].as_py())
            size += len(texts[-1])
            hi += 1
        out += marked(texts, m[lo:hi], rows.column("n").slice(lo, hi - lo).to_pylist())
        lo = hi
    spans = pa.array([[{"start": a, "end": b} for a, b in found] for found in out], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
    return pa.Table.from_arrays([rows.column("m"), rows.column("d1"), rows.column("d2"), spans], ["m", "d1", "d2", "spans"])


def _window_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            context, n = batch.column(3)[row].as_py(), batch.column(4)[row].as_py()
            for at in range(0, len(context) - LEAST + 1, 50_000):
                starts = range(at, min(at + 50_000, len(context) - LEAST + 1))
                halves = np.frombuffer(b"".join([xxhash.xxh3_128_digest(context[i : i + LEAST]) for i in starts]), np.int64).reshape(-1, 2)
                k = len(starts)
                same = [pa.array(np.full(k, batch.column(j)[row].as_py(), np.int64)) for j in range(3)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(np.array(starts, np.int64)), pa.array(np.full(k, n, np.int64))], ["m", "d1", "d2", "w1", "w2", "at", "n"])


def _counted(hot: DataFrame) -> DataFrame:
    """Spans of the contexts (m, d1, d2, context, n) of hot hashes: windows whose digest counts twice or more."""
    even = hot.select("m", "d1", "d2", "context", "n").repartition("d1", "d2")
    windows = even.mapInArrow(_window_digests, "m long, d1 long, d2 long, w1 long, w2 long, at long, n long")
    # cut, so that both sides of the join are plain exchanges: Spark can split a window that very many contexts have
    again = cut(windows.groupBy("m", "w1", "w2").agg(F.sum("n").alias("times")).where("times > 1").select("m", "w1", "w2"))
    met = windows.join(bounded(again), ["m", "w1", "w2"], "left_semi").groupBy("m", "d1", "d2").agg(F.array_sort(F.collect_set("at")).alias("at"))
    return met.select("m", "d1", "d2", merged(F.transform("at", lambda a: F.struct(a.alias("start"), (a + LEAST).alias("end")))).alias("spans"))


def _hot_contexts(docs: DataFrame, places: DataFrame, hot: DataFrame) -> DataFrame:
    """m, d1, d2, context, n of the distinct contexts of hot hashes alone: made by themselves, they are few, and can be cut."""
    own = places.select("doc_id", "key", F.explode("spans").alias("s")).select("doc_id", "key", "s", F.col("s.m").alias("m")).join(bounded(hot), "m", "left_semi")
    held = _contexts(with_spans(docs, own.groupBy("doc_id", "key").agg(F.collect_list("s").alias("spans")), 20_000, inner=True))
    return held.groupBy("m", "d1", "d2").agg(F.count("*").alias("n"), F.first("context").alias("context")).select("m", "d1", "d2", "context", "n")


def duplicate_spans(docs: DataFrame) -> DataFrame:
    """doc_id, key, spans (sorted, apart) of all rows of docs (doc_id, text) with a repeat of LEAST bytes or more.

    Rows that repeat both doc_id and text are occurrences of their own, so all of such a text of LEAST bytes or more is
    marked. Texts under LEAST bytes, empty and null ones have no spans.
    """
    found = segments(keyed(docs))
    again = cut(found.groupBy("m").agg(F.count("*").alias("c"), F.max("self").alias("s")).where("c > 1 or s").select("m"))
    kept = found.join(bounded(again), "m", "left_semi")
    places = cut(kept.groupBy("doc_id", "key").agg(F.array_distinct(F.collect_list(F.struct("m", "lo", "hi"))).alias("spans")))
    each = places.select(F.explode("spans").alias("s")).groupBy("s.m").agg(F.sum(F.col("s.hi") - F.col("s.lo") + LEAST).alias("size"))
    total = each.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    hot = cut(each.where(F.col("size") > HOT).select("m"))
    held = _contexts(with_spans(docs, places, 20_000, inner=True))
    unique = held.groupBy("m", "d1", "d2").agg(F.count("*").alias("n"), F.first("context").alias("context"))
    n_hot = hot.count()
    usual = unique.join(bounded(hot), "m", "left_anti") if n_hot else unique
    index = usual.groupBy(F.pmod("m", F.lit(max(1, -(-total // BUCKET)))).alias("bucket")).applyInArrow(_indexed, f"m long, d1 long, d2 long, spans array<{SPAN}>").where(F.size("spans") > 0)
    if n_hot:
        index = index.unionByName(_counted(cut(_hot_contexts(docs, places, hot))))
    marks = held.select("m", "d1", "d2", "doc_id", "key", "lo").join(index, ["m", "d1", "d2"])
    placed = F.transform("spans", lambda s: F.struct((s["start"] + F.col("lo")).alias("start"), (s["end"] + F.col("lo")).alias("end")))
    return marks.groupBy("doc_id", "key").agg(merged(F.array_sort(F.array_distinct(F.flatten(F.collect_list(placed))))).alias("spans"))


def deduplicated(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 [, kept] for every row of docs (doc_id, text).

    Null text is empty; texts under LEAST bytes keep all. Every occurrence of a repeat goes, the first one too, within one
    text as well as across; so does all of a row of LEAST bytes or more that another row repeats. Rows with a null doc_id
    count like any other. An empty table gives an empty one.
    """
    return removal(docs, duplicate_spans(docs), with_text)


def op8_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"), with_text=False)
