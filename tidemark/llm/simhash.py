"""SimHash near-duplicates by anchor-point covering.

Fingerprints: 64 bits, one per document, by the majority of the XXH64 bits of its word shingles.

Links: all pairs of fingerprints at `DISTANCE` = 2 or fewer differing bits, found exactly. Anchors are the words of a
covering code: the product of two perfect binary Golay codes [23, 12], covering radius 3 each, on bits 0-22 and 23-45.
Every fingerprint lies within the covering radius of one anchor, its home. A second fingerprint that differs in e1 bits of
the first half and e2 of the second lies within 3 + e1 and 3 + e2 of that home; with e1 + e2 <= 2 the anchors that it must
be replicated to are the homes of the points in its ball of radius 2: about 70 out of 2^24. They depend on its two
syndromes alone, so they come from a table of 2048 rows. Per anchor, visitors are compared with those at home on all 64
bits, in a join; a pair shows up at the smaller one's home, once.

Equal fingerprints are collapsed first, with partial aggregation, so that copies never meet each other in a join.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shingles
from .common import bounded, connected_components, cut, documents_only, table, text_key, unused
from .spans import keyed

DISTANCE, SEED = 2, 42
GOLAY = 0b101011100011  # fixed value: generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def fingerprint(data: bytes, shingle: int = 3, seed: int = SEED) -> int:
    """Unsigned SimHash of a UTF-8 text; bytes.lower() and bytes.split() are ASCII-only, as the contract asks."""
    return shingles.majority(shingles.hashes(data, shingle, seed))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every row of docs (doc_id, text); null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint((x.as_py() or "").encode(), shingle) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    docs = documents_only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return docs.mapInArrow(run, "doc_id long, fp long")


class Covering:
    """For each syndrome of the Golay code, what to xor a word with to get the homes of its ball of radius 2, by cost."""

    def __init__(self) -> None:
        bits = [1 << i for i in range(23)]
        flips = [[0], bits, [a | b for a, b in itertools.combinations(bits, 2)], [a | b | c for a, b, c in itertools.combinations(bits, 3)]]
        self.basis = [self._syndrome(b) for b in bits]
        patterns = [e for group in flips for e in group]
        leader = {self._sum(e): e for e in patterns}  # the code is perfect: each of the 2048 syndromes has one pattern of weight 3 or less
        rows: list[list[list[int]]] = [[], [], []]
        syndromes = [[(e, self._sum(e)) for e in group] for group in flips[:3]]
        for s in range(2048):
            done: set[int] = set()
            for cost in range(3):
                new = {e ^ leader[s ^ of] for e, of in syndromes[cost]} - done
                done |= new
                rows[cost].append(sorted(new))
        self.moves = []
        for lists in rows:
            width = max(map(len, lists))
            self.moves.append(np.array([x + [-1] * (width - len(x)) for x in lists], np.int64))
        low = np.arange(1 << 12)
        self.syn = [self._table(low, 0), self._table(np.arange(1 << 11), 12)]

    @staticmethod
    def _syndrome(word: int) -> int:
        for i in range(22, 10, -1):
            if word >> i & 1:
                word ^= GOLAY << (i - 11)
        return word

    def _sum(self, e: int) -> int:
        s = 0
        for i in range(23):
            if e >> i & 1:
                s ^= self.basis[i]
        return s

    def _table(self, words: np.ndarray, shift: int) -> np.ndarray:
        return np.array([self._sum(int(w) << shift) for w in words], np.int64)

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        return self.syn[0][words & 4095] ^ self.syn[1][words >> 12]

    def anchors(self, fp: np.ndarray, radius: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
        """(row, anchor) of all anchors that each fingerprint is replicated to; radius 0: its home alone."""
        word = fp.view(np.uint64)
        halves = [(word & np.uint64((1 << 23) - 1)).astype(np.int64), (word >> np.uint64(23) & np.uint64((1 << 23) - 1)).astype(np.int64)]
        syn = [self.syndrome(h) for h in halves]
        rows, found = [], []
        for i, j in itertools.product(range(radius + 1), repeat=2):
            if i + j > radius:
                continue
            a, b = self.moves[i][syn[0]], self.moves[j][syn[1]]
            r, x, y = np.nonzero((a >= 0)[:, :, None] & (b >= 0)[:, None, :])
            rows.append(r)
            found.append((halves[0][r] ^ a[r, x]) << 23 | (halves[1][r] ^ b[r, y]))
        return np.concatenate(rows), np.concatenate(found)


def _replicate(radius: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Covering()
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                part = batch.slice(at, 20_000)
                fp, node = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                rows, anchors = code.anchors(fp, radius)
                for x in range(0, len(rows), 200_000):
                    take = rows[x : x + 200_000]
                    yield pa.RecordBatch.from_arrays([pa.array(anchors[x : x + 200_000]), pa.array(fp[take]), pa.array(node[take])], ["anchor", "fp", "node"])

    return run


def links(nodes: DataFrame) -> DataFrame:
    """(a, b) with a < b: nodes (fp long, distinct; node long, distinct) whose fingerprints differ in 1 or 2 bits."""
    kind = "anchor long, fp long, node long"
    home = nodes.select("fp", "node").mapInArrow(_replicate(0), kind).alias("h")
    visit = nodes.select("fp", "node").mapInArrow(_replicate(DISTANCE), kind).alias("v")
    near = F.bit_count(F.col("h.fp").bitwiseXOR(F.col("v.fp"))) <= DISTANCE
    return home.join(visit, (F.col("h.anchor") == F.col("v.anchor")) & (F.col("h.node") < F.col("v.node")) & near).select(F.col("h.node").alias("a"), F.col("v.node").alias("b"))


def print_links(found: DataFrame) -> DataFrame:
    """(a, b): links that give found's nodes (node, fp; a node may have several) the components of fingerprints at 2 or fewer bits.

    Nodes of one fingerprint are linked to the least of them, which stands for it in links().
    """
    prints = found.select("fp", "node").distinct()
    least = cut(prints.groupBy("fp").agg(F.min("node").alias("least")))
    same = prints.join(least, "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    return cut(same.union(links(least.select("fp", F.col("least").alias("node")))))


def fingerprint_groups(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id that links lead to, itself included) for every row of docs.

    Null and empty texts have fingerprint zero, linked like any other; a repeated doc_id gives a row per input row, and its
    fingerprints count as linked. Rows with a null doc_id are returned and link others, but give no component its id (a
    component of such rows alone has a null component_id).
    """
    prints = cut(fingerprints(docs, shingle))
    # without an id, the fingerprint stands in; those that share 62 bits are linked anyway
    unnamed = F.lit(1 << 62) + F.shiftrightunsigned("fp", 2)
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("id")).select("fp", F.coalesce("id", unnamed).alias("node")))
    parts = connected_components(links(nodes))
    named = nodes.join(parts, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    out = prints.join(named, "fp")
    return out.select("doc_id", "fp", F.when(F.col("component") < 1 << 62, F.col("component")).alias("component_id"))


def near_duplicates(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id that links lead to, itself included) for every row of docs.

    Links are all pairs of fingerprints at 2 or fewer differing bits, by the anchors, and besides all pairs of a Jaccard
    similarity of 0.8 or more of their word shingles, found exactly (`shingles`), most of which differ in more bits; a text
    with fewer words is one shingle. Null and empty texts are linked with each other. Rows with a null doc_id are
    returned and link others, but give no component its id (a component of such rows alone has a null component_id).
    """
    return _grouped(docs, shingle).drop("key")


def _grouped(docs: DataFrame, shingle: int) -> DataFrame:
    """As near_duplicates(), with key = text_key(text)."""
    rows = keyed(docs)
    found = cut(shingles.prints(rows, shingle, SEED))
    one = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key"))
    nodes = cut(found.groupBy("node").agg(F.first("n").alias("n"), F.first("low").alias("low"), F.first("bits").alias("bits"), F.count("*").alias("copies"), F.min("doc_id").alias("id"), one.alias("of")))
    near = print_links(found).union(shingles.links(rows, found, nodes, shingle, SEED))
    parts = cut(connected_components(near).join(nodes.select("node", "id"), "node"))
    ids = parts.groupBy("component").agg(F.min("id").alias("component_id"))
    linked = parts.join(bounded(cut(ids)), "component").select("node", F.lit(True).alias("linked"), "component_id")
    named = nodes.join(linked, "node", "left").select("node", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    return found.select("doc_id", "key", "fp", "node").join(named, "node").select("doc_id", "key", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """The rows of docs, all columns, without those linked to a document with a smaller doc_id.

    Rows with a null doc_id stay, and so do all rows of its component that have the doc_id that is kept; of a repeated
    doc_id, rows with other texts go or stay with the components of their own.
    """
    d, k = unused(docs, "d", "k")
    gone = _grouped(docs, shingle).where("doc_id <> component_id").select(F.col("doc_id").alias(d), F.col("key").alias(k)).distinct()
    return docs.join(bounded(cut(gone)), (F.col("doc_id") == F.col(d)) & (text_key(F.col("text")) == F.col(k)), "left_anti")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
