"""All pairs of texts whose word shingles have a Jaccard similarity of 0.8 or more, found exactly.

A set of shingles is a set of their 64-bit hashes; equal sets are collapsed into one node. Nodes that reach 0.8 share a
shingle among the first n - ceil(0.8 n) + 1 of each, in any order that all share (prefix filtering): shingles that a sample
finds common come last, so boilerplate seldom makes a candidate. The order decides what is compared, not what is found.

Of a pair that reaches 0.8, the first shingle that both have in that order leaves each with 4/9 of their sizes' sum at
least; pairs that meet at a shingle too far back, or of sizes too far apart, are dropped where they meet (positional filter).

Large groups of near copies would meet in the square of their size. So nodes with the same least hash and about one size
are first held against one of them, the one with most copies; those at 0.8 or more are linked to it and from then on stand
under it, as a ball, which has its farthest member's distance as radius. Jaccard distance is a metric: nodes under two
centres can only reach 0.8 where the centres are no further apart than 0.2 and the balls' radii; only then, and where the
centres themselves aren't linked, are members compared: those whose own distances leave it possible and, against a node
outside of all balls, those that share with it a shingle which their centre lacks, or are small enough to do without one.

Pairs are first held against each other by parity bitmaps, about three bits a shingle: two sets differ in at least as many
shingles as their bitmaps in bits. Only pairs that this leaves are compared by their whole sets, made again from the texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, cut

PIECE = 1 << 16
LEAST, SAMPLED, OFTEN, COMMON = 16, 16, 3, 100_000  # nodes for a ball; one text in so many is sampled; from so many on a shingle is common; common ones at most


def hashes(data: bytes, shingle: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles of a UTF-8 text, by pieces; bytes.lower() and bytes.split() are ASCII-only."""
    words = data.lower().split()
    if not words:
        return
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts, ends = (ends - lengths)[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    for at in range(0, n, PIECE):
        yield np.array([xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[at : at + PIECE], ends[at : at + PIECE], strict=True)], dtype="<u8")


def majority(pieces: Iterable[np.ndarray]) -> int:
    """SimHash: the bits that most of the hashes have; 0 without hashes."""
    ones, n = np.zeros(64, np.int64), 0
    for found in pieces:
        ones += np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(found)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def shingle_set(pieces: Iterable[np.ndarray]) -> np.ndarray:
    """Sorted distinct hashes."""
    return np.unique(np.concatenate([np.empty(0, "<u8"), *pieces]))


def digest(found: np.ndarray) -> int:
    """Names a set, as a signed long."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes())).astype(np.int64))


def prefix(found: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first n - ceil(0.8 n) + 1 of a set, common ones last."""
    n = len(found)
    if not n:
        return found
    late = common[np.minimum(np.searchsorted(common, found), len(common) - 1)] == found if len(common) else np.zeros(n, bool)
    return np.concatenate([found[~late], found[late]])[: n - (4 * n + 4) // 5 + 1]


def parity(found: np.ndarray) -> bytes:
    """A bit for each value of the hashes' low bits: whether an odd number of a set's hashes have it; 64 bits, or 2 n to 4 n."""
    size = max(64, 1 << (2 * len(found)).bit_length())
    return np.packbits(np.bincount((found & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1, bitorder="little").tobytes()


def differing(x: bytes, y: bytes) -> int:
    """Bits in which two parity bitmaps differ, the longer one folded: at most the shingles that only one of the sets has."""
    x, y = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)))).sum())


def _common(rows: DataFrame, shingle: int, seed: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(hashes((x.as_py() or "").encode(), shingle, seed)).view(np.int64))], ["h"])

    sample = rows.where(F.pmod("key", F.lit(SAMPLED)) == 0).select("text").mapInArrow(run, "h long")
    often = sample.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "h").limit(COMMON).toPandas()["h"]
    return np.sort(often.to_numpy(np.int64).view(np.uint64))


def prints(rows: DataFrame, shingle: int, seed: int) -> DataFrame:
    """rows (doc_id, key, text) -> doc_id, key, node (names its set), n (size), low (least hash), fp (SimHash), bits (parity), prefix; a row for each row."""
    common = _common(rows, shingle, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                pieces = [list(hashes((x.as_py() or "").encode(), shingle, seed)) for x in part.column(2)]
                sets = [shingle_set(p) for p in pieces]
                fps = np.array([majority(p) for p in pieces], np.uint64).view(np.int64)
                heads = [prefix(s, common) for s in sets]
                ends = np.cumsum([0, *map(len, heads)]).astype(np.int32)
                head = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(heads).astype("<u8").view(np.int64)))
                low = np.array([s[0] if len(s) else 0 for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([digest(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(low), pa.array(fps), pa.array([parity(s) for s in sets], pa.binary()), head], ["doc_id", "key", "node", "n", "low", "fp", "bits", "prefix"])

    return rows.select("doc_id", "key", "text").mapInArrow(run, "doc_id long, key long, node long, n long, low long, fp long, bits binary, prefix array<long>")


def _sets(rows: DataFrame, nodes: DataFrame, wanted: DataFrame, shingle: int, seed: int) -> DataFrame:
    """node, found (the set's hashes, binary) of the nodes that wanted (node) has, made again from the text of one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingle_set(hashes((x.as_py() or "").encode(), shingle, seed)).tobytes() for x in part.column(1)], pa.binary())], ["node", "found"])

    one = bounded(cut(nodes.join(wanted.distinct(), "node", "left_semi").select("node", F.col("of.doc_id").alias("d"), F.col("of.key").alias("k"))))
    texts = rows.join(one, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k"))).select("node", "text")
    return texts.mapInArrow(run, "node long, found binary").dropDuplicates(["node"])


def _possible(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of pairs (a, b, tenths) those that the sizes and bitmaps of nodes leave at a Jaccard distance of tenths / 10 or less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, tenths, n, m = (batch.column(i).to_numpy() for i in range(5))
            apart = np.array([differing(x.as_py(), y.as_py()) for x, y in zip(batch.column(5), batch.column(6), strict=True)], np.int64)
            apart = np.maximum(apart, np.abs(n - m))
            # differing d of n + m in all: d / ((n + m + d) / 2) is the distance
            keep = 20 * apart <= tenths * (n + m + apart)
            yield batch.select(["a", "b", "tenths"]).filter(pa.array(keep))

    side = lambda k, n, x: nodes.select(F.col("node").alias(k), F.col("n").alias(n), F.col("bits").alias(x))
    pairs = bounded(cut(pairs))
    met = pairs.join(side("a", "n", "x"), "a").join(side("b", "m", "y"), "b")
    return met.select("a", "b", "tenths", "n", "m", "x", "y").mapInArrow(run, "a long, b long, tenths int")


def compared(rows: DataFrame, nodes: DataFrame, pairs: DataFrame, shingle: int, seed: int) -> DataFrame:
    """Of pairs (a, b, tenths) those at a Jaccard distance of tenths / 10 or less, with both (shared shingles) and either (those of the union)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, y in zip(batch.column(3), batch.column(4), strict=True):
                x, y = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                out.append((both := len(np.intersect1d(x, y, assume_unique=True)), len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *[pa.array([o[i] for o in out], pa.int64()) for i in (0, 1)]], ["a", "b", "tenths", "both", "either"])

    pairs = cut(_possible(nodes, pairs))
    sets = cut(_sets(rows, nodes, pairs.select(F.col("a").alias("node")).union(pairs.select("b")), shingle, seed))
    met = pairs.join(sets.select(F.col("node").alias("a"), F.col("found").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("found").alias("y")), "b")
    told = met.select("a", "b", "tenths", "x", "y").mapInArrow(run, "a long, b long, tenths int, both long, either long")
    return cut(told.where("10 * (either - both) <= tenths * either"))


def _distance(both: str = "both", either: str = "either") -> Column:
    return (F.col(either) - F.col(both)) / F.col(either)


def links(rows: DataFrame, found: DataFrame, nodes: DataFrame, shingle: int, seed: int) -> DataFrame:
    """(a, b): links that give the nodes the components which all pairs at 0.8 or more would give them.

    rows (doc_id, key, text), found: prints(rows), nodes: node, n, low, bits, copies (rows), of (doc_id, key
    of one of them); both cut.
    """
    group = ["low", F.floor(F.log("n") * 10).alias("class")]
    at = nodes.where("n > 0").select("node", "n", "copies", *group)
    head = F.max_by(F.struct("node", "n"), F.struct("copies", "node"))  # variants of a text that is itself copied lie around it
    heads = cut(at.groupBy("low", "class").agg(F.count("*").alias("size"), head.alias("head")).where(F.col("size") >= LEAST))
    near = at.join(bounded(heads), ["low", "class"]).where((F.col("node") != F.col("head.node")) & (5 * F.least("n", "head.n") >= 4 * F.greatest("n", "head.n")))
    heads_of = near.select(F.col("head.node").alias("a"), F.col("node").alias("b"), F.lit(2).alias("tenths"))
    under = cut(compared(rows, nodes, heads_of, shingle, seed).select("a", "b", _distance().alias("far")))

    centres = bounded(under.select(F.col("b").alias("node"), F.col("a").alias("centre")))
    balls = bounded(cut(under.groupBy(F.col("a").alias("ball")).agg(F.ceil(10 * F.max("far")).cast("int").alias("radius"))))
    placed = found.where("n > 0").join(centres, "node", "left").join(bounded(cut(nodes.where("copies > 1").select("node", "copies"))), "node", "left")
    # rest: shingles of the set from this one on, itself included
    each = placed.select(F.posexplode("prefix").alias("i", "mark"), F.coalesce("centre", "node").alias("node"), "n", (F.col("centre").isNotNull() | F.col("copies").isNotNull()).alias("many"))
    marks = each.select("mark", "node", "n", (F.col("n") - F.col("i")).alias("rest"), "many")
    # what copies and members repeat is summed where it is read, and never meets in one place
    summed = marks.where("many").groupBy("mark", "node").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("rest").alias("rest"))
    once = marks.where("not many").select("mark", "node", F.col("n").alias("least"), F.col("n").alias("most"), "rest").union(summed)
    met = F.count("*").over(Window.partitionBy("mark"))
    marks = cut(once.repartition("mark").withColumn("c", met).where("c > 1").select("mark", "node", *[F.col(x).cast("int").alias(x) for x in ("least", "most", "rest")]))
    # sets at 0.8 share 4/9 of their sizes' sum; from their first common shingle on, each must have as many
    x, y = marks.alias("x"), marks.alias("y")
    enough = 9 * F.least("x.rest", "y.rest") >= 4 * (F.col("x.least") + F.col("y.least"))
    sized = (5 * F.col("x.most") >= 4 * F.col("y.least")) & (5 * F.col("y.most") >= 4 * F.col("x.least"))
    pairs = x.join(y, (F.col("x.mark") == F.col("y.mark")) & (F.col("x.node") < F.col("y.node")) & enough & sized)
    pairs = pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    pairs = pairs.join(balls.select(F.col("ball").alias("a"), F.col("radius").alias("ka")), "a", "left").join(balls.select(F.col("ball").alias("b"), F.col("radius").alias("kb")), "b", "left")
    radii = F.coalesce("ka", F.lit(0)) + F.coalesce("kb", F.lit(0))
    told = compared(rows, nodes, pairs.select("a", "b", (2 + radii).alias("tenths")), shingle, seed)
    told = told.join(balls.select(F.col("ball").alias("a"), F.col("radius").alias("ka")), "a", "left").join(balls.select(F.col("ball").alias("b"), F.col("radius").alias("kb")), "b", "left")
    direct = told.where("5 * both >= 4 * either").select("a", "b")

    apart = cut(told.where("5 * both < 4 * either").select("a", "b", "both", _distance().alias("apart"), F.col("ka"), F.col("kb")))
    if not apart.head(1):
        return under.select("a", "b").union(direct)
    members = cut(under.select(F.col("a").alias("centre"), F.col("b").alias("node"), "far").join(nodes.select("node", "n"), "node").select("centre", "node", "far", "n"))
    # a ball and a node outside: the node must have a shingle that the member has and the centre hasn't, or else, sharing no
    # more with the member than with the centre, find the member small enough
    flip = lambda ball, other: apart.where(f"{ball} is not null and {other} is null")
    lone = flip("ka", "kb").select(F.col("a").alias("centre"), F.col("b").alias("x"), "both", "apart").union(flip("kb", "ka").select("b", "a", "both", "apart"))
    lone = cut(lone.join(nodes.select(F.col("node").alias("x"), F.col("n").alias("nx")), "x").select("centre", "x", "both", "apart", "nx"))
    near = members.join(bounded(cut(lone.select("centre").distinct())), "centre", "left_semi")
    small = lone.join(near, (lone["centre"] == near["centre"]) & (9 * F.col("both") >= 4 * (F.col("nx") + F.col("n"))) & (F.col("apart") - F.col("far") <= 0.2 + 1e-9))
    extra = lambda df, name: _extras(rows, nodes, df.select("centre", F.col(name).alias("node")), shingle, seed).select("centre", F.col("node").alias(name), F.explode("extra").alias("mark"))
    shared = extra(lone, "x").join(extra(near, "node"), ["centre", "mark"]).select("x", "node")
    # two balls: members whose own distances leave it possible
    both = apart.where("ka is not null and kb is not null")
    own = balls.select(F.col("ball").alias("centre"), F.col("ball").alias("node"), F.lit(0.0).alias("far"))
    every = bounded(cut(members.select("centre", "node", "far").union(own)))
    m, o = every.alias("m"), every.alias("o")
    both = both.join(m, (F.col("a") == F.col("m.centre")) & (F.col("apart") - F.col("m.far") - F.col("kb") / 10 <= 0.2 + 1e-9))
    both = both.join(o, (F.col("b") == F.col("o.centre")) & (F.col("apart") - F.col("m.far") - F.col("o.far") <= 0.2 + 1e-9)).select(F.col("m.node").alias("x"), F.col("o.node").alias("node"))
    more = small.select("x", "node").union(shared).union(both).distinct()
    more = compared(rows, nodes, more.select(F.col("x").alias("a"), F.col("node").alias("b"), F.lit(2).alias("tenths")), shingle, seed).select("a", "b")
    return under.select("a", "b").union(direct).union(more)


def _extras(rows: DataFrame, nodes: DataFrame, pairs: DataFrame, shingle: int, seed: int) -> DataFrame:
    """pairs (centre, node) with extra: the hashes of the node's set that the centre's doesn't have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.setdiff1d(np.frombuffer(y.as_py(), "<u8"), np.frombuffer(x.as_py(), "<u8"), assume_unique=True).view(np.int64) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *found])))], ["centre", "node", "extra"])

    pairs = bounded(cut(pairs.distinct()))
    sets = cut(_sets(rows, nodes, pairs.select(F.col("centre").alias("node")).union(pairs.select("node")), shingle, seed))
    met = pairs.join(sets.select(F.col("node").alias("centre"), F.col("found").alias("x")), "centre").join(sets.select("node", F.col("found").alias("y")), "node")
    return met.select("centre", "node", "x", "y").mapInArrow(run, "centre long, node long, extra array<long>")
