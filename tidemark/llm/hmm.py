"""A hidden Markov language model.

Symbols: the `OWN` most frequent training words, the end sign, and `CLASSES` classes of all other words by a hash of their
last three characters; a word of a class has a share of its class that doesn't depend on the state. Baum-Welch counts are
gathered by each task over whole training texts, in scaled forward-backward passes, and summed by grouped aggregation;
what the driver gets is one row a symbol. The scaled forward recursion gives the exact likelihood of a text.

Word counts cover all training texts. The counts of the `NEAR` most frequent words travel to the tasks (a fixed bound); the
rest, most of the vocabulary and a few hundredths of the tokens, is joined by word, so nothing unbounded is broadcast.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, cut, table
from .spans import keyed

STATES, ROUNDS, OWN, CLASSES, NEAR = 8, 3, 32_768, 256, 200_000
PIECE, FLUSH, LANES, HELD, BACKING, STAY = 4 << 20, 400_000, 400_000, 2_000_000, 5_000.0, 0.95
STEP = 65_536  # rows of an array, or of a batch that goes out, at a time


def pieces(batches: Iterable[pa.RecordBatch], text: int, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of batches, each of one row or with `most` bytes or fewer in column text."""
    for batch in batches:
        ends, lo = np.cumsum(pc.binary_length(batch.column(text)).to_numpy(), dtype=np.int64), 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
            yield batch.slice(lo, hi - lo)
            pa.default_memory_pool().release_unused()  # else a worker keeps the most that any task of its took
            lo = hi


def tokens(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts of column in one array, A-Z in lower case, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(column))
    flat, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.greater(pc.binary_length(flat), 0)
    if not pc.all(full, min_count=0).as_py():  # blanks at the ends of a text leave empty words
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes), full.to_numpy(zero_copy_only=False), len(sizes)).astype(np.int64)
        flat = flat.filter(full)
    return flat, sizes


def ending(word: str) -> int:
    return zlib.crc32(word[-3:].encode()) % CLASSES


def _in_training(doc_id: Column) -> Column:
    """Rows with a null id count as training rows."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 1, F.lit(True))


def word_counts(rows: DataFrame) -> DataFrame:
    """word, c over the texts of rows (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: list[pa.Table] = []  # Arrow's, as Python's own strings and counts take several times the memory

        def summed() -> pa.Table:
            return pa.concat_tables(met).group_by("word", use_threads=False).aggregate([("c", "sum")]).select(["word", "c_sum"]).rename_columns(["word", "c"])

        for piece in pieces(batches, 0):
            found = tokens(piece.column(0))[0].value_counts()
            met.append(pa.table({"word": found.field("values"), "c": found.field("counts")}))
            if sum(map(len, met)) > 2 * FLUSH:
                met = [summed()]
                if len(met[0]) > FLUSH:
                    yield from met.pop().to_batches(STEP)
        if met:
            yield from summed().to_batches(STEP)

    return rows.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Model:
    """Ids: 0.. for the NEAR words by falling count, then a class each for other words, then the end sign."""

    near: pa.Array
    train_tokens: int
    types: int
    symbol: np.ndarray  # by id
    base: np.ndarray  # by id: base log10 probability; 0 for classes
    known: np.ndarray  # by id
    share: np.ndarray  # by id: log10 of the word's share of its class; 0 for words of their own, for classes and the end
    shares: np.ndarray  # by class: what (c + 0.5) of a word is divided by
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # (symbols, states)

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """Ids of all texts of column, each text's closed by the end sign; sizes; far words and the text that each is of."""
        flat, sizes = tokens(column)
        found = pc.index_in(flat, value_set=self.near)
        out = found.fill_null(-1).to_numpy().copy()
        far = np.flatnonzero(out < 0)
        words, text = flat.take(pa.array(far)), np.repeat(np.arange(len(sizes)), sizes)
        memo: dict[str, int] = {}
        for i, w in zip(far.tolist(), words.to_pylist(), strict=True):
            k = memo.get(w)
            if k is None:
                k = memo[w] = len(self.near) + ending(w)
            out[i] = k
        closed = np.full(len(out) + len(sizes), len(self.near) + CLASSES, np.int32)
        closed[np.arange(len(out)) + text] = out
        return closed, sizes + 1, words, text[far]


def likelihoods(texts: list[np.ndarray], model: Model) -> np.ndarray:
    """Natural log likelihoods of symbol sequences (none empty), by the scaled forward recursion; all run side by side."""
    order = np.argsort([-len(x) for x in texts], kind="stable")
    lengths = np.array([len(texts[i]) for i in order])
    flat, at = np.concatenate([texts[i] for i in order]), np.concatenate([[0], np.cumsum(lengths)[:-1]])
    logs, out = np.zeros(len(lengths)), np.empty(len(lengths))
    active = len(lengths) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right")
    a = np.repeat(model.start[None], len(lengths), axis=0)
    for t, n in enumerate(active.tolist()):
        a = (a[:n] @ model.move if t else a) * model.emit[flat[at[:n] + t]]
        s = a.sum(axis=1)
        logs[:n] += np.log(s)
        a /= s[:, None]
    out[order] = logs
    return out


def expected(texts: list[np.ndarray], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of start, move and emission over symbol sequences (none empty), by scaled forward-backward passes.

    Sequences run side by side, longest first, so that those still under way are always the first ones. Forward and
    backward variables, scaled at each step, are held in single precision.
    """
    emit, moves, begin = (x.astype(np.float32) for x in (model.emit, model.move, model.start))
    order = np.argsort([-len(x) for x in texts], kind="stable")
    lengths = np.array([len(texts[i]) for i in order])
    flat, at = np.concatenate([texts[i] for i in order]), np.concatenate([[0], np.cumsum(lengths)[:-1]])
    steps, k = lengths[0], len(begin)
    active = len(lengths) - np.searchsorted(lengths[::-1], np.arange(steps), side="right")
    offset = np.concatenate([[0], np.cumsum(active)])
    total = offset[-1]
    lane = np.arange(total) - np.repeat(offset[:-1], active)
    seen = flat[at[lane] + np.repeat(np.arange(steps), active)]
    del lane
    given = emit[seen]
    alpha = np.empty((total, k), np.float32)
    bounds = offset.tolist()
    a = begin * given[: bounds[1]]
    for t in range(steps):
        lo, hi = bounds[t], bounds[t + 1]
        if t:
            a = (a[: hi - lo] @ moves) * given[lo:hi]
        s = a.sum(axis=1, keepdims=True)
        a /= s
        alpha[lo:hi] = a
        given[lo:hi] /= s  # becomes emission times beta, over scale
    beta = np.ones((active[-1], k), np.float32)
    for t in range(steps - 1, -1, -1):
        lo, hi = bounds[t], bounds[t + 1]
        alpha[lo:hi] *= beta  # becomes gamma
        given[lo:hi] *= beta
        if t:
            beta = np.ones((active[t - 1], k), np.float32)
            beta[: hi - lo] = given[lo:hi] @ moves.T
    # gamma = alpha * beta, and beta of a step that goes on is positive, so alpha comes back by division
    before = np.arange(bounds[1], total) - np.repeat(active[:-1], active[1:])
    move = np.zeros((k, k))
    for lo in range(bounds[1], total, STEP):
        now = given[lo : lo + STEP]
        move += (alpha[before[lo - bounds[1] :][: len(now)]] / (now @ moves.T)).T @ now
    move *= model.move
    emission = np.column_stack([np.bincount(seen, alpha[:, j], len(emit)) for j in range(k)])
    return alpha[: bounds[1]].sum(axis=0, dtype=float), move, emission


def _groups(texts: list[np.ndarray]) -> Iterator[list[int]]:
    """Indices of texts, by length, in groups of about LANES symbols."""
    sizes = [len(x) for x in texts]
    group, total = [], 0
    for i in sorted(range(len(sizes)), key=sizes.__getitem__):
        if group and total + sizes[i] > LANES:
            yield group
            group, total = [], 0
        group.append(i)
        total += sizes[i]
    if group:
        yield group


def _held(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[list[np.ndarray]]:
    """Symbol sequences of the texts of batches, at least HELD symbols at a time, so that many long ones run side by side."""
    texts: list[np.ndarray] = []
    size = 0
    for piece in pieces(batches, 0):
        flat, sizes, _, _ = model.ids(piece.column(0))
        texts += np.split(model.symbol[flat], np.cumsum(sizes)[:-1])
        size += len(flat)
        if size > HELD:
            yield texts
            texts, size = [], 0
    if texts:
        yield texts


def expectation(rows: DataFrame, model: Model) -> DataFrame:
    """Expected counts over the texts of rows: symbol, e0, e1, ...; -1: start, -2 - i: moves from state i."""
    k = len(model.start)
    names = [f"e{j}" for j in range(k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(k), np.zeros((k, k)), np.zeros(model.emit.shape)]
        for texts in _held(batches, model):
            for group in _groups(texts):
                for whole, part in zip(sums, expected([texts[i] for i in group], model), strict=True):
                    whole += part
        used = np.flatnonzero(sums[2].sum(axis=1))
        names_of = np.concatenate([[-1], -2 - np.arange(k), used])
        found = np.vstack([sums[0][None], sums[1], sums[2][used]])
        for lo in range(0, len(names_of), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(names_of[lo : lo + 10_000], pa.int32()), *[pa.array(found[lo : lo + 10_000, j]) for j in range(k)]], ["symbol", *names])

    kind = "symbol int, " + ", ".join(f"{n} double" for n in names)
    return rows.select("text").mapInArrow(run, kind).groupBy("symbol").agg(*[F.sum(n).alias(n) for n in names])


def fit(rows: DataFrame, counts: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Train on all texts of rows (text); counts: word_counts(rows), cut.

    The driver gets NEAR words at most: those whose count is above the largest count that would make them more.
    """
    n, types, documents = *counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first(), rows.count()
    floor, words_above = 0, 0
    for c, k in counts.groupBy("c").agg(F.count("*").alias("k")).orderBy(F.desc("c")).limit(NEAR).collect():
        words_above += k
        if words_above > NEAR:
            floor = c
            break
    top = sorted((tuple(x) for x in counts.where(F.col("c") > floor).collect()), key=lambda x: (-x[1], x[0]))
    own = min(OWN, len(top))
    names = counts.sparkSession.createDataFrame([(w,) for w, _ in top[:own]], "word string")
    rest = counts.join(F.broadcast(names), "word", "left_anti").groupBy((F.crc32(F.right("word", F.lit(3)).cast("binary")) % CLASSES).alias("k")).agg(F.sum("c"), F.count("*")).collect()
    mass, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for k, c, v in rest:
        mass[k], kinds[k] = c, v
    shares = mass + 0.5 * (kinds + 1)
    train_tokens, all_types = n + documents, types + (documents > 0)
    classes = np.array([ending(w) for w, _ in top[own:]], np.int64)
    c = np.array([c for _, c in top], float)
    base = np.log10((np.append(c, documents) + 0.5) / (train_tokens + 0.5 * (all_types + 1)))
    model = Model(
        pa.array([w for w, _ in top], pa.string()), train_tokens, all_types,
        symbol=np.concatenate([np.arange(own), own + classes, own + np.arange(CLASSES + 1)]).astype(np.int32),
        base=np.concatenate([base[:-1], np.zeros(CLASSES), base[-1:]]),
        known=np.concatenate([np.ones(len(top), np.int64), np.zeros(CLASSES, np.int64), [documents > 0]]),
        share=np.concatenate([np.zeros(own), np.log10((c[own:] + 0.5) / shares[classes]), np.zeros(CLASSES + 1)]),
        shares=shares, start=np.full(states, 1 / states), move=None, emit=None,
    )
    share = np.concatenate([c[:own], mass + 0.5, [documents + 0.5]])
    share /= share.sum()
    tilt = np.random.default_rng(0).random((len(share), states)) + 0.5  # states must differ at first, or they never do
    model.emit = share[:, None] * tilt
    model.emit /= model.emit.sum(axis=0)
    model.move = np.full((states, states), (1 - STAY) / max(1, states - 1)) + np.eye(states) * (STAY - (1 - STAY) / max(1, states - 1))
    for _ in range(rounds if documents else 0):
        start, move, emission = np.zeros(states), np.zeros((states, states)), np.zeros(model.emit.shape)
        for symbol, *e in expectation(rows, model).collect():
            if symbol >= 0:
                emission[symbol] = e
            elif symbol == -1:
                start[:] = e
            else:
                move[-2 - symbol] = e
        model.start = (start + 1) / (start + 1).sum()
        model.move = (move + 1) / (move + 1).sum(axis=1, keepdims=True)
        model.emit = (emission + BACKING * share[:, None]) / (emission.sum(axis=0) + BACKING)
    return model


def _near_pass(rows: DataFrame, model: Model) -> DataFrame:
    """All that a task can tell of rows (doc_id, key, held_out, text): n_tokens, and known, base and score without far words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 3, 4 * PIECE):  # many run side by side, though words are looked up by the piece
            found, texts = [], []
            for piece in pieces([batch], 3):
                flat, sizes, _, _ = model.ids(piece.column(3))
                at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                found.append([sizes, *[np.add.reduceat(x[flat], at) for x in (model.known, model.base, model.share)]])
                texts += np.split(model.symbol[flat], at[1:])
            sizes, known, base, score = map(np.concatenate, zip(*found, strict=True))
            score += likelihoods(texts, model) / np.log(10)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(3)], pa.array(sizes), pa.array(known), pa.array(base), pa.array(score)], ["doc_id", "key", "held_out", "n_tokens", "known", "base", "score"])

    return rows.select("doc_id", "key", "held_out", "text").mapInArrow(run, "doc_id long, key long, held_out boolean, n_tokens long, known long, base double, score double")


def _far_words(rows: DataFrame, model: Model) -> DataFrame:
    """d, k, word, times, class of the words of each text of rows that aren't among the NEAR ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2):
            _, _, found, text = model.ids(batch.column(2))
            counts = Counter(zip(text.tolist(), found.to_pylist(), strict=True))
            take = pa.array([i for i, _ in counts], pa.int64())
            own = [w for _, w in counts]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(own, pa.string()), pa.array(counts.values(), pa.int64()), pa.array(map(ending, own), pa.int32())], ["d", "k", "word", "times", "class"])

    return rows.select("doc_id", "key", "text").mapInArrow(run, "d long, k long, word string, times long, class int")


def scores(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs (doc_id, text).

    Null texts are empty: one token, the end. A row that repeats another's doc_id and text gets the same result. Without a
    training row, base_score and score rest on no counts but stay finite.
    """
    rows = keyed(docs).withColumn("held_out", ~_in_training(F.col("doc_id")))
    counts = cut(word_counts(rows.where("not held_out")))
    model = fit(rows.where("not held_out"), counts, states, rounds)
    near, far = _near_pass(rows, model), _far_words(rows, model)
    shares = F.array(*[F.lit(float(x)) for x in model.shares])
    met = far.join(counts.withColumnRenamed("word", "w"), F.col("word") == F.col("w"), "left")
    c = F.coalesce("c", F.lit(0))
    each = met.select("d", "k", F.when(F.col("c") > 0, F.col("times")).otherwise(0).alias("known"), (F.col("times") * F.log10((c + 0.5) / float(model.train_tokens + 0.5 * (model.types + 1)))).alias("base"), (F.col("times") * F.log10((c + 0.5) / F.get(shares, F.col("class")))).alias("score"))
    sums = each.groupBy("d", "k").agg(*[F.sum(x).alias(f"far_{x}") for x in ("known", "base", "score")])
    # rows that repeat both doc_id and text share one sum, which is divided among them; a count a key, so no group meets in one place
    again = rows.groupBy("doc_id", "key").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "rows")
    same = lambda df, o: df.join(o, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left").drop("d", "k")
    out = same(same(near, bounded(cut(again))), sums)
    share = lambda x: F.coalesce(F.col(f"far_{x}") / F.coalesce("rows", F.lit(1)), F.lit(0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + share("known")).cast("long").alias("n_known"), F.lit(model.train_tokens).cast("long").alias("train_tokens"), (F.col("base") + share("base")).alias("base_score"), (F.col("score") + share("score")).alias("score"))


def op6_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))
