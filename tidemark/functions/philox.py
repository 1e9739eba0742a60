"""The counter stream: Philox-4x32-10 as Catalyst columns, as numpy and as DuckDB SQL, all with the same words.

A draw is a pure function of (seed, purpose, series slot, replicate, place), so results don't depend on partitioning and any
engine can repeat them. Key: the seed's 64 bits. Counter: (block of four words, replicate, slot, purpose).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The generator's multipliers and key increments.
M0, M1, W0, W1 = 0xD2511F53, 0xCD9E8D57, 0x9E3779B9, 0xBB67AE85
MASK, ROUNDS = 0xFFFFFFFF, 10
CACHED = 1 << 14  # permutations that numpy works on at a time

#: Purposes, one for each kind of draw.
IID_INDEX, BLOCK_START, RESTART, SEGMENT_START, RESIDUAL, INITIAL, MULTIPLIER = range(1, 8)


def seed_words(seed: int) -> tuple[int, int]:
    return seed & MASK, seed >> 32 & MASK


def _round_keys(seed: int) -> list[tuple[int, int]]:
    k0, k1 = seed_words(seed)
    return [((k0 + r * W0) & MASK, (k1 + r * W1) & MASK) for r in range(ROUNDS)]


def add_words(df: DataFrame, counter: list[Column], seed: int, names: list[str] | None = None) -> DataFrame:
    """df with four more bigint columns (w0..w3 unless named otherwise), each a word of 32 bits.

    A 32 x 32 bit product is kept within bigint by halves: with A = high half * c and B = low half * c, its upper word is
    (A + (B >> 16)) >> 16. One projection per step keeps the generated code small.
    """
    names = names or ["w0", "w1", "w2", "w3"]
    keep = [F.col(f"`{c}`") for c in df.columns]
    c = [f"_c{i}" for i in range(4)]
    df = df.select(*keep, *[x.cast("long").bitwiseAND(F.lit(MASK)).alias(n) for x, n in zip(counter, c, strict=True)])
    for k0, k1 in _round_keys(seed):
        halves = [(F.lit(m >> 16) * F.col(x)).alias(f"_{n}a") for m, x, n in ((M0, "_c0", "p"), (M1, "_c2", "q"))]
        halves += [(F.lit(m & 0xFFFF) * F.col(x)).alias(f"_{n}b") for m, x, n in ((M0, "_c0", "p"), (M1, "_c2", "q"))]
        df = df.select(*keep, *c, *halves)
        high = {n: F.shiftright(F.col(f"_{n}a") + F.shiftright(f"_{n}b", 16), 16) for n in "pq"}
        low = {n: (F.shiftleft(F.col(f"_{n}a").bitwiseAND(F.lit(0xFFFF)), 16) + F.col(f"_{n}b").bitwiseAND(F.lit(MASK))).bitwiseAND(F.lit(MASK)) for n in "pq"}
        new = [high["q"].bitwiseXOR(F.col("_c1")).bitwiseXOR(F.lit(k0)), low["q"], high["p"].bitwiseXOR(F.col("_c3")).bitwiseXOR(F.lit(k1)), low["p"]]
        df = df.select(*keep, *[x.alias(n) for x, n in zip(new, c, strict=True)])
    return df.select(*keep, *[F.col(x).alias(n) for x, n in zip(c, names, strict=True)])


def below(word: Column, n: Column) -> Column:
    """A draw from 0..n-1, n < 2^31."""
    return F.shiftright(word * n.cast("long"), 32)


def words(counter: tuple[np.ndarray | int, ...], seed: int) -> np.ndarray:
    """The same in numpy: counters broadcast against each other; the last axis of the result holds the four words."""
    shape = np.broadcast_shapes(*[np.shape(x) for x in counter])
    c = [np.array(x, np.uint64) & np.uint64(MASK) for x in counter]
    c = [x.reshape((1,) * (max(1, len(shape)) - x.ndim) + x.shape) for x in c]
    out = np.empty((*shape, 4), np.uint64)
    for at, found in _permuted(c, shape or (1,), seed):
        out.reshape(-1, *(shape or (1,))[1:], 4)[at] = np.stack(found, axis=-1)
    return out


def _round(c: list[np.ndarray], keys: tuple[int, int]) -> list[np.ndarray]:
    p, q = c[0] * np.uint64(M0), c[2] * np.uint64(M1)
    s32, mask = np.uint64(32), np.uint64(MASK)
    return [(q >> s32) ^ (c[1] ^ np.uint64(keys[0])), q & mask, (p >> s32) ^ (c[3] ^ np.uint64(keys[1])), p & mask]


def _permuted(c: list[np.ndarray], shape: tuple[int, ...], seed: int) -> Iterator[tuple[slice, list[np.ndarray]]]:
    """Slices of the first axis, as many cells as fit the cache, and the four words of their cells.

    c: counters of as many axes as shape, to be broadcast. For as long as they vary along one axis only, which is two rounds
    and part of a third where one is the replicate and another the place, they are worked on as they are.
    """
    keys = _round_keys(seed)
    for r in range(3):
        c = _round(c, keys[r])
    size = max(1, CACHED // max(1, math.prod(shape[1:])))
    s32, mask, m0, m1 = np.uint64(32), np.uint64(MASK), np.uint64(M0), np.uint64(M1)
    for at in range(0, shape[0], size):
        own = slice(at, min(at + size, shape[0]))
        cells = (own.stop - own.start, *shape[1:])
        c0, c1, c2, c3 = (np.array(np.broadcast_to(x[own] if x.shape[0] > 1 else x, cells)) for x in c)
        p, q = np.empty_like(c0), np.empty_like(c0)
        for k0, k1 in keys[3:]:
            np.multiply(c0, m0, out=p)
            np.multiply(c2, m1, out=q)
            np.right_shift(q, s32, out=c0)
            np.bitwise_xor(c0, c1, out=c0)
            np.bitwise_xor(c0, np.uint64(k0), out=c0)
            np.bitwise_and(q, mask, out=c1)
            np.right_shift(p, s32, out=c2)
            np.bitwise_xor(c2, c3, out=c2)
            np.bitwise_xor(c2, np.uint64(k1), out=c2)
            np.bitwise_and(p, mask, out=c3)
        yield own, [c0, c1, c2, c3]


def draws(seed: int, purpose: int, slot: int, first: int, replicates: int, n: int, below: int | None = None) -> np.ndarray:
    """(replicates, n) words: draw i of a replicate is word i % 4 of counter block i // 4; with below, scaled() to 0..below-1."""
    blocks = -(-n // 4)
    c = [np.arange(blocks, dtype=np.uint64)[None], np.arange(first, first + replicates, dtype=np.uint64)[:, None], np.full((1, 1), slot & MASK, np.uint64), np.full((1, 1), purpose, np.uint64)]
    out = np.empty((replicates, blocks, 4), np.uint64 if below is None else np.int64)
    for at, found in _permuted(c, (replicates, blocks), seed) if blocks else ():
        for j, w in enumerate(found):
            out[at, :, j] = w if below is None else (np.right_shift(np.multiply(w, np.uint64(below), out=w), np.uint64(32), out=w)).view(np.int64)
    return out.reshape(replicates, blocks * 4)[:, :n]


def scaled(words_: np.ndarray, n: int | np.ndarray) -> np.ndarray:
    """Draws from 0..n-1."""
    return (words_ * np.asarray(n, np.uint64) >> np.uint64(32)).astype(np.int64)


def sql(source: str, counter: list[str], seed: int, prefix: str = "ph") -> str:
    """CTEs for DuckDB, without WITH: the last, {prefix}, is source and four UBIGINT columns w0..w3."""
    parts = [f"{prefix}0 AS (SELECT *, {', '.join(f'({x})::UBIGINT & 4294967295 AS c{i}' for i, x in enumerate(counter))} FROM {source})"]
    for r, (k0, k1) in enumerate(_round_keys(seed)):
        new = (f"xor(xor((c2 * {M1}::UBIGINT) >> 32, c1), {k0}::UBIGINT)", f"(c2 * {M1}::UBIGINT) & 4294967295", f"xor(xor((c0 * {M0}::UBIGINT) >> 32, c3), {k1}::UBIGINT)", f"(c0 * {M0}::UBIGINT) & 4294967295")
        parts.append(f"{prefix}{r + 1} AS (SELECT * REPLACE ({', '.join(f'{x} AS c{i}' for i, x in enumerate(new))}) FROM {prefix}{r})")
    parts.append(f"{prefix} AS (SELECT * EXCLUDE (c0, c1, c2, c3), c0 AS w0, c1 AS w1, c2 AS w2, c3 AS w3 FROM {prefix}{ROUNDS})")
    return ",\n".join(parts)
