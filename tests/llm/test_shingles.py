"""Near copies by exact similarity, against all pairs."""

import random

import pandas as pd

from plain_versions import components
from tidemark.llm import simhash


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def texts():
    """Copies of several texts with words changed at random places, some just above and some just below 0.8; many of one."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(5000)}"
    out = ["", None, " ", "a b", "A  b", "a b c"]
    for k in range(12):
        base = [word() for _ in range(rng.choice((8, 40, 150)))]
        for _ in range(60 if k == 0 else 8):
            copy = list(base)
            for i in rng.sample(range(len(copy)), rng.randrange(max(2, len(copy) // 25))):
                copy[i] = word()
            out.append(" ".join(copy[: len(copy) - rng.randrange(1 + len(copy) // 8)]))
    return out


def held(spark, rows):
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    top = components([plain_set(t) for _, t in rows], near)
    want = pd.Series([rows[i][0] for i in top], [r[0] for r in rows])
    assert got.set_index("doc_id").component_id.sort_index().tolist() == want.sort_index().tolist()
    return want


def test_all_pairs_at_0_8_are_linked(spark):
    assert held(spark, list(enumerate(texts()))).nunique() < 120


def test_sample_documents(spark, sf_dir):
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet").sort_values("doc_id")
    held(spark, list(docs[["doc_id", "text"]].itertuples(index=False, name=None)))


def test_each_component_keeps_a_row_where_ids_repeat(spark):
    a, b = "the first of two texts, with words enough", "another text altogether, and not at all like it"
    docs = spark.createDataFrame([(3, a), (5, a), (5, b)], "doc_id long, text string")
    assert sorted(map(tuple, simhash.keep_one(docs).collect())) == [(3, a), (5, b)]


def test_balls_and_what_lies_around_them(spark):
    """Large groups around a text and around a variant of it, and texts that only some member links to a group."""
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(100_000)}"
    base = [word() for _ in range(150)]

    def changed(text, least, most, cut=0):
        copy = list(text)
        for i in rng.sample(range(len(copy)), rng.randint(least, most)):
            copy[i] = word()
        return copy[: len(copy) - rng.randint(0, cut)]

    other = changed(base, 4, 4)
    groups = [[base, base, *(changed(base, 1, 3, 12) for _ in range(60))], [other, *(changed(other, 1, 2, 8) for _ in range(40))]]
    around = [changed(rng.choice(g), 1, 2, 20) for g in groups for _ in range(50)]
    around += [changed(base, 4, 8, 15) for _ in range(30)]
    rows = [" ".join(t) for t in [*groups[0], *groups[1], *around]]
    rng.shuffle(rows)
    held(spark, list(enumerate(rows)))
