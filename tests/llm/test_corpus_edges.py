"""Nulls in any column, empty and long texts, ties, repeated rows, empty tables and columns with clashing names."""

import random
import tracemalloc
from unittest.mock import MagicMock

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, chat, chunks, common, decontaminate, hmm, language, runindex, secrets, simhash, topk
from plain_versions import components, plain_repeats

DOCS = "doc_id long, text string, lang string, source string"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
ROWS = [
    (1, "A few words of a text. token = abcdef123", "en", "a"), (2, None, "en", None), (3, "", None, "a"), (4, "   \t\n ", "en", "a"),
    (None, "no id here, though words", "en", "a"), (None, None, None, None), (5, LONG, "en", "b"), (6, LONG, "en", "b"),
    (1, "A few words of a text. token = abcdef123", "en", "a"), (1, "another text of that id", "en", "a"), (7, "x", "en", "a"), (8, "\x00\x01 ÀÉ ß 日本", "de", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """With columns besides whose names operators use inside."""
    df = spark.createDataFrame(ROWS, DOCS)
    return df.select("*", *[F.lit("x").alias(c) for c in ("key", "fp", "node", "blob", "spans", "d", "k", "w", "_d", "_k", "_blob", "_gone", "_id", "host", "m", "text_ll")])


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def counted(df):
    return df.toPandas()


OPERATORS = {
    "simhash": simhash.near_duplicates,
    "bpe": lambda d: bpe.tokenised(d, bpe.public_vocabulary()),
    "hmm": lambda d: hmm.scores(d, states=2, rounds=1),
    "chunks": chunks.deduplicated,
    "runindex": runindex.deduplicated,
    "decontaminate": lambda d: decontaminate.contamination(d, d.select(F.lit("i").alias("item_id"), "text")),
    "secrets": secrets.per_document,
    "language": lambda d: language.identify_documents(d, language.train(d)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(name, docs, none):
    assert OPERATORS[name](docs).count() == len(ROWS)
    assert OPERATORS[name](none).count() == 0


@pytest.mark.parametrize("clean", [simhash.keep_one, lambda d: decontaminate.clean(d, d.select(F.lit("i").alias("item_id"), F.lit("few words of").alias("text"))), secrets.masked, lambda d: language.clean(d, d)])
def test_cleaners_keep_columns(clean, docs, none):
    assert clean(docs).columns == docs.columns
    assert 0 < clean(docs).count() <= len(ROWS)
    assert clean(none).count() == 0


def test_simhash_components(spark, docs):
    got = counted(simhash.near_duplicates(docs))
    assert set(got[got.fp == 0].component_id) == {2}  # null, empty and blank texts, rows without id too
    assert got[got.doc_id == 6].component_id.item() == 5
    assert set(got[got.doc_id == 1].component_id) == {1}


def test_covering_code_misses_no_pair():
    code, rng = simhash.Covering(), np.random.default_rng(0)
    assert sum(len(x) for x in code.moves) == 3 * 2048
    x = rng.integers(0, 1 << 62, 60)
    rows, anchors = code.anchors(x)
    for i in range(60):
        for _ in range(30):
            y = int(x[i])
            for b in rng.choice(62, rng.integers(0, 3), replace=False):
                y ^= 1 << int(b)
            assert code.anchors(np.array([y]), 0)[1][0] in anchors[rows == i]


def test_simhash_chain_and_dense_group(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(63) for _ in range(40)]
    prints = base + [b ^ 1 << rng.randrange(63) ^ 1 << rng.randrange(63) for b in base for _ in range(6)] + [base[0] ^ 1 << i for i in range(63)]
    prints = sorted(set(prints))
    nodes = spark.createDataFrame([(p, i) for i, p in enumerate(prints)], "fp long, node long")
    got = {r["node"]: r["component"] for r in common.connected_components(simhash.links(nodes)).collect()}
    want = components(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    assert [got.get(i, i) for i in range(len(prints))] == want


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1400)] + [(5, 5), (2001, 2000), (2000, 2001)]
    got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(201)} == {0} and {got[i] for i in range(1000, 1400)} == {1000} and got[2001] == 2000


def test_run_index_on_hard_texts(spark):
    rng = random.Random(3)
    rnd = lambda n: "".join(rng.choice("abcdefghij klmnop") for _ in range(n))
    p, q = rnd(900), rnd(401)
    texts = [p, "x" + p + "y", rnd(300) + p[:500] + rnd(200), None, "", "a" * 3000, "ab" * 1500, q, "é" * 10 + q + "z", p[100:700] + p[50:600], rnd(399), rnd(450), "same text " * 60, p[:400], p[:399], "\x00" * 900]
    rows = list(enumerate(texts)) + [(12, texts[12]), (11, texts[11])]
    got = runindex.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), False).toPandas()
    want = sorted((i, *w) for (i, _), w in zip(rows, plain_repeats([(t or "").encode() for _, t in rows]), strict=True))
    assert sorted(tuple(r) for r in got[["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]].itertuples(index=False)) == want


def test_suffix_array_is_sorted():
    rng = random.Random(5)
    for _ in range(30):
        parts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 8))]
        groups = sorted(rng.randint(0, 2) for _ in parts)
        sizes = np.array([len(x) + 1 for x in parts])
        stops = np.cumsum(sizes) - 1
        text = np.frombuffer("\0".join(parts).encode() + b"\0", np.uint8).astype(np.int16) + 1
        text[stops] = 0
        owner = np.repeat(np.arange(len(parts)), sizes)
        order = runindex.suffix_array(text, stops[owner], np.array(groups)[owner])
        starts = stops - sizes + 1
        want = sorted(range(len(text)), key=lambda i: (groups[owner[i]], parts[owner[i]][i - starts[owner[i]] :] + "\0", owner[i]))
        assert order.tolist() == want


def test_chunks_resist_insertions():
    rng = random.Random(2)
    text = bytes(rng.randrange(97, 123) for _ in range(20_000))

    def cuts(t):
        ends = chunks.boundaries(t)
        return [t[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    pieces = lambda t: set(cuts(t))
    assert b"".join(cuts(text)) == text
    assert len(pieces(text) & pieces(text[:5000] + b"inserted" + text[5000:])) > 0.97 * len(pieces(text))
    assert chunks.boundaries(b"") == [] and chunks.boundaries(b"a") == [1]
    sizes = np.diff([0, *chunks.boundaries(text)])
    assert sizes.max() <= chunks.LONGEST and (sizes[:-1] >= chunks.SHORTEST).all()


def test_shared_passage_is_found_and_clean_text_is_left(spark):
    rng = random.Random(4)
    words = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))
    passage = words(80)
    rows = [(i, f"{words(100)} {passage} {words(60)}" if i < 20 else words(150)) for i in range(40)]
    got = chunks.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().set_index("doc_id")
    assert got.n_removed[0] == 0 and (got.n_removed[list(range(20, 40))] == 0).all()
    assert (got.n_removed[list(range(1, 20))] > 0.6 * len(passage)).all()


@pytest.mark.parametrize(("text", "items", "hit"), [
    ("a b c d e f g h i j k", ["b c d e f g h i j k"], 10),
    ("a b c d e f g h i j k", ["x b c d e f g h i j"], 0),
    ("One two THREE four", ["two three"], 2), ("one two", ["one two three"], 0), ("q q q q q q q q q q q q", ["q q q q q q q q q q"], 12),
    ("", ["a"], 0), ("a-b_c", ["a b c", ""], 3), ("É é", ["É"], 1), ("w", [None], 0),
])
def test_decontamination_cases(spark, text, items, hit):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontaminate.contamination(spark.createDataFrame([(1, text)], "doc_id long, text string"), bench).first()
    assert got["n_hit"] == hit and (len(got["item_ids"]) > 0) == (hit > 0)


def test_winnowing_misses_no_shared_span(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(30)]
    items = [[rng.choice(words) for _ in range(14)] for _ in range(12)]
    rows = []
    for i in range(120):
        body = [rng.choice(words) for _ in range(rng.randint(0, 40))]
        at, item = rng.randint(0, len(body)), rng.choice(items)
        body[at:at] = item[(a := rng.randint(0, 4)) : a + rng.randint(8, 10)]
        rows.append((i, " ".join(body)))
    bench = {tuple(x[i : i + 10]) for x in items for i in range(5)}
    got = decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")).toPandas().set_index("doc_id")
    for i, t in rows:
        w = t.split()
        spots = {p + j for p in range(len(w) - 9) if tuple(w[p : p + 10]) in bench for j in range(10)}
        assert got.n_hit[i] == len(spots)


def test_secret_ledger(spark):
    docs = spark.createDataFrame([(1, 'token = "abcdef123"'), (2, 'token = "abcdef123"'), (3, "nothing"), (4, "AKIA" + "A" * 16), (5, "token=ab token: abcdefg")], "doc_id long, text string")
    first = secrets.scan(docs)
    ledger = first.ledger().cache()
    assert ledger.count() == 4 * 3  # distinct blobs times rules
    again = secrets.scan(docs.union(spark.createDataFrame([(6, "f" * 30)], "doc_id long, text string")), ledger)
    assert again.seen.count() == 3  # one new blob
    new = (*secrets.RULES[:2], secrets.Rule("hex", 2, "[0-9a-f]{30,}", 0, 30, "[0-9a-f]{30}"))
    assert secrets.scan(docs, ledger, new).seen.count() == 4  # one new rule version
    plain = {r["doc_id"]: r["spans"] for r in secrets.per_document(docs).collect()}
    kept = {r["doc_id"]: r["spans"] for r in secrets.per_document(docs, ledger).collect()}
    assert plain == kept and [len(plain[i]) for i in range(1, 6)] == [1, 1, 0, 1, 1]
    assert {r["doc_id"]: r["text"] for r in secrets.masked(docs).collect()}[1] == '[SECRET]"'


def test_top_k_cases(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    rows += [(300, rows[7][1]), (300, rows[7][1]), (301, None), (302, [1.0, None] * 4), (303, [float("nan")] * 8), (None, rows[0][1]), (304, [0.0] * 8), (305, [1.0, 2.0]), (306, [])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = topk.search(df, df.where("id % 50 = 0 or id in (304, 305)"), 5).toPandas()
    use = {i: np.floor(256 * np.array(v)) for i, v in rows if i is not None and i not in (301, 302, 303, 305, 306)}
    for q in (0, 50, 100, 150, 200, 250, 300, 304):
        want = sorted(((-int(use[q] @ v), i) for i, v in use.items() if i != q))[:5]
        part = got[got.query_id == q].sort_values("rank")
        assert [(-s, i) for s, i in zip(part.score, part.vec_id, strict=True)] == want
    assert 305 not in set(got.query_id)
    assert topk.search(df.where("false"), df, 5).count() == 0


def test_top_k_stops_early():
    rng = np.random.default_rng(1)
    rows = np.floor(rng.normal(size=(4000, 3)) * 256)
    lists = np.argsort(rows, axis=0, kind="stable")
    ids = np.arange(4000)
    for q in np.floor(rng.normal(size=(20, 3)) * 256):
        got = topk.threshold_search(ids, rows, lists, q, -1, 5)
        want = topk.best_of(ids, rows @ q, 5)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
    big = np.array([[2**40, 2**30], [2**40, 2**30 - 1]], object)
    assert topk.threshold_search(np.array([1, 2]), big, np.array([[0, 1], [1, 0]]), np.array([2**10, 2**20], object), 9, 1)[0].tolist() == [1]


def test_preferences(spark):
    kind = "pair_id long, turn long, role string, text string"
    c = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "good"), (2, 0, "user", None), (3, 0, "user", "only"), (None, 0, "user", "x"), (4, None, None, "t"), (4, 1, "assistant", "same"), (1, 0, "user", "hi")], kind)
    r = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "bad one"), (1, 2, "user", "why"), (2, 0, "user", ""), (4, None, None, "t"), (4, 1, "assistant", "same")], kind)
    got = {x["pair_id"]: x for x in chat.format_preferences(c, r).collect()}
    assert set(got) == {1, 2, 3, 4}
    one = got[1]
    assert (one["n_prompt_turns"], one["prompt"]) == (1, "<|user|>\nhi<|end|>\n")
    assert one["chosen"] == "<|assistant|>\ngood<|end|>\n" and one["rejected"].startswith("<|assistant|>\nbad one<|end|>\n<|user|>")
    assert [one["chosen"][s["start"] : s["end"]] for s in one["chosen_mask"]] == ["good<|end|>"]
    assert [one["rejected"][s["start"] : s["end"]] for s in one["rejected_mask"]] == ["bad one<|end|>"]
    assert got[2]["chosen"] == got[2]["rejected"] == "" and got[2]["n_prompt_turns"] == 1
    assert got[3]["prompt"] == "" and got[3]["rejected"] == ""
    assert got[4]["n_prompt_turns"] == 2
    assert chat.format_preferences(c.where("false"), r.where("false")).count() == 0


def test_hidden_markov_passes_by_enumeration():
    rng = np.random.default_rng(0)
    norm = lambda a, axis: a / a.sum(axis=axis, keepdims=True)
    start, move, emit = norm(rng.random(2), 0), norm(rng.random((2, 2)), 1), norm(rng.random((3, 2)), 0)
    model = hmm.Model(None, 0, 0, None, None, None, None, None, start, move, emit)
    texts = [rng.integers(0, 3, n) for n in (1, 4, 2, 4, 3)]
    logs, sums = [], [np.zeros(2), np.zeros((2, 2)), np.zeros((3, 2))]
    for t in texts:
        paths = [(s, start[s[0]] * emit[t[0], s[0]] * np.prod([move[a, b] * emit[o, b] for a, b, o in zip(s, s[1:], t[1:], strict=False)])) for s in np.ndindex(*(2,) * len(t))]
        total = sum(p for _, p in paths)
        logs.append(np.log(total))
        for s, p in paths:
            sums[0][s[0]] += p / total
            for a, b in zip(s, s[1:], strict=False):
                sums[1][a, b] += p / total
            for o, b in zip(t, s, strict=True):
                sums[2][o, b] += p / total
    np.testing.assert_allclose(hmm.likelihoods(texts, model), logs)
    for got, want in zip(hmm.expected(texts, model), sums, strict=True):
        np.testing.assert_allclose(got, want, rtol=1e-4)


@pytest.mark.parametrize("name", ["count", "expected", "near", "far"])
def test_hidden_markov_splits_few_bytes_at_a_time(spark, monkeypatch, name):
    texts = [" ".join(f"w{(i + j) % 900:03}" for j in range(1_000)) for i in range(1_200)]  # 6 MB in a batch
    states = np.full(2, 0.5), np.full((2, 2), 0.5), np.full((1 + hmm.CLASSES, 2), 1 / (1 + hmm.CLASSES))
    model = hmm.Model(pa.array([], pa.string()), 0, 0, np.arange(1 + hmm.CLASSES, dtype=np.int32), *np.ones((3, 1 + hmm.CLASSES)), None, *states)
    given, split, rows = [], hmm.tokens, MagicMock()
    monkeypatch.setattr(hmm, "tokens", lambda column: given.append(sum(map(len, column.to_pylist()))) or split(column))
    columns = {"count": ["text"], "expected": ["text"], "near": ["doc_id", "key", "held_out", "text"], "far": ["doc_id", "key", "text"]}[name]
    {"count": hmm.word_counts, "expected": lambda r: hmm.expectation(r, model), "near": lambda r: hmm._near_pass(r, model), "far": lambda r: hmm._far_words(r, model)}[name](rows)
    run = rows.select.return_value.mapInArrow.call_args.args[0]
    batch = pa.RecordBatch.from_arrays([pa.array(texts) if c == "text" else pa.array(range(len(texts))) for c in columns], columns)
    out = pa.Table.from_batches(run(iter([batch])))
    assert sum(given) == sum(map(len, texts)) and max(given) <= 4 << 20
    if name == "near":
        assert out["n_tokens"].to_pylist() == [1_001] * len(texts)
    if name in ("count", "far"):
        assert sum(out["c" if name == "count" else "times"].to_pylist()) == 1_000 * len(texts)


def test_hidden_markov_counts_hold_few_copies():
    rng = np.random.default_rng(1)
    emit = rng.random((50, 8))
    model = hmm.Model(None, 0, 0, None, None, None, None, None, np.full(8, 1 / 8), np.full((8, 8), 1 / 8), emit / emit.sum(axis=0))
    texts = [rng.integers(0, 50, 500).astype(np.int32) for _ in range(800)]  # 400,000 symbols, 12.8 MB a state array
    tracemalloc.start()
    try:
        start, _, emission = hmm.expected(texts, model)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    np.testing.assert_allclose([start.sum(), emission.sum()], [800, 400_000], rtol=1e-4)
    assert most < 48e6


def test_hidden_markov_pieces():
    batch = pa.RecordBatch.from_arrays([pa.array(["", "ab", "abcdefgh", "a", "bc", "", "abcde"])], ["text"])
    got = [p.column(0).to_pylist() for p in hmm.pieces(iter([batch, batch.slice(0, 0), batch.slice(4)]), 0, 4)]
    assert got == [["", "ab"], ["abcdefgh"], ["a", "bc", ""], ["abcde"], ["bc", ""], ["abcde"]]


def test_language_evidence(spark):
    en, de = "the quick brown fox jumps over the lazy dog and then some more of it", "der schnelle braune Fuchs springt über den faulen Hund und noch etwas mehr"
    labelled = spark.createDataFrame([(i, en if i % 2 else de, "en" if i % 2 else "de") for i in range(20)], "doc_id long, text string, lang string")
    model = language.train(labelled)
    page = lambda text, lang: f'<html lang="{lang}"><script>var x</script><p>{text}</p></html>'
    rows = [(i, f"http://a.example.de/{i}", page(de, "de")) for i in range(8)] + [(8, "http://a.example.de/8", page("xq 12", "de")), (9, None, None), (10, "not a url", "<p>123</p>"), (11, "http://b.example.com", page(en, ""))]
    got = {r["page_id"]: r["lang"] for r in language.identify_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()}
    assert [got[i] for i in range(9)] == ["de"] * 9  # page 8: the text says little, host, markup and suffix decide
    assert got[9] == got[10] == "und" and got[11] == "en"


def test_bpe_model_finds_every_token():
    vocabulary = bpe.public_vocabulary()
    codec = vocabulary.codec()
    assert codec.decode(range(50_256)) == b"".join(vocabulary.tokens)
    for text in ("", " ", "a" * 3000, "don't  we\n\n  go\t", "日本 🎉\x00"):
        assert codec.decode(codec.encode(text)) == text.encode()


def test_hosts_and_code_travel(spark):
    assert common.shared_dir(spark)
    assert pd.notna(common.cut(spark.range(3)).count())
