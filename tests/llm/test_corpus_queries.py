"""Queries of the corpus operators: against SQL where there is some, else against plain Python, on the small tables."""

import base64
import hashlib
import math
import zlib
from collections import Counter

import pandas as pd
import pytest
import xxhash

from plain_versions import components, plain_repeats
from tidemark.llm import bpe, queries, runindex, simhash


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(name, same):
    same(queries.QUERIES[name], queries.SQL[name])


@pytest.fixture(scope="module")
def texts(sf_dir):
    return pd.read_parquet(f"{sf_dir}/documents.parquet").set_index("doc_id").text


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_op3(spark, sf_dir, texts):
    got = simhash.op3_simhash(spark, sf_dir).toPandas().set_index("doc_id")
    assert len(got) == len(texts)
    prints = [plain_fingerprint(t) for t in texts]
    assert [f"{p:016x}" for p in prints] == got.fingerprint[texts.index].tolist()
    top = components(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    assert [texts.index[i] for i in top] == got.component_id[texts.index].tolist()


def test_op4(spark, sf_dir):
    got = queries.QUERIES["op4_language"](spark, sf_dir).toPandas()
    pages = pd.read_parquet(f"{sf_dir}/pages.parquet")
    assert sorted(got.page_id) == sorted(pages.page_id)
    declared = pages.set_index("page_id").html.str.extract(r'<html lang="(\w+)"')[0]
    assert (got.set_index("page_id").lang == declared).mean() > 0.95


def test_op5(spark, sf_dir, texts):
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.op5_byte_bpe(spark, sf_dir).toPandas().set_index("doc_id")
    assert len(got) == len(texts)
    for i, t in texts.items():
        ids = plain.encode_ordinary(t)
        want = len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()
        assert tuple(got.loc[i, ["n_tokens", "ids_sha256", "decoded_sha256"]]) == want


def test_op6(spark, sf_dir, texts):
    got = queries.QUERIES["op6_hmm"](spark, sf_dir).toPandas().set_index("doc_id")
    tokens = {i: [*(w.decode() for w in t.encode().lower().split()), "\n"] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts.index}
    counts = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(counts.values()), len(counts)
    for i, t in tokens.items():
        row = got.loc[i]
        assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (held[i], len(t), sum(w in counts for w in t), n)
        assert row.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))
    out = got[got.held_out]
    assert out.score.sum() > out.base_score.sum()  # held-out texts are likelier than under counts alone


def test_op7_removes_copies_and_leaves_the_first(spark, sf_dir, texts):
    got = queries.QUERIES["op7_gear"](spark, sf_dir).toPandas().set_index("doc_id")
    for same in texts.groupby(texts).groups.values():
        first, *later = sorted(same)
        if len(texts[first].encode()) >= 64:
            assert all(got.n_removed[i] == got.n_bytes[i] for i in later)
    assert (got.n_bytes == texts.map(lambda t: len(t.encode()))).all()


@pytest.mark.parametrize("hot", [runindex.HOT, 5_000])
def test_op8(spark, sf_dir, texts, hot, monkeypatch):
    monkeypatch.setattr(runindex, "HOT", hot)  # at 5,000 the way for hot hashes is taken
    got = runindex.op8_run_index(spark, sf_dir).toPandas().set_index("doc_id").loc[texts.index]
    want = plain_repeats([t.encode() for t in texts])
    assert [tuple(r) for r in got[["n_bytes", "n_removed", "n_spans", "kept_sha256"]].itertuples(index=False)] == want
