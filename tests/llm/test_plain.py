"""Operators that SQL can't express, against plain Python on the small tables: language posteriors, chunks, the hidden Markov model."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash

import corpus_pipeline
from tidemark.llm import chunks, hmm, language, queries

DROP = r"(?is)<(script|style|nav|header|footer|aside)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[#0-9a-z]{1,10};"


@pytest.fixture(scope="module")
def docs(sf_dir):
    return pd.read_parquet(f"{sf_dir}/documents.parquet").sort_values("doc_id", ignore_index=True)


def grams(text):
    """Trigram buckets, one by one."""
    line = b" " + b" ".join(text.lower().split()) + b" "
    line = bytes(48 if 48 <= c <= 57 else c for c in line)
    if len(line) < 3 or not any(97 <= c <= 122 or c >= 128 for c in line):
        return []
    m = 1 << 32
    return [((a * 0x9E3779B1 % m ^ b * 0x85EBCA77 % m ^ c * 0xC2B2AE3D % m) >> 7) % language.BUCKETS for a, b, c in zip(line, line[1:], line[2:], strict=False)]


def plain_posteriors(docs, pages):
    """page_id -> (language, confidence, language by text), by the formula at the head of the module."""
    sums = defaultdict(Counter)
    for text, lang in zip(docs.text, docs.lang, strict=True):
        sums[lang].update(grams(text.encode()))
    names = sorted(sums)
    n = len(names)
    logs = [[math.log((sums[x][g] + 0.5) / (sum(sums[x].values()) + 0.5 * language.BUCKETS)) for g in range(language.BUCKETS)] for x in names]
    rows = []
    for page, url, html in pages[["page_id", "url", "html"]].itertuples(index=False):
        host = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", url or "")
        host = host[1].lower() if host else None
        found = re.search(r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]{2,3})", html or "")
        markup = found[1].lower() if found else ""
        suffix = re.search(r"\.([a-z]+)$", host or "")
        suffix = suffix[1] if suffix else ""
        suffix = language.SUFFIXES.get(suffix, suffix) if language.SUFFIXES.get(suffix, suffix) in names else suffix
        own = grams(re.sub(DROP, " ", html or "").encode())
        ll = [sum(logs[k][g] for g in own) for k in range(n)] + [-math.log(language.BUCKETS) * len(own)]
        best = max(range(n + 1), key=lambda k: ll[k]) if own else n
        rows.append((page, host, markup, suffix, [x * min(len(own), 60) / len(own) if own else 0.0 for x in ll], len(own), best))

    def table(place):
        counts = Counter((r[place] if r[place] in names or not r[place] else "other", r[6]) for r in rows if r[6] < n)
        total = sum(counts.values())
        share = lambda c: (sum(counts[c, k] for k in range(n)) + 1) / (total + n + 2)
        return lambda v: [math.log((counts[c, k] + 5 * share(c)) / (sum(v2 for (_, j), v2 in counts.items() if j == k) + 5)) for c in [v if v in names or not v else "other"] for k in range(n)] + [math.log(share(v if v in names or not v else "other"))]

    tables = table(2), table(3)
    domain = lambda h: ".".join(h.split(".")[-2:])
    by_host, by_domain = Counter((r[1], r[6]) for r in rows if r[1]), Counter((domain(r[1]), r[6]) for r in rows if r[1])
    said = Counter(r[6] for r in rows)
    total = sum(said[k] for k in range(n))
    out = {}
    for page, host, markup, suffix, ll, size, best in rows:
        prior = [(said[k] + 1) / (total + n) for k in range(n)]
        less = lambda c, k: c - (best == k and host is not None)  # noqa: B023, E731
        for counts, name in ((by_domain, domain(host) if host else None), (by_host, host)):
            seen = [less(counts[name, k] if name else 0, k) for k in range(n)]
            prior = [(seen[k] + 5 * prior[k]) / (sum(seen) + 5) for k in range(n)]
        f = [math.log(p * (1 - 1e-6)) for p in prior] + [math.log(1e-6)]
        f = [sum(x) for x in zip(f, tables[0](markup), tables[1](suffix), ll, strict=True)]
        top = max(range(n + 1), key=lambda k: f[k])
        out[page] = ([*names, "und"][top], 1 / sum(math.exp(x - f[top]) for x in f), [*names, "und"][best]) if size else ("und", 1.0, "und")
    return out


def test_op4_is_the_formula(spark, sf_dir, docs):
    pages = pd.read_parquet(f"{sf_dir}/pages.parquet")
    want = plain_posteriors(docs, pages)
    got = queries.QUERIES["op4_language"](spark, sf_dir).toPandas()
    assert len(got) == len(pages)
    for page, lang, confidence, text_lang in got[["page_id", "lang", "confidence", "text_lang"]].itertuples(index=False):
        assert (lang, text_lang) == (want[page][0], want[page][2])
        assert confidence == pytest.approx(want[page][1], abs=2e-6)


def test_op4_by_text_alone(spark, docs):
    """Held out: trained on half of the documents, the text's language is that of the others' labels."""
    rows = spark.createDataFrame(docs[["doc_id", "text", "lang", "source"]])
    model = language.train(rows.where("doc_id % 2 = 0"))
    got = language.identify_documents(rows.where("doc_id % 2 = 1"), model).toPandas().set_index("id").text_lang
    label = docs.set_index("doc_id").lang[got.index]
    long = docs.set_index("doc_id").text[got.index].str.len() > 100
    assert (got == label)[long].mean() > 0.98


def plain_chunks(data):
    """Ends of chunks, a byte at a time."""
    ends, last, h = [], 0, 0
    for end, byte in enumerate(data, 1):
        h = (h * 2 + int(chunks.GEAR[byte])) % (1 << 32)
        if end - last > chunks.LONGEST:
            last += chunks.LONGEST
            ends.append(last)
        if h >> (32 - chunks.BITS) == 0 and end - last >= chunks.SHORTEST:
            last = end
            ends.append(end)
    return ends + [len(data)] * (last < len(data))


def plain_chunk_dedup(texts):
    """(n_bytes, n_removed, n_spans, digest) of each of texts, in order: the first of equal chunks stays, short runs of later ones too."""
    seen, out = set(), []
    for data in texts:
        ends = plain_chunks(data)
        later = []
        for a, b in zip([0, *ends[:-1]], ends, strict=bool(ends)):
            if data[a:b] in seen:
                if later and later[-1][1] == a:
                    later[-1][1] = b
                else:
                    later.append([a, b])
            seen.add(data[a:b])
        later = [r for r in later if r[1] - r[0] >= chunks.LEAST]
        kept = b"".join(data[a:b] for a, b in zip([0, *[r[1] for r in later]], [*[r[0] for r in later], len(data)], strict=True))
        out.append((len(data), len(data) - len(kept), len(later), hashlib.sha256(kept).hexdigest()))
    return out


def test_op7_byte_by_byte(spark, sf_dir, docs):
    got = queries.QUERIES["op7_gear"](spark, sf_dir).toPandas().sort_values("doc_id")
    want = plain_chunk_dedup([t.encode() for t in docs.text])
    assert [tuple(r) for r in got[["n_bytes", "n_removed", "n_spans", "kept_sha256"]].itertuples(index=False)] == want
    assert sum(w[2] > 0 for w in want) > 5


def test_chunk_rule_on_hard_texts(spark):
    rng = np.random.default_rng(8)
    base = rng.integers(97, 123, 3000).astype(np.uint8).tobytes().decode()
    texts = [base, "x" * 5000, base[:1500] + "!" + base[1500:], "", base[700:900] * 4, "x" * 700, "é" * 900, base[:40], base]
    got = chunks.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), False).toPandas().sort_values("doc_id")
    assert [tuple(r) for r in got[["n_bytes", "n_removed", "n_spans", "kept_sha256"]].itertuples(index=False)] == plain_chunk_dedup([t.encode() for t in texts])
    for t in texts:
        assert chunks.boundaries(t.encode()) == plain_chunks(t.encode())


def plain_markov(texts, held, own, states, rounds):
    """log10 probability of each text: Baum-Welch and forward recursion of one text after another, in double precision."""
    tokens = [t.encode().lower().split() for t in texts]
    counts = Counter(w.decode() for t, h in zip(tokens, held, strict=True) if not h for w in t)
    documents = sum(not h for h in held)
    top = sorted(counts, key=lambda w: (-counts[w], w))[:own]
    place = {w: i for i, w in enumerate(top)}
    of_class = lambda w: zlib.crc32(w[-3:].encode()) % hmm.CLASSES
    mass, kinds = np.zeros(hmm.CLASSES), np.zeros(hmm.CLASSES)
    for w, c in counts.items():
        if w not in place:
            mass[of_class(w)] += c
            kinds[of_class(w)] += 1
    symbols, extra = [], []
    for t in tokens:
        words = [w.decode() for w in t]
        symbols.append(np.array([place[w] if w in place else len(top) + of_class(w) for w in words] + [len(top) + hmm.CLASSES]))
        extra.append(sum(math.log10((counts[w] + 0.5) / (mass[of_class(w)] + 0.5 * (kinds[of_class(w)] + 1))) for w in words if w not in place))
    share = np.concatenate([[counts[w] for w in top], mass + 0.5, [documents + 0.5]])
    share /= share.sum()
    emit = share[:, None] * (np.random.default_rng(0).random((len(share), states)) + 0.5)
    emit /= emit.sum(axis=0)
    move = np.full((states, states), (1 - hmm.STAY) / (states - 1))
    np.fill_diagonal(move, hmm.STAY)
    start = np.full(states, 1 / states)

    def forward(x):
        a, scale = [], []
        for t, o in enumerate(x):
            now = (a[-1] @ move if t else start) * emit[o]
            scale.append(now.sum())
            a.append(now / scale[-1])
        return a, scale

    for _ in range(rounds):
        s, m, e = np.zeros(states), np.zeros((states, states)), np.zeros(emit.shape)
        for x, h in zip(symbols, held, strict=True):
            if h:
                continue
            a, scale = forward(x)
            b = np.ones(states)
            for t in range(len(x) - 1, -1, -1):
                e[x[t]] += a[t] * b
                if t:
                    m += np.outer(a[t - 1], emit[x[t]] * b) * move / scale[t]
                    b = move @ (emit[x[t]] * b) / scale[t]
                else:
                    s += a[0] * b
        start, move = (s + 1) / (s + 1).sum(), (m + 1) / (m + 1).sum(axis=1, keepdims=True)
        emit = (e + hmm.BACKING * share[:, None]) / (e.sum(axis=0) + hmm.BACKING)
    return [sum(map(math.log10, forward(x)[1])) + y for x, y in zip(symbols, extra, strict=True)]


@pytest.mark.parametrize("own", [hmm.OWN, 150])
def test_op6_scores_are_the_models(spark, sf_dir, docs, own, monkeypatch):
    monkeypatch.setattr(hmm, "OWN", own)
    monkeypatch.setattr(hmm, "NEAR", 2 * own)  # at 150, most words are in classes or joined
    rows = docs[docs.text.str.len() < 4000].reset_index(drop=True)
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in rows.doc_id]
    want = plain_markov(rows.text, held, own, hmm.STATES, 2)
    got = hmm.scores(spark.createDataFrame(rows[["doc_id", "text"]]), rounds=2).toPandas().set_index("doc_id").loc[rows.doc_id]
    assert got.held_out.tolist() == held
    np.testing.assert_allclose(got.score, want, rtol=2e-4)


def stage_input(spark, folder, rows, items):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    frame = spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in rows], kind)
    for clash in ("key", "fp", "node", "blob", "spans", "d", "k", "h", "w", "item_id", "component_id"):
        frame = frame.selectExpr("*", f"'x' as {clash}")
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id").write.parquet(f"{folder}/benchmark.parquet")


def test_pipeline_edges(spark, tmp_path):
    words = lambda k, n: " ".join(f"{a}{xxhash.xxh32_intdigest(f'{k} {i}') % 900}" for i, a in zip(range(n), "abcdefgh" * n, strict=False))
    item = words("item", 14)
    long = words("long", 20_000)
    rows = [(1, words(1, 60), "en", "a"), (2, words(1, 60), "en", None), (None, words(3, 40), "en", "a"), (None, None, None, None), (4, None, "en", "a"), (5, "", "en", "a"), (6, " \n", None, "a"),
            (7, f"{words(7, 30)} {item} {words(8, 30)}", "en", "a"), (8, f"{words(9, 30)} token = abcdef123456", "en", "a"), (9, long, "en", "b"), (10, long + " and more", "en", "b"), (11, words(11, 50), "en", "a"), (11, words(11, 50), "en", "a"), (11, words(12, 50), "en", "a")]
    stage_input(spark, str(tmp_path / "some"), rows, [(1, item), (2, None), (None, ""), (3, item)])
    got = corpus_pipeline.run(spark, str(tmp_path / "some")).toPandas()
    assert sorted(got.doc_id.dropna().astype(int)) == [1, 8, 9, 11, 11, 11] and got.doc_id.isna().sum() == 1
    assert (got.n_tokens > 0).all()


@pytest.mark.parametrize("items", [[], [(1, "one two three four five six seven eight nine ten")]])
def test_pipeline_of_nothing(spark, tmp_path, items):
    stage_input(spark, str(tmp_path / "none"), [], items)
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
