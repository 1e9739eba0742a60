"""The pipeline's stage goes by fingerprints as well as by sets."""

from plain_versions import components
from tidemark.llm import simhash


def test_fingerprints_link_what_sets_do_not(spark):
    """Texts of mostly one repeated line: their sets of shingles differ, their fingerprints hardly do."""
    line = "five words make one line " * 200
    texts = [line + " ".join(f"{k}x{i}" for i in range(9)) for k in "abc"] + ["a text that has nothing to do with the lines above"]
    prints = [simhash.fingerprint(t.encode(), 5) for t in texts]
    sets = [{" ".join(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    assert all(5 * len(sets[0] & s) < 4 * len(sets[0] | s) for s in sets[1:])
    top = components(prints, lambda x, y: (x ^ y).bit_count() <= simhash.DISTANCE)
    assert list(top) == [0, 0, 0, 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == [0, 3]
