"""The pipeline's stages, each against what its operator says of the stage's own input."""

import pandas as pd
import pytest

import corpus_pipeline
from tidemark.llm import bpe, decontaminate, language, secrets, simhash


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], sf_dir).write.parquet(str(folder / name))
        out.append(spark.read.parquet(str(folder / name)))
    return out


def test_columns(stages):
    for df in stages[1:-1]:
        assert df.columns == corpus_pipeline.COLUMNS


def test_language_keeps_clean_documents(stages):
    before, after = (set(d.toPandas().doc_id) for d in stages[:2])
    assert after <= before and len(after) >= 0.99 * len(before)
    found = language.identify_documents(stages[0], language.train(stages[0])).where("lang = 'und'").toPandas()
    assert before - after == set(found.id)


def test_one_document_of_each_group_stays(stages):
    found = simhash.near_duplicates(stages[1]).toPandas()
    assert set(stages[2].toPandas().doc_id) == set(found.component_id)


def test_contaminated_documents_go(spark, stages, sf_dir):
    found = decontaminate.contamination(stages[2], spark.read.parquet(f"{sf_dir}/benchmark.parquet")).toPandas()
    assert set(stages[3].toPandas().doc_id) == set(found[found.n_hit == 0].doc_id) != set(found.doc_id)


def test_secrets_are_masked_and_no_document_goes(stages):
    assert stages[4].count() == stages[3].count()
    assert secrets.scan(stages[4]).findings.count() == 0
    out = stages[4].toPandas()
    assert (out.n_chars == out.text.str.len()).all()


def test_ids_decode_to_the_texts(stages):
    texts = stages[4].toPandas().set_index("doc_id").text
    out = stages[5].toPandas().set_index("doc_id")
    codec = bpe.public_vocabulary().codec()
    assert set(out.index) == set(texts.index)
    for i in out.index:
        assert codec.decode(out.ids[i]).decode() == texts[i]


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    got = corpus_pipeline.run(spark, sf_dir).select("doc_id", "ids_sha256").toPandas()
    want = stages[5].select("doc_id", "ids_sha256").toPandas()
    pd.testing.assert_frame_equal(*(f.sort_values("doc_id", ignore_index=True) for f in (got, want)))
