"""Languages that few of the labelled documents have."""

from tidemark.llm import language


def test_rare_labels_are_known(spark):
    texts = {"en": "the words of this text are english", "de": "die worte dieses textes sind deutsch", "fi": "tämän tekstin sanat ovat suomea"}
    rows = [(i, texts["fi" if i in (7, 1200) else "de" if i % 2 else "en"], "fi" if i in (7, 1200) else "de" if i % 2 else "en", "s") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = language.train(docs, sample=64)
    assert model.languages == ("de", "en", "fi")
    found = language.identify_documents(docs.where("lang = 'fi' or doc_id < 10"), model).toPandas().set_index("id").text_lang
    assert found[1200] == found[7] == "fi" and found[0] == "en"
