"""The corpus pipeline stage by stage, and as a whole against a plain version."""

import re

import numpy as np

import corpus_pipeline
from specgraph.llm import langid, pii, queries, simhash, subword
from specgraph.llm.arrays import from_texts
from specgraph.llm.tokenizers import tokenizer_path


def test_stages_and_run(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    columns, kept = docs.columns, docs
    assert [s for s, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "personal_data", "encoding"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, tiny)
        assert kept.columns == columns
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = langid.train(docs)
    named, _, rates = model.predict(list(rows.values()))
    alive = [i for i, x, rate in zip(rows, named, rates, strict=True) if x != "und" and rate < 8]
    fps = np.array([simhash.simhash(rows[i]) for i in alive], dtype=np.uint64)
    ids = np.array(alive)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    labels = ids.copy()
    while not ((new := np.where(near, labels[None, :], 1 << 60).min(axis=1)) == labels).all():
        labels = new
    alive = [i for i, c in zip(alive, labels, strict=True) if i == c]
    flat = {i: f" {' '.join(re.findall(r'\w+', rows[i].lower()))} " for i in alive}
    items = [" ".join(re.findall(r"\w+", r["text"].lower())) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    alive = [i for i in alive if not any(f" {t} " in flat[i] for t in items)]
    want = {}
    merges = subword.model(tokenizer_path("piece_bpe_32k.model"))
    for i in alive:
        text = pii.masked(rows[i], pii.find_all(*from_texts([rows[i].encode()]), pii.default_field())[0][1])
        document = spark.sql(f"select xxhash64({i}L)").first()[0]
        want[i] = (len(text), merges.encode([text], np.array([document]))[0].tolist())
    got = {r["doc_id"]: (r["n_chars"], r["ids"]) for r in corpus_pipeline.run(spark, tiny).collect()}
    assert got == want


def test_stages_on_awkward_rows(spark, tiny):
    rows = [(1, "some words of a text that is long enough", "en", "s", 1), (1, "some words of a text that is long enough", "en", "s", 1), (None, "a text with no id at all", "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table, n in ((docs, 2), (docs.limit(0), 0)):
        for _, stage in corpus_pipeline.STAGES:
            table = stage(spark, table, tiny)
        assert table.count() == n


def test_every_query_is_named_by_its_number():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES) == list(range(1, 11))
