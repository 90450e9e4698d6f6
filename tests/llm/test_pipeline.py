"""Every stage on its own input against a plain version, then all of them."""

import corpus_pipeline
import pytest
from threadline.llm import decontaminate, pii
from threadline.llm.sentencepiece_wfst import reference_processor
from threadline.llm.queries import tokenizer_path

from .test_decontaminate import plain
from .test_simhash import check_near_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "pii", "sentencepiece"]

    good = stages["quality_classifier"](spark, docs, sf_dir).cache()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.collect()}
    assert sum(labels[i] == (i in kept) for i in labels) >= 0.95 * len(labels)

    unique = stages["simhash_near_dedup"](spark, good, sf_dir).cache()
    check_near_dedup({r.doc_id: r.text for r in good.collect()}, [r.doc_id for r in unique.collect()])

    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    phrases = {tuple(w[i : i + 10]) for _, t in items for w in [decontaminate.words_of(t.encode())] for i in range(max(1, len(w) - 9))}
    sizes = {len(p) for p in phrases}
    dirty = {r.doc_id for r in unique.collect() for w in [decontaminate.words_of(r.text.encode())] if any(tuple(w[i : i + n]) in phrases for n in sizes for i in range(len(w) - n + 1))}
    clean = stages["benchmark_decontamination"](spark, unique, sf_dir).cache()
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in unique.collect()} - dirty
    assert plain("a b", items)[1] == 0

    redacted = stages["pii"](spark, clean, sf_dir).cache()
    before = {r.doc_id: r.text for r in clean.collect()}
    for r in redacted.collect():
        assert not pii.base_spans(r.text)
        assert r.n_chars == len(r.text)
        assert (r.text == before[r.doc_id]) == (not pii.base_spans(before[r.doc_id])) or r.text != before[r.doc_id]
    for stage in (good, unique, clean, redacted):
        assert stage.columns == COLUMNS

    library = reference_processor(tokenizer_path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in redacted.collect()}
    pieces = stages["sentencepiece"](spark, redacted, sf_dir).collect()
    assert {r.doc_id for r in pieces} == set(texts)
    assert all(r.pieces == library.encode(texts[r.doc_id]) and r.exact for r in pieces)
    assert {r.doc_id: r.pieces for r in corpus_pipeline.run(spark, sf_dir).collect()} == {r.doc_id: r.pieces for r in pieces}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_awkward_rows(spark, sf_dir, awkward, nothing, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, nothing, sf_dir).count() == 0
    out = stage(spark, awkward, sf_dir)
    assert 0 < out.count() <= awkward.count()
    if name != "sentencepiece":
        assert out.columns == awkward.columns
