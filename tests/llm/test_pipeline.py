from __future__ import annotations

import re

import sentencepiece

import __spark_entry__
import corpus_pipeline
from keelstone.llm import catalog, contamination, privacy, toxicity
from keelstone.llm.batches import scratch_table
from tests.llm.data import documents, edge_texts, no_documents
from tests.llm.test_dedup import classes

SMALL = "/root/testdata/sf0.001"


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {m[0] for m in map(re.compile(r"op\d+").match, names) if m}
    assert "pipeline" in names


def test_pipeline_equals_brute_force(spark):
    docs = catalog.table(spark, SMALL, "documents")
    model = toxicity.fit(docs, catalog.table(spark, SMALL, "labels"))
    toxic = {r.doc_id for r in toxicity.score(docs, model).filter("predicted = 1").collect()}
    kept = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id not in toxic)
    kept = [row for row, found in zip(kept, classes([t for _, t in kept]), strict=True) if found[3]]
    items = [tuple(r) for r in catalog.table(spark, SMALL, "benchmark").select("item_id", "text").collect()]
    normals = [contamination.normal(t) for _, t in items]
    matcher = contamination.Matcher(items)
    clean = [(i, t) for i, t in kept if not matcher.find(t)]
    assert not [i for i, t in clean if any(n in contamination.normal(t) for n in normals)]
    names = privacy.Pseudonyms(catalog.DEMO_KEY.encode())
    library = sentencepiece.SentencePieceProcessor(model_file=catalog.vocabulary("piece_bpe_32k.model"))
    wanted = []
    for i, t in clean:
        ids = library.encode(names.replace(t)[0])
        wanted.append((i, len(ids), ids, library.decode(ids)))
    found = corpus_pipeline.run(spark, SMALL)
    assert sorted((r.doc_id, r.n_tokens, r.ids, r.decoded) for r in found.collect()) == wanted


def test_stages_take_awkward_tables(spark):
    for docs in (documents(spark, edge_texts(), repeat=True), no_documents(spark)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            assert docs.columns == columns
            docs = scratch_table(stage(spark, docs, SMALL), name)
        docs.collect()
