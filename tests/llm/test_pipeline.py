from __future__ import annotations

import sentencepiece
import duckdb
from odd import ODD, SF

import corpus_pipeline
from frostline.llm import decontamination, line_dedup, quality_rules, simhash
from frostline.llm.queries import TOKENIZERS


def test_run_is_its_stages(spark, rows):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = quality_rules.keep_good(docs)
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in quality_rules.verdicts(docs).where("kept").collect()}
    lines = {r["doc_id"]: {int(x) for x in r["removed"].split(",") if x} for r in line_dedup.report(kept).collect()}
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    texts = {k: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in lines[k]) for k, t in texts.items()}
    left = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    least = {r["component_id"] for r in simhash.components(left).collect()}
    texts = {k: t for k, t in texts.items() if k in least}
    plain = lambda t: f" {' '.join(decontamination.words_of(t))} "
    items = [plain(t) for _, t in duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall() if len(decontamination.words_of(t)) >= 8]
    leaked = {k for k, t in texts.items() if any(x in plain(t) for x in items)}
    theirs = sentencepiece.SentencePieceProcessor(model_file=f"{TOKENIZERS}/piece_bpe_32k.model")
    got = {r["doc_id"]: r["input_ids"] for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {k: theirs.encode(t) for k, t in texts.items() if k not in leaked}


def test_stages_keep_columns_on_odd_rows(spark, frame):
    for pairs in (ODD, []):
        docs = frame(pairs)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns and out.count() <= len(pairs)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(pairs)
