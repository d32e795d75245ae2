"""The corpus pipeline as a whole, over rows and columns that are hard on it."""

import tiktoken  # noqa: F401  the vocabulary's library must be there
from pyspark.sql import functions as F

import corpus_pipeline
from rastercube.llm import bpe, quality, similar

from .conftest import TRICKY, prose


def test_whole_run(spark, tmp_path, make):
    clean = [(100 + i, prose(60 + i, 300 + i) + " Mr John Doe, 12.84.156.107", "abc"[i % 3]) for i in range(12)]
    near = [(200 + i, clean[0][1] + f" x{i}", "a") for i in range(3)]
    docs = make([*TRICKY, *clean, *near]).withColumns({"__": F.lit(1), "row": F.lit("r"), "z": F.lit(None).cast("int"), "n": F.lit(2), "rest": F.lit(0)})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert rows and all(r.round_trip and len(r.ids) == r.n_tokens for r in rows)
    decode = bpe.codec(bpe.VOCABULARY).decode
    texts = {r.doc_id: decode(r.ids).decode() for r in rows}
    good = {r.doc_id for r in quality.apply_policy(quality.ledger(docs)).where("kept").collect()}
    assert set(texts) <= good and {101, 102, 103} <= set(texts) and len({100, 200, 201, 202} & set(texts)) == 1
    assert not any("John" in t or "Doe" in t or "12.84.156.107" in t for t in texts.values())
    assert similar.one_of_similar(docs.where("doc_id BETWEEN 100 AND 299")).count() == 12
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "SimHash near-dedup", "PII", "mixing sources to target weights", "byte-level BPE encoding and decoding"]


def test_empty_table(spark, tmp_path, make):
    make(TRICKY).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
