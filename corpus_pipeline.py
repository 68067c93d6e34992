"""The corpus pipeline: quality rules, exact dedup, near-duplicate join, mixing to target weights, BPE."""

from __future__ import annotations

from quillstone.llm import stages
from quillstone.llm.common import release, tables, written

#: (name, function) pairs; each function takes (spark, docs, sf_dir) and works on all its predecessor kept.
STAGES = [
    ("quality rules", stages.quality_rules),
    ("exact dedup", stages.exact_copies),
    ("n-gram jaccard join", stages.near_copies),
    ("source mixing", stages.source_mix),
    ("bpe round trip", stages.bpe_round_trip),
]

#: The BPE stage is beyond SQL; tests hold every stage against a plain version of it.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Applies the stages to documents. Each stage's output is written and its scratch tables are deleted before the next begins."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        mark = tables()
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{k}")
            release(spark, mark, keep=1)
    return docs.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
