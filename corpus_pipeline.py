"""The corpus pipeline: toxicity, line dedup, near-duplicate join, repeated strings and packing, each over what the one before it kept.

A stage takes (spark, docs, sf_dir); its result is stored as Parquet before the next one begins.  Tables that a stage
keeps in the shared folder are deleted when the next stage begins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm import line_dedup, ngram_join, packing, suffix_dedup, toxicity
from talus.llm._base import drop_scratch, scratch_of, table, written


def _stage(f):
    def run(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_scratch(spark, "pipeline")
        with scratch_of("pipeline"):
            return f(spark, docs, sf_dir)

    return run


def _others(docs: DataFrame, *but: str) -> tuple[str, ...]:
    return tuple(c for c in docs.columns if c not in but)


def _with_text(docs: DataFrame, new: DataFrame, text: str, removed: str) -> DataFrame:
    """The columns of docs with the new text and its length; rows of which nothing but blanks is left go, if they lost something."""
    new = new.where((F.col(removed) == 0) | (F.trim(F.regexp_replace(text, "\\s+", " ")) != ""))
    values = {"text": F.col(text), "n_chars": F.length(text).cast("long")}
    return new.select(*[(values[c] if c in values else F.col(f"`{c}`")).alias(c) for c in docs.columns])


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go; all others stay as they are.  The model is fitted on what there is."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines go; a document that consists of nothing else goes with them."""
    return _with_text(docs, line_dedup.line_dedup(docs, carry=_others(docs, "doc_id", "text")), "text", "n_removed")


def drop_near_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the smallest doc_id stays.  Rows without a doc_id stay unless their group has one."""
    kept = ngram_join.ngram_join(docs).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")


def drop_repeats(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that a smaller doc_id has already go; a document that consists of nothing else goes with them."""
    return _with_text(docs, suffix_dedup.repeats(docs, carry=_others(docs, "doc_id", "text")), "rest", "n_removed")


def pack(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    import public_tokenizers as P

    return packing.pack(docs, P.path("byte_bpe_50k.json"), P.PATTERN, with_ids=False)


STAGES = [
    ("toxicity", _stage(drop_toxic)),
    ("line_dedup", _stage(drop_lines)),
    ("ngram_join", _stage(drop_near_copies)),
    ("suffix_dedup", _stage(drop_repeats)),
    ("packing", _stage(pack)),
]

ORACLE_SQL = None  # the classifier and the tokenizer are not SQL; tests/llm/test_pipeline.py has brute-force versions


def run(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name, scratch=False)
    return STAGES[-1][1](spark, docs, sf_dir)
