"""A training corpus from `documents`, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of documents.

1. quality: documents that the quality classifier scores under 0.3 go.
2. exact: of texts that are equal but for A-Z case, the largest doc_id stays.
3. near: of each component of near copies, the smallest doc_id stays. Linked
   are texts whose five-word shingles have a Jaccard similarity of 0.8 or more,
   and texts whose SimHash fingerprints are within 3 bits.
4. substring: words in a repeat of 13 words or more go from all documents but
   the earliest that has it; a document that loses every word goes. One that
   loses some has its other words joined by one space, and n_chars anew.
5. pack: what is left, packed into bins of 2,048 tokens.

A null text counts as empty. Rows without a doc_id are kept apart from each
other by their row, never dropped for the lack of it. An empty table goes
through all stages as one; columns that documents have besides the usual ones
stay with their rows.

What a stage writes for itself goes when the next stage begins, so the shared
folder holds one stage's working tables at a time.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import functions as F

from blockcodec.llm.common import stage_scratch, table, write_table
from blockcodec.llm.exact_dedup import kept_rows
from blockcodec.llm.packing import pack_documents
from blockcodec.llm.quality import fit_quality, keep_quality, labelled_statistics
from blockcodec.llm.queries import tokenizer_file
from blockcodec.llm.shingles import SIMILARITY
from blockcodec.llm.simhash import one_of_each
from blockcodec.llm.substring_dedup import substring_dedup


def _stage(fn):
    @wraps(fn)
    def run_stage(spark, docs, sf_dir):
        with stage_scratch(spark):
            return fn(spark, docs, sf_dir)

    return run_stage


@_stage
def quality_stage(spark, docs, sf_dir):
    return keep_quality(docs, fit_quality(labelled_statistics(docs, table(spark, sf_dir, "labels"))))


@_stage
def exact_stage(spark, docs, sf_dir):
    return kept_rows(docs)


@_stage
def near_stage(spark, docs, sf_dir):
    return one_of_each(docs, similarity=SIMILARITY)


@_stage
def substring_stage(spark, docs, sf_dir):
    found = substring_dedup(docs, carry=True)
    left = found.where("n_removed = 0 or n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("row.text"))
    chars = F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast("long")).otherwise(F.col("row.n_chars"))
    changed = {"text": text, "n_chars": chars}
    return left.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


@_stage
def pack_stage(spark, docs, sf_dir):
    return pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("exact", exact_stage),
    ("near", near_stage),
    ("substring", substring_stage),
    ("pack", pack_stage),
]

#: SQL cannot express a fitted classifier, links of fingerprints or best-fit
#: bins; tests/llm/test_pipeline.py checks run() against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
