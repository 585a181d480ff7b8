"""The corpus pipeline: documents in, packed training sequences out.

Stages take (spark, docs, sf_dir) and work on all that the one before kept. The last returns a row per packed piece.
"""

from __future__ import annotations

import public_tokenizers

from tesserae.llm import exact_dedup, minhash, packing, quality, toxicity
from tesserae.runtime import table, written


def toxicity_stage(spark, docs, sf_dir):
    """Documents that score 0.5 or more go; the model learns from the labels beside the corpus."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def quality_stage(spark, docs, sf_dir):
    """Lines that fail the rules go, and documents that lose too much with them."""
    return quality.clean(docs)


def exact_stage(spark, docs, sf_dir):
    """Of equal texts the one with the least id stays."""
    return exact_dedup.drop_copies(docs)


def near_stage(spark, docs, sf_dir):
    """One document stays of each group linked by a similarity of 0.8 or more."""
    return minhash.drop_near_copies(docs)


def packing_stage(spark, docs, sf_dir):
    """Sequences of at most 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity_stage), ("quality rules", quality_stage), ("exact dedup", exact_stage), ("MinHash near-dedup", near_stage), ("best-fit packing", packing_stage)]

#: SQL can't express the network of the first stage or the plan of the last; tests/llm compare run() with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage; each stage's result is a table in the shared folder that the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
