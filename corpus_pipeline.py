"""The corpus pipeline: quality rules, near-dedup, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of
`documents`, with the stage's decisions applied. The last one returns the pieces of all documents
that are left, with their places in sequences.
"""

from __future__ import annotations

from lattica.llm import decontaminate, packing, pii, quality, shingles, simhash
from lattica.llm.common import table


def quality_rules(spark, docs, sf_dir):
    """Documents that the quality rules reject go."""
    return quality.filter_documents(docs)


def near_dedup(spark, docs, sf_dir):
    """One document of each group stays: the one with the smallest doc_id. Candidates are documents with near
    SimHash fingerprints of their sets of 5-word shingles; those whose sets have a Jaccard of at least 0.8 are linked."""
    return simhash.deduplicate(spark, docs, grouped=shingles.groups)


def decontamination(spark, docs, sf_dir):
    """Documents that hold a test item go."""
    return decontaminate.clean(spark, docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark, docs, sf_dir):
    """Spans of personal data are replaced by their kind."""
    return pii.redact(docs, pii.fit(docs))


def best_fit_packing(spark, docs, sf_dir):
    """Pieces of at most 4096 tokens and their places in sequences."""
    return packing.digest(spark, docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: SQL cannot express the fingerprints, the index or the tokenizer; tests hold the stages against
#: brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over `documents`, each written and reread as the next one's input."""
    from lattica.llm.common import discard, written

    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        past, docs = docs, written(spark, stage(spark, docs, sf_dir), name)
        discard(past)
    return STAGES[-1][1](spark, docs, sf_dir)
