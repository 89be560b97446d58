"""From raw documents to a mixed, deduplicated, tokenised corpus in stages.

Every stage is ``(name, function)``; the function takes (spark, docs, sf_dir) and returns a
frame that is written as Parquet in the shared folder and read again as the next one's docs.
"""

from sparselens.llm import cotrain, decontam, mixing, simhash, token_store
from sparselens.llm.common import staged, table


def quality(spark, docs, sf_dir):
    """Documents that the co-trained classifier rejects go."""
    return cotrain.keep_quality(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark, docs, sf_dir):
    """One document of each group of near copies stays."""
    return simhash.drop_near_duplicates(docs)


def decontamination(spark, docs, sf_dir):
    """Documents that hold a benchmark item go."""
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing_weights(spark, docs, sf_dir):
    """Documents are used as often as the target weights ask for."""
    return mixing.mix(docs, table(spark, sf_dir, "labels"))


def token_ids(spark, docs, sf_dir):
    """The token store's rows: doc_id, start, n_tokens, ids_crc32."""
    return token_store.store_tokens(docs)


STAGES = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mixing_weights),
    ("token ids", token_ids),
]

#: Tokenizer files, model fits and 64-bit hashes with a seed are beyond SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), "pipeline")
    return docs
