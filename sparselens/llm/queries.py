"""The registered queries of this subpackage and their SQL."""

from sparselens.llm import (cotrain, decontam, licenses, lm, mixing, pieces, pii, quality_rules, simhash, token_store, toxicity, trie,
                            whitening)
from sparselens.llm.common import table

QUERIES, SQL = {}, {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_benchmark_leaks(spark, sf_dir):
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register
def op2_token_store(spark, sf_dir):
    return token_store.store_tokens(table(spark, sf_dir, "documents"))


@register
def op3_simhash_near_duplicates(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@register
def op4_toxicity_chain(spark, sf_dir):
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register
def op5_adaptive_rules(spark, sf_dir):
    return quality_rules.quality_verdicts(table(spark, sf_dir, "documents"))


SQL["op5_adaptive_rules"] = quality_rules.oracle()


@register
def op6_quality_cotraining(spark, sf_dir):
    return cotrain.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register
def op7_personal_data(spark, sf_dir):
    return pii.personal_data_digest(table(spark, sf_dir, "documents"))


@register
def op8_license_scan(spark, sf_dir):
    return licenses.license_scan(table(spark, sf_dir, "documents"))


SQL["op8_license_scan"] = licenses.oracle()


@register
def op9_mixing_rates(spark, sf_dir):
    return mixing.mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register
def op10_gru_scores(spark, sf_dir):
    return lm.score_documents(table(spark, sf_dir, "documents"))


@register
def op11_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@register
def op12_pieces(spark, sf_dir):
    return pieces.token_digest(table(spark, sf_dir, "documents"))


@register
def op13_prefix_trie(spark, sf_dir):
    return trie.prefix_trie(trie.rebuilt_paths(table(spark, sf_dir, "conversations")))


SQL["op13_prefix_trie"] = trie.oracle()
