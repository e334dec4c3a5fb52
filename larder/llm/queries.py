"""One registered query per operator, over its whole table, and its SQL twin where SQL can state it."""

from __future__ import annotations

from larder.llm import attention_lm, bpe, divergence, embeddings, language_id, ngram_join, packing, spelling, suffix_dedup, token_files, topk_search, toxicity, url_filters
from larder.llm.common import table

LLM_QUERIES: dict[str, callable] = {}
LLM_ORACLES: dict[str, str] = {}


def query(name, sql=None):
    def register(function):
        LLM_QUERIES[name] = function
        if sql:
            LLM_ORACLES[name] = sql
        return function

    return register


@query("op5_token_files")
def op5(spark, sf_dir):
    return token_files.token_file_digests(table(spark, sf_dir, "documents"))


@query("op6_packing")
def op6(spark, sf_dir):
    return packing.piece_digests(packing.pack(table(spark, sf_dir, "documents")))


@query("op1_bpe_round_trip")
def op1(spark, sf_dir):
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"))


@query("op3_ngram_jaccard_join")
def op3(spark, sf_dir):
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


@query("op9_embedding_near_dedup")
def op9(spark, sf_dir):
    return embeddings.similar_vectors(table(spark, sf_dir, "embeddings"))


@query("op10_url_filters", url_filters.ORACLE)
def op10(spark, sf_dir):
    return url_filters.judge(table(spark, sf_dir, "pages"), url_filters.rule_frame(spark))


@query("op7_suffix_dedup")
def op7(spark, sf_dir):
    return suffix_dedup.removal_digests(table(spark, sf_dir, "documents"))


@query("op2_language_id")
def op2(spark, sf_dir):
    return language_id.predictions(table(spark, sf_dir, "documents"))


@query("op8_toxicity")
def op8(spark, sf_dir):
    return toxicity.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_topk_search", topk_search.ORACLE)
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return topk_search.search(docs, docs.where("doc_id % 20 = 0"))


@query("op12_source_divergence", divergence.ORACLE)
def op12(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


@query("op11_spelling_variants", spelling.ORACLE)
def op11(spark, sf_dir):
    return spelling.variant_groups(table(spark, sf_dir, "documents"))


@query("op13_lm_scoring")
def op13(spark, sf_dir):
    return attention_lm.text_scores(table(spark, sf_dir, "documents"))
