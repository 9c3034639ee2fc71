"""Queries of the operators on token ids: wavelet-matrix shards and two ways of packing."""

from tradewind.llm import best_fit, packing, wavelet
from tradewind.llm.registry import query, table
from tradewind.llm.tokens import tokenizer_path


@query("op2_token_shards")
def op2_token_shards(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    read = wavelet.token_shards(docs, tokenizer_path("byte_bpe_50k.json"), drops_space=False, end_id=2)
    return read.select("doc_id", "start", "n_tokens", "ids_crc32", "part", "shard")


@query("op7_packing")
def op7_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), drops_space=True, end_id=1)


@query("op12_best_fit")
def op12_best_fit(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return best_fit.pack_best_fit(docs, tokenizer_path("word_bpe_49k.json"), drops_space=True, end_id=0)
