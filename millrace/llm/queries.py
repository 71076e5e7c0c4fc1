"""The queries of this package, for the driver's entry file."""

from __future__ import annotations

from millrace.llm.hamming import OP7_SQL, op7_multi_index_search
from millrace.llm.langid import op2_language_crf
from millrace.llm.merkle import OP1_SQL, op1_merkle_fingerprints
from millrace.llm.minhash import OP5_SQL, op5_minhash_groups
from millrace.llm.mixing import OP9_SQL, op9_mix_sources
from millrace.llm.packing import op10_pack_grouping
from millrace.llm.pseudo_lm import op6_pseudo_likelihood
from millrace.llm.ranked import OP12_SQL, op12_rank_documents
from millrace.llm.sharding import OP8_SQL, op8_shard_slots
from millrace.llm.simhash import op13_simhash_groups
from millrace.llm.suffixes import OP3_SQL, op3_suffix_repeats
from millrace.llm.toxicity import op4_toxicity_fm
from millrace.llm.whitening import op11_whiten_embeddings

QUERIES = {
    "op1_merkle_fingerprints": op1_merkle_fingerprints,
    "op2_language_crf": op2_language_crf,
    "op3_suffix_repeats": op3_suffix_repeats,
    "op4_toxicity_fm": op4_toxicity_fm,
    "op5_minhash_groups": op5_minhash_groups,
    "op6_pseudo_likelihood": op6_pseudo_likelihood,
    "op7_multi_index_search": op7_multi_index_search,
    "op8_shard_slots": op8_shard_slots,
    "op9_mix_sources": op9_mix_sources,
    "op10_pack_grouping": op10_pack_grouping,
    "op11_whiten_embeddings": op11_whiten_embeddings,
    "op12_rank_documents": op12_rank_documents,
    "op13_simhash_groups": op13_simhash_groups,
}

ORACLES = {
    "op1_merkle_fingerprints": OP1_SQL,
    "op3_suffix_repeats": OP3_SQL,
    "op5_minhash_groups": OP5_SQL,
    "op7_multi_index_search": OP7_SQL,
    "op8_shard_slots": OP8_SQL,
    "op9_mix_sources": OP9_SQL,
    "op12_rank_documents": OP12_SQL,
}
