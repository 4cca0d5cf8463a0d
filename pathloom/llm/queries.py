"""The ten operators over their whole tables, with production parameters, and SQL where SQL can express them."""

from __future__ import annotations

from . import decontam, embeddings, idfiles, lines, minhash, packing, pii, secrets, sharding, toxicity
from .common import read

QUERIES = {
    "op1_spherical_caps": lambda spark, d: embeddings.link_vectors(read(spark, d, "embeddings")),
    "op2_order_minhash": lambda spark, d: minhash.near_duplicates(read(spark, d, "documents")),
    "op3_line_windows": lambda spark, d: lines.dedup_lines(read(spark, d, "documents")),
    "op4_sum_of_squares": lambda spark, d: packing.pack_documents(read(spark, d, "documents")),
    "op5_secret_structure": lambda spark, d: secrets.find_secrets(read(spark, d, "documents")),
    "op6_jump_shards": lambda spark, d: sharding.shard_documents(read(spark, d, "documents")),
    "op7_bilstm_crf": lambda spark, d: pii.find_pii(read(spark, d, "documents")),
    "op8_elias_fano": lambda spark, d: idfiles.token_files(read(spark, d, "documents")),
    "op9_pigeonhole_myers": lambda spark, d: decontam.find_benchmark(read(spark, d, "documents"), read(spark, d, "benchmark")),
    "op10_lexicon_automata": lambda spark, d: toxicity.score_toxicity(read(spark, d, "documents"), read(spark, d, "labels")),
}

ORACLE_SQL = {"op3_line_windows": lines.ORACLE, "op6_jump_shards": sharding.ORACLE}
