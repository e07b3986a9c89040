"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import crossentropy, decontaminate, fingerprint, language, lempelziv, media, minhash, mixing, repair, runs, suffixes, tokens, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_members": warc.op1_warc_members,
    "op2_pareto_mix": mixing.op2_pareto_mix,
    "op3_circulant_minhash": minhash.op3_circulant_minhash,
    "op4_cross_entropy": crossentropy.op4_cross_entropy,
    "op5_media_chunks": media.op5_media_chunks,
    "op6_relative_parse": lempelziv.op6_relative_parse,
    "op7_language_mixture": language.op7_language_mixture,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_token_frames": tokens.op9_token_frames,
    "op10_suffix_dedup": suffixes.op10_suffix_dedup,
    "op11_periodic_runs": runs.op11_periodic_runs,
    "op12_repair_conversations": repair.op12_repair_conversations,
    "op13_piecewise_fingerprints": fingerprint.op13_piecewise_fingerprints,
}

ORACLE_SQL: dict[str, str] = {"op2_pareto_mix": mixing.OP2_SQL, "op12_repair_conversations": repair.OP12_SQL}
