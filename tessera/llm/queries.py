"""The queries opN_<name> of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from . import ann, binary, decontaminate, langid, pieces, pii, resample, secrets, shards, simhash

QUERIES = {f.__name__: f for f in (secrets.op1_secret_scans, decontaminate.op2_benchmark_decontamination, ann.op3_additive_quantisation, resample.op4_importance_resampling, simhash.op5_simhash_near_dedup, pii.op6_weak_supervision_pii, binary.op7_token_id_output, pieces.op8_sentencepiece_sampling, shards.op9_sharding, langid.op10_language_id)}
ORACLES: dict[str, str] = {"op2_benchmark_decontamination": decontaminate.OP2_SQL}
