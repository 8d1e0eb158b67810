"""The subpackage's queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from . import exact_dedup, lattice_lm, licenses, line_crf, mixing, near_dedup, packing, repetition, sharding, token_orc

QUERIES = {
    "op1_line_crf": line_crf.op1_line_crf,
    "op2_token_orc": token_orc.op2_token_orc,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_lattice_lm": lattice_lm.op4_lattice_lm,
    "op5_sharding": sharding.op5_sharding,
    "op6_licenses": licenses.op6_licenses,
    "op7_packing": packing.op7_packing,
    "op8_near_dedup": near_dedup.op8_near_dedup,
    "op9_mixing": mixing.op9_mixing,
    "op10_repetition": repetition.op10_repetition,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL = {"op3_exact_dedup": exact_dedup.OP3_SQL, "op5_sharding": sharding.OP5_SQL, "op8_near_dedup": near_dedup.OP8_SQL, "op9_mixing": mixing.OP9_SQL}
