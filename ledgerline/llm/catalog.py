"""Queries of this subpackage and their SQL; the driver entry adds them if the subpackage can be imported."""

from __future__ import annotations

from collections.abc import Callable

from . import (balanced, decontaminate, htmltext, langid, merkle, neighbours, packing, periodic, sharding, simhash, substrings, tokencount,
               urlfilter)

QUERIES: dict[str, Callable] = {
    "op1_template_extraction": htmltext.op1_template_extraction,
    "op2_linear_grouping_packing": packing.op2_linear_grouping_packing,
    "op3_string_tiling_decontamination": decontaminate.op3_string_tiling_decontamination,
    "op4_boosted_url_filter": urlfilter.op4_boosted_url_filter,
    "op5_paragraph_minhash": substrings.op5_paragraph_minhash,
    "op6_pretoken_counts": tokencount.op6_pretoken_counts,
    "op7_virtual_slot_sharding": sharding.op7_virtual_slot_sharding,
    "op8_block_matrix_neighbours": neighbours.op8_block_matrix_neighbours,
    "op9_byte_gru_language": langid.op9_byte_gru_language,
    "op10_golay_simhash": simhash.op10_golay_simhash,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_cost_balanced_packing": balanced.op12_cost_balanced_packing,
    "op13_butterfly_manifest": merkle.op13_butterfly_manifest,
}

ORACLES: dict[str, str] = {
    "op8_block_matrix_neighbours": neighbours.ORACLE,
    "op13_butterfly_manifest": merkle.ORACLE,
}
