"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from tallyseal.llm import chat_format, collocations, jaccard_join, license_scan, lm_scoring, media, packing, pieces, pipeline, quality_rules, spelling, substring_dedup, token_files, topk


def queries() -> dict:
    return {
        "op1_pack": packing.op1_pack,
        "op2_substring_dedup": substring_dedup.op2_substring_dedup,
        "op3_license_scan": license_scan.op3_license_scan,
        "op4_media": media.op4_media,
        "op5_lm_scoring": lm_scoring.op5_lm_scoring,
        "op6_token_files": token_files.op6_token_files,
        "op7_jaccard_join": jaccard_join.op7_jaccard_join,
        "op8_quality_rules": quality_rules.op8_quality_rules,
        "op9_pieces": pieces.op9_pieces,
        "op10_topk": topk.op10_topk,
        "op11_collocations": collocations.op11_collocations,
        "op12_spelling": spelling.op12_spelling,
        "op13_chat_format": chat_format.op13_chat_format,
        "pipeline": pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_license_scan": license_scan.sql(), "op10_topk": topk.OP10_SQL, "op11_collocations": collocations.SQL, "op12_spelling": spelling.SQL, "op13_chat_format": chat_format.SQL}
