"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import attention_lm, compression_classifier, decontaminate, disclosure, html_extract, language_id, line_dedup, minhash, mixing, periodic_runs, quality_rules, repair_turns, warc

QUERIES = {
    "op1_decontaminate": decontaminate.op1,
    "op2_attention_lm": attention_lm.op2,
    "op3_html_extract": html_extract.op3,
    "op4_minhash": minhash.op4,
    "op5_mixing": mixing.op5,
    "op6_line_dedup": line_dedup.op6,
    "op7_warc": warc.op7,
    "op8_language_id": language_id.op8,
    "op9_quality_rules": quality_rules.op9,
    "op10_compression_classifier": compression_classifier.op10,
    "op11_disclosure": disclosure.op11,
    "op12_periodic_runs": periodic_runs.op12,
    "op13_repair_turns": repair_turns.op13,
}

ORACLES: dict[str, str] = {"op1_decontaminate": decontaminate.ORACLE, "op5_mixing": mixing.ORACLE, "op7_warc": warc.ORACLE, "op11_disclosure": disclosure.ORACLE}
