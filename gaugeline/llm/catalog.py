"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from gaugeline.llm import decontaminate, language, lm, mixing, neighbours, quality, secrets, simhash, urlfilter, warc

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_filter_urls": urlfilter.op2_filter_urls,
    "op3_quality": quality.op3_quality,
    "op4_language": language.op4_language,
    "op5_simhash": simhash.op5_simhash,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_warc": warc.op7_warc,
    "op8_scan_secrets": secrets.op8_scan_secrets,
    "op9_neighbours": neighbours.op9_neighbours,
    "op10_lm_score": lm.op10_lm_score,
}

SQL = {"op2_filter_urls": urlfilter.ORACLE, "op7_warc": warc.ORACLE}
