"""The queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import htmltext, linededup, lmscore, media, mixing, neardup, packing, quality, toxicity, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_host_rules": quality.op2_host_rules,
    "op3_log_bilinear": lmscore.op3_log_bilinear,
    "op4_iso_media": media.op4_iso_media,
    "op5_line_dedup": linededup.op5_line_dedup,
    "op6_compression_toxicity": toxicity.op6_compression_toxicity,
    "op7_html_lstm": htmltext.op7_html_lstm,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_minhash_near_dedup": neardup.op10_minhash_near_dedup,
}
SQL = {
    "op1_warc": warc.SQL,
    "op2_host_rules": quality.SQL,
    "op5_line_dedup": linededup.SQL,
    "op8_mix_sources": mixing.SQL,
    "op10_minhash_near_dedup": neardup.SQL,
}
