"""The queries of the training-data operators and the SQL they are checked with."""

from __future__ import annotations

from twinplan.llm import bpe, exact, jaccard, langid, lines, packing, quality, recompress, suffixes, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_bpe": bpe.op2_bpe,
    "op3_suffix_dedup": suffixes.op3_suffix_dedup,
    "op4_packing": packing.op4_packing,
    "op5_recompression": recompress.op5_recompression,
    "op6_jaccard": jaccard.op6_jaccard,
    "op7_langid": langid.op7_langid,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_line_dedup": lines.op9_line_dedup,
    "op10_exact_dedup": exact.op10_exact_dedup,
}

ORACLES = {
    "op1_warc": warc.ORACLE_SQL,
    "op3_suffix_dedup": suffixes.ORACLE_SQL,
    "op5_recompression": recompress.ORACLE_SQL,
    "op6_jaccard": jaccard.ORACLE_SQL,
    "op9_line_dedup": lines.ORACLE_SQL,
    "op10_exact_dedup": exact.ORACLE_SQL,
}
