"""Operators for training corpora, each with the query that applies it to its whole table."""
from secframe.llm import bytenet, decontaminate, hardneg, licenses, lines, neardup, pieces, quality, ranking, rans, suffixes, toxicity, warc

QUERIES = {
    "op1_range_coding": rans.op1_range_coding,
    "op2_line_dedup": lines.op2_line_dedup,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_sentencepiece": pieces.op4_sentencepiece,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_suffix_dedup": suffixes.op7_suffix_dedup,
    "op8_superminhash": neardup.op8_superminhash,
    "op9_warc": warc.op9_warc,
    "op10_benchmark_decontamination": decontaminate.op10_benchmark_decontamination,
    "op11_ranked_search": ranking.op11_ranked_search,
    "op12_hard_negatives": hardneg.op12_hard_negatives,
    "op13_quality_bytes": bytenet.op13_quality_bytes,
}
SQL = {
    "op6_quality_rules": quality.OP6_SQL,
    "op8_superminhash": neardup.OP8_SQL,
    "op10_benchmark_decontamination": decontaminate.OP10_SQL,
    "op11_ranked_search": ranking.OP11_SQL,
    "op12_hard_negatives": hardneg.OP12_SQL,
}
