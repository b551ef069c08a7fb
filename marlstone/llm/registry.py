"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, decontaminate, licenses, lines, mixing, passages, resample, search, secrets, simhash, toxicity, vectors, warc

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_embedding_near_dedup": vectors.op3_embedding_near_dedup,
    "op4_substring_dedup": passages.op4_substring_dedup,
    "op5_warc_round_trip": warc.op5_warc_round_trip,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_simhash_near_dedup": simhash.op7_simhash_near_dedup,
    "op8_source_mix": mixing.op8_source_mix,
    "op9_benchmark_decontamination": decontaminate.op9_benchmark_decontamination,
    "op10_line_dedup": lines.op10_line_dedup,
    "op11_lexical_search": search.op11_lexical_search,
    "op12_importance_resampling": resample.op12_importance_resampling,
    "op13_bpe": bpe.op13_bpe,
}
SQL = secrets.SQL | licenses.SQL | vectors.SQL | passages.SQL | warc.SQL | mixing.SQL | decontaminate.SQL | lines.SQL | search.SQL | resample.SQL
