"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from corpusloom.llm import bpe_tree, centroids, exact_dedup, fill_middle, hamming_join, html_text, jaccard_join, licenses, packing, quality, secrets, topk, url_filter


def queries() -> dict:
    return {
        "op1_packing": packing.op1_packing,
        "op2_html_text": html_text.op2_html_text,
        "op3_licenses": licenses.op3_licenses,
        "op4_exact_dedup": exact_dedup.op4_exact_dedup,
        "op5_jaccard_join": jaccard_join.op5_jaccard_join,
        "op6_bpe": bpe_tree.op6_bpe,
        "op7_secrets": secrets.op7_secrets,
        "op8_quality": quality.op8_quality,
        "op9_top_k": topk.op9_top_k,
        "op10_url_filter": url_filter.op10_url_filter,
        "op11_hamming_join": hamming_join.op11_hamming_join,
        "op12_fill_in_middle": fill_middle.op12_fill_in_middle,
        "op13_centroids": centroids.op13_centroids,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_exact_dedup": exact_dedup.OP4_SQL,
        "op5_jaccard_join": jaccard_join.OP5_SQL,
        "op9_top_k": topk.OP9_SQL,
        "op10_url_filter": url_filter.OP10_SQL,
        "op11_hamming_join": hamming_join.OP11_SQL,
        "op12_fill_in_middle": fill_middle.OP12_SQL,
        "op13_centroids": centroids.OP13_SQL,
    }
