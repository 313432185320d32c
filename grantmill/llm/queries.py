"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from grantmill.llm import bpe, html_text, katz, licenses, line_dedup, media, mixing, ngram_join, quality, urls


def queries() -> dict:
    return {
        "op1_ngram_join": ngram_join.op1,
        "op2_mixing": mixing.op2,
        "op3_byte_bpe": bpe.op3,
        "op4_media": media.op4,
        "op5_license_scan": licenses.op5,
        "op6_katz_lm": katz.op6,
        "op7_quality_rules": quality.op7,
        "op8_url_filter": urls.op8,
        "op9_html_extraction": html_text.op9,
        "op10_line_dedup": line_dedup.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": ngram_join.SQL, "op2_mixing": mixing.SQL, "op7_quality_rules": quality.SQL, "op10_line_dedup": line_dedup.SQL}
