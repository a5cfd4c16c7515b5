"""The queries of the training-text operators by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from pagewright.llm import chunking, confusables, keyword_spam, leakage, mojibake, residue, tokenize


def queries() -> dict:
    return {
        "p2_found": confusables.p2_found,
        "p2_normalized": confusables.p2_normalized,
        "p3_found": residue.p3_found,
        "p3_kept": residue.p3_kept,
        "p5_found": mojibake.p5_found,
        "p5_restored": mojibake.p5_restored,
        "p6_found": chunking.p6_found,
        "p6_pieces": chunking.p6_pieces,
        "p8_ids": tokenize.p8_ids,
        "p9_found": leakage.p9_found,
        "p9_covered": leakage.p9_covered,
        "p9_report": leakage.p9_report,
        "p10_found": keyword_spam.p10_found,
    }


def oracle_sql() -> dict:
    return {"p6_found": "select page_id from pages where length(cleaned_html) > 8000", "p9_found": leakage.SQL}
