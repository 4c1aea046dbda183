"""The registered queries of this package and their SQL."""

from __future__ import annotations

from . import chat, fingerprint, jaccard, language, license, linededup, media, mixing, packing, tokenfiles


def queries() -> dict:
    found = (
        license.op1_license_scan,
        packing.op2_best_fit_packing,
        language.op3_language_id,
        tokenfiles.op4_token_files,
        jaccard.op5_ngram_jaccard_join,
        fingerprint.op6_document_fingerprints,
        linededup.op7_line_dedup,
        media.op8_media_columns,
        chat.op9_chat_formatting,
        mixing.op10_mix_sources,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": license.ORACLE_SQL,
        "op7_line_dedup": linededup.ORACLE_SQL,
        "op9_chat_formatting": chat.ORACLE_SQL,
        "op10_mix_sources": mixing.ORACLE_SQL,
    }
