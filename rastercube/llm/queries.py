"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from . import bpe, bwt, html, media, mixing, pii, quality, rlz, secrets, simhash

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_pii_surrogates": pii.op2_pii_surrogates,
    "op3_byte_bpe": bpe.op3_byte_bpe,
    "op4_png_media": media.op4_png_media,
    "op5_main_text": html.op5_main_text,
    "op6_secret_scan": secrets.op6_secret_scan,
    "op7_lempel_ziv": rlz.op7_lempel_ziv,
    "op8_curriculum_mix": mixing.op8_curriculum_mix,
    "op9_bwt_repeats": bwt.op9_bwt_repeats,
    "op10_quality_ledger": quality.op10_quality_ledger,
}
ORACLE_SQL = {
    "op8_curriculum_mix": mixing.OP8_SQL,
    "op10_quality_ledger": quality.OP10_SQL,
}
