"""The registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

from . import audio, chat, decontaminate, jaccard, language_model, licenses, packing, secrets, toxicity, warc


def queries() -> dict:
    return {
        "op1_warc": warc.op1_warc,
        "op2_telephony_audio": audio.op2_telephony_audio,
        "op3_license_scan": licenses.op3_license_scan,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_lm_scoring": language_model.op5_lm_scoring,
        "op6_chat_linking": chat.op6_chat_linking,
        "op7_secret_scan": secrets.op7_secret_scan,
        "op8_jaccard_join": jaccard.op8_jaccard_join,
        "op9_packing": packing.op9_packing,
        "op10_decontamination": decontaminate.op10_decontamination,
    }


def oracle() -> dict[str, str]:
    return {"op1_warc": warc.ORACLE, "op3_license_scan": licenses.oracle(), "op6_chat_linking": chat.ORACLE, "op10_decontamination": decontaminate.ORACLE}
