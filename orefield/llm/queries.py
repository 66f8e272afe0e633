"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontamination, licenses, media, mixing, neardups, quality, secrets, sharding, substrings, warc
from .sql import ORACLE_SQL

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_substrings": substrings.op2_substrings,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_secrets": secrets.op4_secrets,
    "op5_warc": warc.op5_warc,
    "op6_media": media.op6_media,
    "op7_quality": quality.op7_quality,
    "op8_sharding": sharding.op8_sharding,
    "op9_neardups": neardups.op9_neardups,
    "op10_licenses": licenses.op10_licenses,
}
__all__ = ["ORACLE_SQL", "QUERIES"]
