"""Registered queries of this subpackage: name -> callable, and their SQL where it exists."""

from __future__ import annotations

from . import bpe, chat_format, embedding_dedup, packing, quality_classifier, quality_rules, secret_scans, sharding, simhash, warc
from .oracles import ORACLES

QUERIES = {
    "op1_quality_rules": quality_rules.op1,
    "op2_chat_format": chat_format.op2,
    "op3_quality_classifier": quality_classifier.op3,
    "op4_embedding_dedup": embedding_dedup.op4,
    "op5_packing": packing.op5,
    "op6_secret_scans": secret_scans.op6,
    "op7_simhash": simhash.op7,
    "op8_sharding": sharding.op8,
    "op9_warc": warc.op9,
    "op10_byte_bpe": bpe.op10,
}

ORACLE_SQL = {k: v for k, v in ORACLES.items() if k in QUERIES}
