"""Queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from . import decontaminate, kdtree, licenses, mixing, pii, quality, shards, simhash, urlfilter, warc

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_shard": shards.op2_shard,
    "op3_licenses": licenses.op3_licenses,
    "op4_url_filter": urlfilter.op4_url_filter,
    "op5_topk": kdtree.op5_topk,
    "op6_warc": warc.op6_warc,
    "op7_mix": mixing.op7_mix,
    "op8_quality": quality.op8_quality,
    "op9_simhash": simhash.op9_simhash,
    "op10_pii": pii.op10_pii,
}

ORACLES = {
    "op1_decontaminate": decontaminate.ORACLE,
    "op5_topk": kdtree.ORACLE,
    "op6_warc": warc.ORACLE,
    "op7_mix": mixing.ORACLE,
}
