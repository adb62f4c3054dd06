"""Queries opN_<name> over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foldlake.llm import bwt, decontaminate, itq, langid, maxent, minhash, mixing, oracles, secrets, urlfilter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": warc.op1,
    "op2_maxent": maxent.op2,
    "op3_minhash": minhash.op3,
    "op4_language_id": langid.op4,
    "op5_bwt": bwt.op5,
    "op6_itq": itq.op6,
    "op7_secret_scan": secrets.op7,
    "op8_url_filter": urlfilter.op8,
    "op9_decontaminate": decontaminate.op9,
    "op10_mixing": mixing.op10,
}

ORACLES: dict[str, str] = {
    "op1_warc": warc.ORACLE,
    "op3_minhash": oracles.OP3,
    "op5_bwt": oracles.OP5,
    "op6_itq": oracles.OP6,
    "op7_secret_scan": secrets.ORACLE,
    "op8_url_filter": urlfilter.ORACLE,
    "op9_decontaminate": oracles.OP9,
}
