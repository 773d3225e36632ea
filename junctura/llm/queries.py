"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, codebooks, licenses, mixing, phrases, quality, urls, warc
from .pieces import op8_sentencepiece
from .pii import op1_pii
from .simhash import op4_simhash
from .subwords import op12_quality
from .toxicity import op5_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_nearest": ann.op2_nearest,
    "op3_licenses": licenses.op3_licenses,
    "op4_simhash": op4_simhash,
    "op5_toxicity": op5_toxicity,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_url_filters": urls.op7_url_filters,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_mixing": mixing.op9_mixing,
    "op10_warc": warc.op10_warc,
    "op11_vector_codes": codebooks.op11_vector_codes,
    "op12_quality": op12_quality,
    "op13_phrases": phrases.op13_phrases,
}

SQL: dict[str, str] = {
    "op2_nearest": ann.SQL,
    "op6_quality_rules": quality.SQL,
    "op7_url_filters": urls.sql(),
    "op9_mixing": mixing.SQL,
    "op10_warc": warc.SQL,
    "op11_vector_codes": codebooks.sql(),
    "op13_phrases": phrases.SQL,
}
