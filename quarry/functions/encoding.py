"""Decoding of bytes and repair of wrongly decoded text: GB 18030 is not among Spark's encodings, so these two are Pandas UDFs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quarry.functions import text as T
from quarry.runtime import reach_workers

_LATIN1, _CJK = re.compile("[À-ÿ]"), re.compile("[一-鿿]")


def decode_bytes(content: bytes) -> str:
    """UTF-8, else GB 18030, else UTF-8 with replacement characters."""
    for encoding in ("utf-8", "gb18030"):
        try:
            return content.decode(encoding)
        except UnicodeDecodeError:
            continue
    return content.decode("utf-8", "replace")


def _garbled(text: str) -> int:
    return 2 * text.count("�") + len(_LATIN1.findall(text))


def garbled(text: str) -> bool:
    """As text.looks_garbled, for one text."""
    score, cjk = _garbled(text), len(_CJK.findall(text))
    return score >= 20 and (not cjk or score > 2 * cjk)


def repair_text(text: str) -> str:
    """The reading of the text's Latin-1 bytes as UTF-8 or GB 18030 that is less garbled and has no less CJK, if there is one."""
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    for encoding in ("utf-8", "gb18030"):
        try:
            other = raw.decode(encoding)
        except UnicodeDecodeError:
            continue
        if _garbled(other) < _garbled(text) and len(_CJK.findall(other)) >= len(_CJK.findall(text)):
            return other
    return text


@F.pandas_udf(StringType())
def _decoded(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else decode_bytes(bytes(b)))


@F.pandas_udf(StringType())
def _repaired(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else repair_text(t))


def repair(text: Column) -> Column:
    """Mojibake repair; Python sees only texts that look garbled."""
    reach_workers(SparkSession.getActiveSession())
    return F.coalesce(_repaired(F.when(T.looks_garbled(text), text)), text)


def decode(content: Column) -> Column:
    """Text of a binary column, repaired; Python sees only what is not UTF-8."""
    reach_workers(SparkSession.getActiveSession())
    valid = F.is_valid_utf8(content.cast("string"))
    return repair(F.when(valid, content.cast("string")).otherwise(_decoded(F.when(~valid, content))))
