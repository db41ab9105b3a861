"""The few functions the JVM has no built-in for, as Arrow-batched UDFs."""

from __future__ import annotations

import html
import re
import unicodedata
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

from postmill.functions import fixed

_YEARS = re.compile(fixed.YEARS, re.I)
_BOAST = re.compile(fixed.FIRM_BOAST, re.I)


def clean_one(text: str | None, limit: int | None = None) -> str:
    """Tags out, entities resolved, NFKC, zero-width characters out, white space squeezed, cut at the limit."""
    t = html.unescape(re.sub(r"<[^>]+>", " ", text or ""))
    t = unicodedata.normalize("NFKC", t)
    t = re.sub("[​-‍⁠﻿]", "", t).replace(" ", " ")
    t = re.sub(r"\s+", " ", t).strip()
    return t[:limit] if limit else t


def years_of(text: str | None) -> int | None:
    """The least number of years that any demand for experience states, firms' boasts aside; at most 25."""
    found = [int(m[1]) for m in _YEARS.finditer(text or "") if not _BOAST.search((text or "")[max(0, m.start() - 60):m.start()])]
    return min((y for y in found if y <= 25), default=None)


def deaccent_one(text: str | None) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c))


# Arrow, not pandas: of a batch of texts only one at a time is a Python string. Plans over whole texts narrow the batches too.


@F.arrow_udf(StringType())
def clean_text(texts: pa.Array) -> pa.Array:
    return pa.array((clean_one(x.as_py()) for x in texts), pa.string(), size=len(texts))


@F.arrow_udf(IntegerType())
def _years(texts: pa.Array) -> pa.Array:
    return pa.array((years_of(x.as_py()) for x in texts), pa.int32(), size=len(texts))


def years_required(text: Column | str) -> Column:
    """``years_of`` of a text column. Only texts that speak of years leave the JVM."""
    text = F.col(text) if isinstance(text, str) else text
    return _years(F.when(F.rlike(text, F.lit("(?i)year")), text))


@F.arrow_udf(StringType())
def deaccent(texts: pa.Array) -> pa.Array:
    return pa.array((deaccent_one(x.as_py()) for x in texts), pa.string(), size=len(texts))


@F.pandas_udf(StringType())
def url_join(base: pd.Series, link: pd.Series) -> pd.Series:
    """RFC 3986 resolution, for links whose shape ``web.absolute`` leaves alone."""
    return pd.Series([urljoin(b or "", link_ or "") for b, link_ in zip(base, link)])
