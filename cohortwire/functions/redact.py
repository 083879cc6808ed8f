"""Redaction of sensitive keys at any depth of a JSON payload, in Arrow batches."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scalars import ALLOWED_KEYS, REDACTED, SENSITIVE


def redact_json(df: DataFrame, col: str = "data", patterns=SENSITIVE, allowed=ALLOWED_KEYS) -> DataFrame:
    """Replaces the values of sensitive keys, nested objects, arrays and JSON inside strings included.

    NULL and text that isn't JSON become NULL, so nothing unread gets through.
    """
    hit = re.compile("|".join(patterns))

    def clean(value, key=""):
        if key and hit.search(key) and key not in allowed:
            return REDACTED
        if isinstance(value, dict):
            return {k: clean(v, k.lower()) for k, v in value.items()}
        if isinstance(value, list):
            return [clean(v) for v in value]
        if isinstance(value, str) and value[:1] in ("{", "["):
            try:
                return json.dumps(clean(json.loads(value)), ensure_ascii=False)
            except ValueError:
                return value
        return value

    def one(text):
        try:
            return json.dumps(clean(json.loads(text)), ensure_ascii=False)
        except (TypeError, ValueError):
            return None

    @F.pandas_udf("string")
    def redacted(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return df.withColumn(col, redacted(col))
