"""The four functions that Spark has no expression for, as Arrow-batched UDFs."""

from __future__ import annotations

import ast
import json
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def fuzzy_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks ratio of two names, lower case without outer blanks; null for a null."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x.lower().strip(), y.lower().strip()).ratio()
                      for x, y in zip(a, b)], dtype="float64")


def safe_fuzzy_match(a, b, least: float = 0.87):
    """Equal names, or for names of four letters and more a ratio of ``least``."""
    x, y = F.lower(F.trim(F.col(a))), F.lower(F.trim(F.col(b)))
    short = (F.length(F.trim(F.col(a))) < 4) | (F.length(F.trim(F.col(b))) < 4)
    return F.when(short, x == y).otherwise(fuzzy_ratio(F.col(a), F.col(b)) >= least)


@F.pandas_udf(T.StringType())
def embedding_key(text: pd.Series) -> pd.Series:
    """A text without accents, in lower case, blanks collapsed."""
    def fold(t: str | None) -> str | None:
        if t is None:
            return None
        parts = unicodedata.normalize("NFKD", t)
        return " ".join("".join(c for c in parts if not unicodedata.combining(c)).lower().split())

    return text.map(fold, na_action="ignore")


@F.pandas_udf(T.StringType())
def domain_name(raw: pd.Series) -> pd.Series:
    """A domain in title case, blanks collapsed."""
    return raw.map(lambda t: " ".join(t.split()).title(), na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def batch_results(raw: pd.Series, n: pd.Series) -> pd.Series:
    """The ``n`` results of a batch answer, as JSON: a list, an object with ``results``, or one object; padded or cut to ``n``."""
    def shape(text: str | None, want: int) -> list[str]:
        try:
            body = json.loads(text[text.index("{") if "{" in text else 0: text.rindex("}") + 1] if not text.lstrip().startswith("[") else text)
        except (ValueError, AttributeError, TypeError):
            body = None
        if isinstance(body, dict) and isinstance(body.get("results"), list):
            body = body["results"]
        elif isinstance(body, dict):
            body = [body]
        items = [x if isinstance(x, dict) else {} for x in body] if isinstance(body, list) else []
        items += [{}] * (int(want) - len(items))
        return [json.dumps(x, sort_keys=True) for x in items[: int(want)]]

    return pd.Series([shape(t, w) for t, w in zip(raw, n)])


@F.pandas_udf(T.StringType())
def safe_description(stored: pd.Series) -> pd.Series:
    """The description in properties stored as a literal mapping; empty where there is none or the text cannot be read."""
    def one(text: str | None) -> str:
        try:
            held = ast.literal_eval(text) if text else None
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            return ""
        return str(held.get("description") or "") if isinstance(held, dict) else ""

    return stored.map(one)
