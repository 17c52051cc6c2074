"""Interfaces to models, with deterministic offline stand-ins, and the retrying that goes around them.

Providers are called per Arrow batch on executors (``mapInArrow``, pandas UDFs) or once on the driver; the stand-ins are pure functions of
their input, so that every test and rerun gives the same.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.exprs import DAILY_LIMITS, DAILY_WORDS, NETWORK_WORDS, RATE_WORDS


class QuotaExhausted(RuntimeError):
    """A daily limit is used up: no retry helps."""


def hashed_vector(text: str, dimension: int = 64) -> list[float]:
    """A unit vector of a text from its character trigrams: texts that share them are alike."""
    v = np.zeros(dimension)
    padded = f"  {text.lower()} "
    for i in range(len(padded) - 2):
        h = int.from_bytes(hashlib.blake2b(padded[i:i + 3].encode(), digest_size=8).digest(), "little")
        v[h % dimension] += 1.0 if h >> 63 else -1.0
    norm = np.linalg.norm(v)
    return (v / norm if norm else v).round(6).tolist()


def encoder(dimension: int = 64) -> Callable[[Column], Column]:
    """The stand-in encoder as a column function."""
    @F.pandas_udf("array<double>")
    def encode(text: pd.Series) -> pd.Series:
        return text.map(lambda t: hashed_vector(t or "", dimension))

    return encode


def encode_distinct(rows: DataFrame, text: str, encode: Callable[[Column], Column]) -> DataFrame:
    """Adds ``embedding``; each distinct text is encoded once and joined back."""
    once = rows.select(text).where(F.col(text).isNotNull()).distinct().withColumn("embedding", encode(F.col(text)))
    return rows.join(once, text, "left")


def extract(chunk: str) -> dict[str, list]:
    """The stand-in extractor: capitalised word pairs are entities, neighbours are related, sentences with a number are claims."""
    names = list(dict.fromkeys(re.findall(r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)+", chunk or "")))
    claims = [s.strip() for s in re.split(r"(?<=[.!?])\s+", chunk or "") if re.search(r"\d", s)]
    return {"entities": [{"name": n, "type": "CONCEPT"} for n in names],
            "relationships": [{"from": a, "to": b, "relation": "RELATED_TO"} for a, b in zip(names, names[1:])], "claims": claims}


def mentions(question: str, context: str = "") -> list[str]:
    """The stand-in mention extractor: capitalised words and quoted parts; the context of earlier questions is for real ones."""
    found = re.findall(r"\"([^\"]+)\"|((?:[A-Z][\w-]*)(?: [A-Z][\w-]*)*)", question or "")
    return [a or b for a, b in found if (a or b).lower() not in {"what", "who", "why", "how", "when", "where", "does", "is", "the", "which"}]


def answer(question: str, context: str) -> str:
    """The stand-in answerer: the first lines of the context that share a long word with the question, else its first line."""
    words = {w for w in re.findall(r"\w{5,}", question.lower())}
    lines = [x for x in context.split("\n") if x]
    hits = [x for x in lines if words & set(re.findall(r"\w{5,}", x.lower()))]
    return "\n".join((hits or lines)[:3])


def classify_relations(unknown: DataFrame, types: list[str]) -> DataFrame:
    """The stand-in relation classifier: of ``key`` the longest known type that stands in it, at 0.6; ``canonical`` is null where none does."""
    out = F.lit(None).cast("string")
    for t in sorted(types, key=lambda t: (len(t), t), reverse=False):
        out = F.when(F.contains(F.col("key"), F.lit(t)), t).otherwise(out)
    return unknown.withColumn("canonical", out).withColumn("confidence", F.lit(0.6))


def propose_types(friction: DataFrame) -> DataFrame:
    """The stand-in proposal for patterns that await review: the pattern itself as a new semantic type."""
    waits = friction.where("status = 'pending_review'")
    return waits.select("key", F.upper(F.regexp_replace("key", r"[^a-zA-Z0-9]+", "_")).alias("suggested_canonical"), F.lit("SEMANTIC").alias("suggested_category"),
                        F.lit(0.5).alias("suggestion_confidence"))


def infer_parent(name: str, known: list[str]) -> str | None:
    """The stand-in for placing a domain: the known domain, of the first thirty, with which it shares a long word."""
    words = set(re.findall(r"\w{4,}", name.lower()))
    return next((k for k in known[:30] if words & set(re.findall(r"\w{4,}", k.lower()))), None)


def referee(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The stand-in referee: adds ``accepted`` and ``score`` by edit distance relative to length; accepts over 0.8."""
    score = 1 - F.levenshtein(F.lower(a), F.lower(b)) / F.greatest(F.length(a), F.length(b))
    return pairs.withColumn("score", score).withColumn("accepted", score > 0.8)


def judge(conflicts: DataFrame) -> DataFrame:
    """The stand-in judge: differing numbers go to the newer source, an empty side to the other, else both are kept."""
    from .functions.exprs import numeric_conflict

    verdict = (F.when(F.col("new_description") == "", "KEEP_DOC1").when(F.col("old_description") == "", "KEEP_DOC2")
               .when(numeric_conflict("old_description", "new_description"), "KEEP_DOC2").otherwise("KEEP_BOTH"))
    return conflicts.withColumn("verdict", verdict)


def classify_domain(title: Column, sample: Column, names: list[str]) -> Column:
    """The stand-in classifier: the first known domain named in the title or the sample, else General."""
    out = F.lit("General")
    for n in reversed(names):
        out = F.when(F.contains(F.lower(F.concat_ws(" ", title, sample)), F.lit(n.lower())), n).otherwise(out)
    return out


@dataclass
class Retry:
    """Calls a provider again after errors that may pass; a used-up daily limit is raised at once."""

    attempts: int = 5
    base: float = 2.0
    sleep: Callable[[float], None] = time.sleep

    @staticmethod
    def kind(error: str) -> str:
        e = error.lower()
        if "exhausted" in e and "daily" in e or any(w in e for w in DAILY_WORDS) or ("per day" in e and any(w in e for w in DAILY_LIMITS)):
            return "daily_quota"
        return "rate_limit" if any(w in e for w in RATE_WORDS) else "network" if any(w in e for w in NETWORK_WORDS) else "unknown"

    def __call__(self, call: Callable, *args):
        for attempt in range(self.attempts):
            try:
                return call(*args)
            except QuotaExhausted:
                raise
            except Exception as e:
                kind = self.kind(str(e))
                if kind == "daily_quota":
                    raise QuotaExhausted(str(e)) from e
                if attempt == self.attempts - 1:
                    raise
                self.sleep(self.base * 2**attempt if kind == "rate_limit" else self.base * (attempt + 1) if kind == "network" else self.base)
        return None
