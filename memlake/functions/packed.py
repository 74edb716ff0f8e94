"""Payloads that no built-in expression reads: Arrow functions, batch by batch."""

from __future__ import annotations

import base64
import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from memlake.session import ship


def _unpacked(s: str | None) -> list[float] | None:
    return None if s is None else np.frombuffer(base64.b64decode(s), "<f4").tolist()


def _packed(v: list[float] | None) -> str | None:
    return None if v is None else base64.b64encode(np.asarray(v, "<f4").tobytes()).decode()


def _first_object(raw: str | None) -> str | None:
    read, at = json.JSONDecoder().raw_decode, -1
    while raw and (at := raw.find("{", at + 1)) >= 0:
        try:
            return json.dumps(read(raw, at)[0], ensure_ascii=False)
        except ValueError:
            continue
    return None


def _shared_length(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            row[j], before = (before + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


def _ratio(a: str, b: str) -> float:
    return 200.0 * _shared_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_set_score(a: str | None, b: str | None) -> float:
    """0 to 100: likeness of two names by their words, whatever the order and repeats; 100 if one's words are among the other's."""
    x, y = set((a or "").lower().split()), set((b or "").lower().split())
    if not x or not y:
        return 0.0
    both, left, right = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not left or not right):
        return 100.0
    base, one, two = " ".join(both), " ".join([*both, *left]), " ".join([*both, *right])
    return max(_ratio(one, two), *((_ratio(base, one), _ratio(base, two)) if both else (0.0,)))


def _sent() -> None:
    """The functions go to the executors by name, so the package goes along."""
    ship(SparkSession.active())


def decode_vector(packed: Column | str) -> Column:
    """array<float> of base64 of little-endian 32-bit floats; null for null."""
    _sent()

    def run(batch: pd.Series) -> pd.Series:
        return batch.map(_unpacked)

    return F.pandas_udf(run, "array<float>")(packed)


def encode_vector(vectors: Column | str) -> Column:
    _sent()

    def run(batch: pd.Series) -> pd.Series:
        return batch.map(_packed)

    return F.pandas_udf(run, "string")(vectors)


def first_json_object(raw: Column | str) -> Column:
    """The first complete JSON object in a text, whatever stands around it; null if there is none."""
    _sent()

    def run(batch: pd.Series) -> pd.Series:
        return batch.map(_first_object)

    return F.pandas_udf(run, "string")(raw)


def token_set(a: Column | str, b: Column | str) -> Column:
    """token_set_score of two columns."""
    _sent()

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([token_set_score(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return F.pandas_udf(run, "double")(a, b)
