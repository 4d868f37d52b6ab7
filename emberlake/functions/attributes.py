"""Attribute documents: validation and canonical text.

An attribute document is a JSON object with attributes_version, an optional weight and
open ``x_`` entries. Parsing, duplicate keys and exact re-serialisation are beyond
Spark's JSON functions, so the whole rule set is one Arrow-batched function.
"""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Limits of an attribute document.
MAX_BYTES, MAX_KEYS, MAX_DIGITS, MAX_WEIGHT = 1024, 16, 640, 1_000_000
OPEN_NAME = re.compile(r"x_[a-z0-9_]{1,48}")


class _Invalid(ValueError):
    pass


def _object(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise _Invalid("repeated key")
    return out


def _number(text: str) -> int:
    if len(text.lstrip("-")) > MAX_DIGITS:
        raise _Invalid("too many digits")
    return int(text)


def _constant(text: str) -> float:
    raise _Invalid(text)


def _whole(value: object) -> bool:
    return isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and math.isfinite(value) and value.is_integer()


def _check(value: object) -> None:
    if isinstance(value, float) and not math.isfinite(value):
        raise _Invalid("not a finite number")
    if isinstance(value, str):
        value.encode("utf-8")  # no lone surrogates
    for inner in value.values() if isinstance(value, dict) else value if isinstance(value, list) else ():
        _check(inner)
    for key in value if isinstance(value, dict) else ():
        key.encode("utf-8")


def canonical(text: str) -> str:
    """The canonical compact ASCII form of a valid document; ValueError otherwise."""
    if len(text.encode("utf-8", "surrogatepass")) > 16 * MAX_BYTES:
        raise _Invalid("too long")
    doc = json.loads(text, object_pairs_hook=_object, parse_int=_number, parse_constant=_constant)
    if not isinstance(doc, dict):
        raise _Invalid("not an object")
    _check(doc)
    if len(doc) > MAX_KEYS:
        raise _Invalid("too many keys")
    version = doc.get("attributes_version")
    if not _whole(version) or version < 1:
        raise _Invalid("attributes_version")
    doc["attributes_version"] = int(version)
    if version == 1 and (unknown := [k for k in doc if k not in ("attributes_version", "weight") and not OPEN_NAME.fullmatch(k)]):
        raise _Invalid(f"unknown: {unknown[0]}")
    if version == 1 and "weight" in doc:
        if not _whole(doc["weight"]) or not 0 <= doc["weight"] <= MAX_WEIGHT:
            raise _Invalid("weight")
        doc["weight"] = int(doc["weight"])
    out = json.dumps(doc, separators=(",", ":"), allow_nan=False)
    if len(out) > MAX_BYTES:
        raise _Invalid("too long")
    return out


@F.pandas_udf(T.StringType())
def canonicalize(text: pd.Series) -> pd.Series:
    """Canonical text of each valid document, null for the others."""

    def one(t: str | None) -> str | None:
        try:
            return None if t is None else canonical(t)
        except (ValueError, RecursionError):
            return None

    return text.map(one)


def simple_weight(text):
    """The weight of a canonical document, without Python."""
    return F.get_json_object(text, "$.weight").cast("long")
