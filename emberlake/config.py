"""Detection parameters: validation, the JSON document, and versioned histories."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.operators.ordering import greatest_before


@dataclass(frozen=True)
class DetectionConfig:
    """The defaults are part of the semantics."""

    config_version: int = 1
    window_seconds: int = 300
    bucket_seconds: int = 10
    hot_threshold: int = 1000
    cold_threshold: int = 800
    minimum_hot_ips: int = 16
    minimum_hot_ratio: float = 0.10
    allowed_lateness_seconds: int = 30
    state_retention_seconds: int = 600
    weight_function: str = "threshold_ratio"
    weight_max: int = 1_000_000

    def __post_init__(self) -> None:
        bad = [
            message
            for ok, message in (
                (self.config_version >= 1, "config_version must be 1 or more"),
                (self.bucket_seconds >= 1 and self.window_seconds >= 1, "window and bucket must be positive"),
                (self.bucket_seconds >= 1 and self.window_seconds % max(self.bucket_seconds, 1) == 0, "the window must hold whole buckets"),
                (0 <= self.cold_threshold < self.hot_threshold, "cold_threshold must be below hot_threshold"),
                (self.minimum_hot_ips >= 1, "minimum_hot_ips must be 1 or more"),
                (0.0 <= self.minimum_hot_ratio <= 1.0, "minimum_hot_ratio must be in [0, 1]"),
                (self.allowed_lateness_seconds >= 0, "lateness must not be negative"),
                (self.state_retention_seconds >= self.window_seconds, "retention must cover the window"),
                (self.weight_function == "threshold_ratio", "unknown weight_function"),
                (1000 <= self.weight_max <= 1_000_000, "weight_max must be in [1000, 1000000]"),
            )
            if not ok
        ]
        if bad:
            raise ValueError("; ".join(bad))

    @property
    def bucket_count(self) -> int:
        return self.window_seconds // self.bucket_seconds

    @classmethod
    def from_json(cls, text: str) -> DetectionConfig:
        """Strict: unknown or repeated keys and wrong types are errors."""

        def unique(pairs: list[tuple[str, object]]) -> dict:
            keys = [k for k, _ in pairs]
            if len(set(keys)) < len(keys):
                raise ValueError("repeated key")
            return dict(pairs)

        doc = json.loads(text, object_pairs_hook=unique)
        kinds = {f.name: type(f.default) for f in fields(cls)}
        if not isinstance(doc, dict) or (unknown := set(doc) - set(kinds)):
            raise ValueError(f"unknown keys: {sorted(unknown) if isinstance(doc, dict) else doc!r}")
        for key, value in doc.items():
            numeric = isinstance(value, int | float) and not isinstance(value, bool)
            if kinds[key] is str and not isinstance(value, str) or kinds[key] is float and not numeric or kinds[key] is int and not (numeric and float(value).is_integer()):
                raise ValueError(f"{key}: {value!r}")
        return cls(**{k: kinds[k](v) for k, v in doc.items()})

    def to_json(self) -> str:
        return json.dumps(asdict(self), separators=(",", ":"))

    @classmethod
    def load(cls, path: str) -> DetectionConfig:
        with open(path, encoding="utf-8") as f:
            return cls.from_json(f.read())


def accepted_versions(history: DataFrame, span: int = 10_000) -> DataFrame:
    """Of (seen_at, config_version, ...) the rows that a poller adopts: each strictly newer than all before it. Compared within spans of ``seen_at`` first."""
    rows = greatest_before(history.withColumn("_all", F.lit(0)), ["_all"], "config_version", "seen_at", ["seen_at"], "_newest", span)
    return rows.where("_newest is null or config_version > _newest").drop("_newest", "_all")


def parse_shards(text: str, count: int = 128) -> tuple[int, ...]:
    """``all``, or ids and ranges such as ``0-3,7``; sorted, each below ``count``, none twice."""
    if text.strip() == "all":
        return tuple(range(count))
    out: list[int] = []
    for part in text.split(","):
        first, dash, last = (x.strip() for x in part.partition("-"))
        if not first.isdecimal() or dash and not last.isdecimal():
            raise ValueError(f"not a shard or range: {part!r}")
        low, high = int(first), int(last) if dash else int(first)
        if not 0 <= low <= high < count:
            raise ValueError(f"out of range: {part!r}")
        out += range(low, high + 1)
    if len(set(out)) < len(out):
        raise ValueError("a shard is named twice")
    return tuple(sorted(out))
