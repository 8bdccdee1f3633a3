"""What a dataset consists of, and golden questions: small files that the driver reads."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Source:
    """A domain's files and the statute patterns that its pages are searched for."""

    domain: str
    paths: tuple[str, ...]
    statute_patterns: tuple[str, ...] = ("usc", "cfr")


@dataclass(frozen=True)
class Dataset:
    """A named set of sources, and the pairs of domains between which cases are matched."""

    name: str
    sources: tuple[Source, ...]
    cross_domain: tuple[tuple[str, str], ...] = ()
    settings: dict[str, str] = field(default_factory=dict)


def load_dataset(path: str) -> Dataset:
    """A dataset from JSON, or from YAML where that library is there. An environment variable DOCKETRY_<NAME> overrides a setting."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        import yaml

        raw = yaml.safe_load(text)
    else:
        raw = json.loads(text)
    settings = {k: os.environ.get(f"DOCKETRY_{k.upper()}", v) for k, v in raw.get("settings", {}).items()}
    sources = tuple(Source(s["domain"], tuple(s["paths"]), tuple(s.get("statute_patterns", ("usc", "cfr")))) for s in raw["sources"])
    known = {s.domain for s in sources}
    pairs = tuple((a, b) for a, b in raw.get("cross_domain", ()))
    if unknown := {d for p in pairs for d in p} - known:
        raise ValueError(f"cross_domain names unknown domains: {sorted(unknown)}")
    return Dataset(raw["name"], sources, pairs, settings)


def golden_questions(spark: SparkSession, questions: list[dict]) -> DataFrame:
    """Golden questions as a table. A repeated id is an error."""
    ids = [q["id"] for q in questions]
    if len(ids) != len(set(ids)):
        raise ValueError("golden questions repeat an id")
    rows = [(q["id"], q.get("category"), q.get("question"), q.get("expected_cases") or [], q.get("expect", "answer"), q.get("needs_tools") or []) for q in questions]
    return spark.createDataFrame(rows, "id string, category string, question string, expected_cases array<string>, expect string, needs_tools array<string>")
