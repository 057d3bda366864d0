"""Seat specifications and questions, as they are handed in."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

FIELDS = "name string, display string, kind string, probe string, min_docs int, surname string, surname_aliases array<string>, initials array<string>, queries array<string>, own_topics array<string>, territory string"
KEYS = tuple(f.split()[0] for f in FIELDS.split(", "))
PLACEHOLDERS = ("todo", "tbd", "fixme", "changeme", "<", "...")


def checked(spec: dict) -> dict:
    """A seat's specification with all fields. Raises for unknown keys, for a
    missing name or display, and for placeholders left in it."""
    unknown = sorted(set(spec) - set(KEYS))
    if unknown:
        raise ValueError(f"unknown keys: {', '.join(unknown)}")
    for k in ("name", "display"):
        if not str(spec.get(k) or "").strip():
            raise ValueError(f"a seat needs {k}")
    for k, v in spec.items():
        for text in v if isinstance(v, list) else [v]:
            if isinstance(text, str) and text.strip().lower().startswith(PLACEHOLDERS):
                raise ValueError(f"placeholder in {k}: {text}")
    return {k: spec.get(k) for k in KEYS}


def seats(spark: SparkSession, specs: Iterable[dict], only: list[str] | None = None) -> DataFrame:
    """Seats as a table, with ``place``, their order: that of ``only`` where it
    is given. Unknown and repeated names raise."""
    rows: dict[str, dict] = {}
    for spec in map(checked, specs):
        if spec["name"] in rows:
            raise ValueError(f"seat {spec['name']} is given twice")
        rows[spec["name"]] = spec
    names = list(rows) if only is None else only
    missing = [n for n in names if n not in rows]
    if missing:
        raise KeyError(f"no such seat: {', '.join(missing)}")
    return spark.createDataFrame([(*[rows[n][k] for k in KEYS], i) for i, n in enumerate(names)], f"{FIELDS}, place int")


def read_seats(spark: SparkSession, path: str, only: list[str] | None = None) -> DataFrame:
    """:func:`seats` of a JSON file, or of YAML where a reader is installed."""
    text = spark.read.text(path, wholetext=True).first()[0]
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as error:
            raise RuntimeError("YAML seats need a YAML reader") from error
        found = yaml.safe_load(text)
    else:
        found = json.loads(text.removeprefix("﻿"))
    return seats(spark, found["seats"] if isinstance(found, dict) else found, only)


def question(spark: SparkSession, inline: str | None = None, path: str | None = None) -> str:
    """The question of a turn, given in one of two ways. Both, none, and an
    empty one raise; a byte order mark is dropped."""
    if (inline is None) == (path is None):
        raise ValueError("give the question itself or a file, one of them")
    text = inline if inline is not None else spark.read.text(path, wholetext=True).first()[0]
    text = text.removeprefix("﻿").strip()
    if not text:
        raise ValueError("the question is empty")
    return text
