"""What a user may plug in: functions for SQL, transforms with a fingerprint, search backends, settings."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession

#: Functions that SQL text can use, as SQL: name, parameters, type, body.
SQL_FUNCTIONS = (
    ("plain_key", "x STRING", "STRING", r"trim(regexp_replace(lower(regexp_replace(x, '\\s*\\([^()]*\\)\\s*$', '')), '[\\s_-]+', ' '))"),
    ("text_digest", "x STRING", "STRING", "sha2(coalesce(x, ''), 256)"),
    ("mastery_level", "score DOUBLE", "STRING", "CASE WHEN score >= 85 THEN 'mastered' WHEN score >= 60 THEN 'learning' ELSE 'fragile' END"),
    ("clamp", "n BIGINT, low BIGINT, high BIGINT", "BIGINT", "greatest(low, least(n, high))"),
)


def register_functions(spark: SparkSession) -> list[str]:
    """Make the functions known to a session's SQL; gives their names."""
    for name, parameters, kind, body in SQL_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return [f[0] for f in SQL_FUNCTIONS]


class Transform(Protocol):
    """A step of a pipeline: what it needs, whether its inputs will do, and what it makes of them."""

    name: str
    inputs: tuple[str, ...]

    def validate(self, inputs: dict[str, DataFrame]) -> list[str]: ...

    def run(self, inputs: dict[str, DataFrame]) -> DataFrame: ...


def fingerprint(transform: Transform, parameters: dict[str, Any], versions: dict[str, str]) -> str:
    """A step's digest by its name, parameters and the versions of its inputs; equal ones need no new run."""
    return hashlib.sha256(json.dumps([transform.name, parameters, {k: versions[k] for k in transform.inputs}], sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def run_transforms(transforms: list[Transform], tables: dict[str, DataFrame], done: dict[str, str], parameters: dict[str, dict[str, Any]], versions: dict[str, str]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Run the steps in order; one whose fingerprint is in done and whose table is there is passed over.
    Problems that a step finds with its inputs are an error. Gives all tables and the new fingerprints."""
    tables, versions, marks = dict(tables), dict(versions), dict(done)
    for t in transforms:
        mark = fingerprint(t, parameters.get(t.name, {}), versions)
        if done.get(t.name) != mark or t.name not in tables:
            if problems := t.validate(inputs := {k: tables[k] for k in t.inputs}):
                raise ValueError(f"{t.name}: {'; '.join(problems)}")
            tables[t.name] = t.run(inputs)
        marks[t.name] = versions[t.name] = mark
    return tables, marks


class SearchBackend(Protocol):
    """Ranked rows (key and rank, least is best) of a query over a table of texts."""

    def search(self, rows: DataFrame, query: str, fields: tuple[str, ...], key: str) -> DataFrame: ...


class SubstringBackend:
    """The library's own: contiguous substrings by BM25."""

    def search(self, rows: DataFrame, query: str, fields: tuple[str, ...], key: str) -> DataFrame:
        from marlstone.operators.search import search

        return search(rows, query, fields, key)


def checked(rows: DataFrame, *validators: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows, if none of the validators (each gives the rows that it finds wrong) finds any."""
    for validator in validators:
        if bad := validator(rows).limit(3).collect():
            raise ValueError(f"{getattr(validator, '__name__', 'validator')} refuses {bad}")
    return rows


def merged(base: dict, over: dict) -> dict:
    """Settings laid over others, key by key; what is no dictionary on both sides is replaced."""
    return base | {k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def extended(name: str, templates: dict[str, dict]) -> dict:
    """A template over those it extends, the farthest first. A circle or an unknown name is an error."""
    chain: list[str] = []
    at: str | None = name
    while at:
        if at in chain or at not in templates:
            raise ValueError(f"{'circle' if at in chain else 'unknown template'}: {' > '.join([*chain, at])}")
        chain.append(at)
        at = templates[at].get("extends")
    out: dict = {}
    for n in reversed(chain):
        out = merged(out, {k: v for k, v in templates[n].items() if k != "extends"})
    return out


_VARIABLE = re.compile(r"\$(?:\{([A-Za-z_]\w*)\}|([A-Za-z_]\w*))")


def number(text: str) -> int | float | str:
    """A whole number, else a decimal one, else the text."""
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def substituted(value: Any, variables: dict[str, Any]) -> Any:
    """Settings with $NAME and ${NAME} replaced in their texts; unknown names stay. A text that is nothing
    but a variable becomes a number where it is one."""
    if isinstance(value, dict):
        return {k: substituted(v, variables) for k, v in value.items()}
    if isinstance(value, list):
        return [substituted(v, variables) for v in value]
    if not isinstance(value, str):
        return value
    out = _VARIABLE.sub(lambda m: str(variables[m[1] or m[2]]) if (m[1] or m[2]) in variables else m[0], value)
    return number(out) if out != value and _VARIABLE.fullmatch(value) else out
