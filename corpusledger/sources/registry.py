"""Configuration and schema scripts: plain Python, read on the driver."""

from __future__ import annotations

import hashlib
import os
import re
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = re.compile(r"^(\d{4})_([a-z0-9_]+)\.sql$")


def expand(value, env: dict[str, str] | None = None):
    """``${NAME}`` in strings, lists and dicts; an unknown name is an error."""
    env = os.environ if env is None else env
    if isinstance(value, str):
        return re.sub(r"\$\{([A-Za-z_][A-Za-z0-9_]*)\}", lambda m: env[m[1]], value)
    if isinstance(value, list):
        return [expand(v, env) for v in value]
    if isinstance(value, dict):
        return {k: expand(v, env) for k, v in value.items()}
    return value


def scripts(folder: str | Path) -> list[tuple[int, str, str]]:
    """(version, name, checksum), numbered densely from 1; anything else in the folder is an error."""
    found = []
    for path in sorted(Path(folder).iterdir()):
        m = NAME.match(path.name)
        if not m:
            raise ValueError(f"not a schema script: {path.name}")
        found.append((int(m[1]), m[2], hashlib.sha256(path.read_bytes().replace(b"\r\n", b"\n")).hexdigest()))
    if [v for v, _, _ in found] != list(range(1, len(found) + 1)):
        raise ValueError("schema scripts must be numbered from 1 without gaps")
    return found


def drift(applied: list[tuple[int, str]], files: list[tuple[int, str, str]]) -> list[str]:
    """What differs between applied scripts (version, checksum) and the files."""
    now = {v: c for v, _, c in files}
    return [f"{v}: missing" if v not in now else f"{v}: changed" for v, c in applied if now.get(v) != c]


def with_defaults(config: dict, defaults: dict) -> dict:
    """A configuration over its defaults, merged key by key; lists and scalars replace."""
    merged = dict(defaults)
    for key, value in config.items():
        merged[key] = with_defaults(value, defaults[key]) if isinstance(value, dict) and isinstance(defaults.get(key), dict) else value
    return merged


def schema_version(applied: DataFrame, column: str = "version") -> DataFrame:
    """One row: the highest version applied, 0 if none."""
    return applied.agg(F.coalesce(F.max(column), F.lit(0)).alias("version"))


def pending_scripts(applied: DataFrame, files: DataFrame) -> DataFrame:
    """Scripts (version, checksum) against what is applied: applied, changed, missing or pending."""
    before, now = applied.select("version", F.col("checksum").alias("before")), files.select("version", F.col("checksum").alias("now"))
    met = before.join(now, "version", "full")
    status = F.when(F.col("before").isNull(), "pending").when(F.col("now").isNull(), "missing").when(F.col("before") != F.col("now"), "changed").otherwise("applied")
    return met.select("version", status.alias("status"))
