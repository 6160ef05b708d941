"""Settings: command line over environment over twinplan.toml over defaults."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, fields
from pathlib import Path

from twinplan.functions.identifiers import Refused

FORMATS, FAIL_ON = ("text", "json", "github"), ("never", "finding", "fixable", "different", "unverifiable")


@dataclass(frozen=True)
class Config:
    project_dir: str = "."
    dialect: str | None = None
    scratch_schema: str | None = None
    relation_prefix: str = ""
    fail_on: str = "never"
    format: str = "text"


def load(given: dict, environ: dict | None = None) -> Config:
    """The project's folder comes from the command line alone; a value that is not allowed is refused wherever it is from."""
    environ = os.environ if environ is None else environ
    project = given.get("project_dir") or "."
    file = Path(project) / "twinplan.toml"
    try:
        low = tomllib.loads(file.read_text()) if file.exists() else {}
    except (tomllib.TOMLDecodeError, UnicodeDecodeError) as e:
        raise Refused("INTERNAL_ERROR", f"{file}: {e}") from e
    names = [f.name for f in fields(Config) if f.name != "project_dir"]
    if unknown := set(low) - set(names):
        raise Refused("INTERNAL_ERROR", f"unknown settings: {', '.join(sorted(unknown))}")
    values = {"project_dir": project}
    for name in names:
        for source in (given.get(name), environ.get(f"TWINPLAN_{name.upper()}"), low.get(name)):
            if source is not None:
                values[name] = source
                break
    config = Config(**values)
    if not all(isinstance(v, str) for v in values.values()) or config.format not in FORMATS or config.fail_on not in FAIL_ON:
        raise Refused("INTERNAL_ERROR", "a setting has a value that is not allowed")
    return config
