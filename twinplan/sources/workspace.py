"""Files around a project: guarded reads, a stable copy, digests, the ledger of a run's views, and profiles.

All of this is work of the driver on few small files; models themselves are read by Spark (see corpus).
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import stat
import tempfile
from pathlib import Path

from twinplan.functions.identifiers import Refused

# Folders that a copy of a project leaves out at its root, and anywhere.
LEFT_OUT_AT_ROOT = frozenset({"target", "logs", ".git", "node_modules", ".venv", "venv"})
LEFT_OUT = frozenset({"__pycache__"})
# The folder in which linked folders are allowed, files that tell which packages a project uses, and where macros lie.
PACKAGES = "dbt_packages"
PACKAGE_FILES = ("dbt_project.yml", "packages.yml", "dependencies.yml", "package-lock.yml")
MACROS = "macros"
# States of a view in the ledger.
STATES = ("recorded", "dropped", "cleanup_failed")
PROFILE_BYTES = 1 << 20


def read_inside(root: str | Path, path: str | Path) -> bytes:
    """A file's bytes: a regular one, or a link to one inside of the project. Pipes, dangling links and ways out are refused."""
    base, target = Path(root).resolve(), Path(root, path)
    try:
        real = target.resolve(strict=True)
        if not real.is_relative_to(base) or not stat.S_ISREG(os.stat(real).st_mode):
            raise Refused("SOURCE_CHANGED_DURING_SNAPSHOT", f"{path} is no file of the project")
        return real.read_bytes()
    except OSError as e:
        raise Refused("SOURCE_CHANGED_DURING_SNAPSHOT", str(path)) from e


def _walk(root: Path) -> list[Path]:
    """The files of a project, sorted; linked folders are refused but for packages."""
    found = []
    for folder, names, files in os.walk(root):
        here = Path(folder)
        kept = []
        for name in sorted(names):
            if name in LEFT_OUT or here == root and name in LEFT_OUT_AT_ROOT:
                continue
            if (here / name).is_symlink():
                if here != root / PACKAGES:
                    raise Refused("SOURCE_CHANGED_DURING_SNAPSHOT", f"{here / name} is a linked folder")
                found += [here / name / p.relative_to((here / name).resolve()) for p in _walk((here / name).resolve())]
            else:
                kept.append(name)
        names[:] = kept
        found += [here / f for f in files]
    return sorted(found)


def _digest_of(files: dict[str, bytes]) -> str:
    """Of names and contents, each with its length, so that no two sets of files give the same text."""
    total = hashlib.sha256()
    for name in sorted(files):
        for part in (name.encode(), files[name]):
            total.update(len(part).to_bytes(8, "big"))
            total.update(part)
    return total.hexdigest()


def _contents(root: Path) -> dict[str, bytes]:
    out = {}
    for p in _walk(root):
        inside_package = PACKAGES in p.relative_to(root).parts[:1]
        out[p.relative_to(root).as_posix()] = p.read_bytes() if inside_package else read_inside(root, p.relative_to(root))
    return out


def snapshot(project: str | Path, target: str | Path | None = None) -> tuple[Path, str]:
    """A copy of a project and its digest. The project is read twice; what changed in between is refused."""
    root = Path(project).resolve()
    copy = Path(target) if target is not None else Path(tempfile.mkdtemp(prefix="project-"))
    first = _contents(root)
    try:
        for name, data in first.items():
            file = copy / name
            file.parent.mkdir(parents=True, exist_ok=True)
            file.write_bytes(data)
        if _digest_of(_contents(root)) != _digest_of(first):
            raise Refused("SOURCE_CHANGED_DURING_SNAPSHOT")
    except BaseException:
        shutil.rmtree(copy, ignore_errors=True)
        raise
    return copy, _digest_of(first)


def package_digest(project: str | Path) -> str:
    """A digest of the project's own and its packages' settings and of all macros."""
    root = Path(project).resolve()
    names = [n for n in PACKAGE_FILES if (root / n).is_file()]
    macros = [p.relative_to(root).as_posix() for p in sorted((root / MACROS).rglob("*.sql")) if p.is_file()]
    return _digest_of({n: read_inside(root, n) for n in [*names, *macros]})


class Ledger:
    """A run's views and their state, in a file that is replaced whole."""

    def __init__(self, path: str | Path):
        self.path = Path(path)

    def entries(self) -> dict[str, str]:
        try:
            found = json.loads(self.path.read_text())
        except FileNotFoundError:
            return {}
        except ValueError as e:
            raise Refused("INTERNAL_ERROR", f"{self.path} is no ledger") from e
        if not isinstance(found, dict) or any(s not in STATES for s in found.values()):
            raise Refused("INTERNAL_ERROR", f"{self.path} is no ledger")
        return found

    def record(self, relation: str, state: str = "recorded") -> None:
        if state not in STATES:
            raise Refused("INTERNAL_ERROR", state)
        entries = {**self.entries(), relation: state}
        self.path.parent.mkdir(parents=True, exist_ok=True)
        with tempfile.NamedTemporaryFile("w", dir=self.path.parent, prefix=".ledger-", delete=False) as new:
            json.dump(entries, new, indent=2, sort_keys=True)
            new.flush()
            os.fsync(new.fileno())
        os.replace(new.name, self.path)


def _yaml(path: Path) -> dict | None:
    """A small file's mapping; None for all that cannot be read as one."""
    import yaml

    try:
        if path.stat().st_size > PROFILE_BYTES:
            return None
        found = yaml.safe_load(path.read_bytes().decode("utf-8"))
    except (OSError, ValueError, yaml.YAMLError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def project_profile(project: str | Path) -> str | None:
    """The name of the profile that a project uses."""
    name = (_yaml(Path(project) / "dbt_project.yml") or {}).get("profile")
    return name if isinstance(name, str) and name else None


def profile_dialect(folder: str | Path, profile: str | None, target: str | None = None) -> str | None:
    """The type of a profile's target (its default one unless named); None where that cannot be told."""
    found = (_yaml(Path(folder) / "profiles.yml") or {}).get(profile) if profile else None
    if not isinstance(found, dict):
        return None
    name = target or found.get("target", "default")
    outputs = found.get("outputs")
    output = outputs.get(name) if isinstance(outputs, dict) and isinstance(name, str) else None
    kind = output.get("type") if isinstance(output, dict) else None
    return kind if isinstance(kind, str) and kind else None
