"""Settings: defaults, a JSON file, then what a caller gives."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path

FILE = "graphloom.json"


@dataclass(frozen=True)
class Config:
    root: str = "."
    index: str = ".graphloom"
    repo: str = ""
    ignore: tuple[str, ...] = ()
    watch_gap_ms: int = 1500
    large_file_symbols: int = 30
    aliases: dict[str, str] = field(default_factory=lambda: {"@/": "src/"})


def load(root: str = ".", **given) -> Config:
    """given wins over the file, the file over the defaults; unknown names are an error."""
    path = Path(root) / FILE
    known = {f.name for f in fields(Config)}
    values = json.loads(path.read_text()) if path.exists() else {}
    if unknown := (set(values) | set(given)) - known:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    values = {k: tuple(v) if k == "ignore" else v for k, v in values.items()}
    return replace(Config(root=root, repo=Path(root).resolve().name), **values | {k: v for k, v in given.items() if v is not None})


def init(root: str = ".") -> Path:
    """Writes the defaults to a new file."""
    path = Path(root) / FILE
    if path.exists():
        raise FileExistsError(path)
    path.write_text(json.dumps(asdict(Config()), indent=2))
    return path


def tsconfig_aliases(root: str) -> dict[str, str]:
    """Path aliases of tsconfig.json, and of the file it extends: prefix to folder, both without their star; none if unreadable."""

    def read(path: Path) -> dict:
        try:
            found = json.loads(path.read_text())
        except (OSError, ValueError):
            return {}
        return found if isinstance(found, dict) else {}

    own = read(Path(root, "tsconfig.json"))
    options = dict(own.get("compilerOptions") or {})
    if isinstance(base := own.get("extends"), str):
        path = Path(root, base)
        options = dict(read(path if path.is_file() else Path(f"{path}.json")).get("compilerOptions") or {}) | options
    paths = options.get("paths") or {}
    first = {k: v[0] for k, v in paths.items() if isinstance(v, list) and v}
    return {k.replace("*", ""): os.path.normpath(v.replace("*", "_"))[: -1 if "*" in v else None] for k, v in first.items()}
