"""A registry of named catalogues: YAML files merged over each other, aliases, and name resolution."""

from __future__ import annotations

import difflib
import os
from dataclasses import fields
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

from ..catalogue import Catalogue
from ..errors import ConfigError
from .files import SUFFIXES, read
from .mirror import first_of
from .tiles import is_tiled

NAME = "skyzone.yaml"
ROLES = {f.name for f in fields(Catalogue)} - {"df", "name"}


def merged(base: dict, over: dict) -> dict:
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load(*paths: str | os.PathLike) -> dict[str, Any]:
    """Files merged in order; by default the user's and the working folder's."""
    import yaml

    found = [Path(p) for p in paths] or [p for p in (Path.home() / ".config" / NAME, Path.cwd() / NAME) if p.exists()]
    out: dict[str, Any] = {"catalogues": {}, "aliases": {}}
    for p in found:
        try:
            own = yaml.safe_load(p.read_text()) or {}
        except (OSError, yaml.YAMLError) as e:
            raise ConfigError(f"can't read {p}: {e}") from e
        if not isinstance(own, dict):
            raise ConfigError(f"{p} must hold a mapping")
        out = merged(out, own)
    for name, entry in out["catalogues"].items():
        if not isinstance(entry, dict) or not entry.get("path"):
            raise ConfigError(f"catalogue {name!r} needs a path")
        if odd := set(entry) - ROLES - {"path", "description", "fallbacks"}:
            raise ConfigError(f"catalogue {name!r} has unknown keys {sorted(odd)}")
    for alias, name in out["aliases"].items():
        if name not in out["catalogues"]:
            raise ConfigError(f"alias {alias!r} names unknown catalogue {name!r}")
    return out


def resolve(spark: SparkSession, name: str, config: dict[str, Any] | None = None, **roles) -> Catalogue:
    """A catalogue by alias or name, whatever the case, or by the path of a file or a tiled folder."""
    config = config or {"catalogues": {}, "aliases": {}}
    lower = {k.lower(): k for k in config["catalogues"]} | {k.lower(): v for k, v in config["aliases"].items()}
    own = config["catalogues"].get(lower.get(name.lower(), ""))
    if own is not None:
        entry = {k: v for k, v in own.items() if k in ROLES}
        # the first of the places that can be read
        df = first_of([own["path"], *own.get("fallbacks", [])], lambda path: read(spark, path))
        return Catalogue(df, name=name, **{**entry, **roles})
    if is_tiled(name) or Path(name).suffix.lower() in SUFFIXES:
        return Catalogue(read(spark, name), name=Path(name).stem, **roles)
    near = difflib.get_close_matches(name.lower(), lower, 3)
    raise ConfigError(f"unknown catalogue {name!r}" + (f"; did you mean {', '.join(near)}?" if near else ""))


def drift(bundled: dict[str, Any], own: dict[str, Any]) -> list[tuple[str, str]]:
    """(name, how) of what the user's registry says otherwise than the one it started from.

    outdated: the same place read in another way; informational: only the description differs; missing: not
    taken over; user: the user's own; alias: a name that leads elsewhere.
    """
    out = []
    theirs, ours = bundled.get("catalogues", {}), own.get("catalogues", {})
    bare = lambda e: {k: v for k, v in e.items() if k != "description"}
    for name in sorted(set(theirs) | set(ours)):
        if name not in ours:
            out.append((name, "missing"))
        elif name not in theirs:
            out.append((name, "user"))
        elif bare(theirs[name]) != bare(ours[name]):
            out.append((name, "outdated"))
        elif theirs[name] != ours[name]:
            out.append((name, "informational"))
    a, b = bundled.get("aliases", {}), own.get("aliases", {})
    return out + [(name, "alias") for name in sorted(b) if a.get(name, b[name]) != b[name]]


def adopted(own: dict[str, Any], bundled: dict[str, Any], names: list[str]) -> dict[str, Any]:
    """The user's registry with the named entries as the other has them."""
    if unknown := [n for n in names if n not in bundled.get("catalogues", {})]:
        raise ConfigError(f"there are no catalogues {unknown} to adopt")
    return {**own, "catalogues": {**own.get("catalogues", {}), **{n: bundled["catalogues"][n] for n in names}}}


def save(registry: dict[str, Any], path: str | os.PathLike) -> None:
    """Write a registry beside its place and put it there."""
    import yaml

    part = f"{os.fspath(path)}.part"
    Path(part).write_text(yaml.safe_dump(registry, sort_keys=True))
    os.replace(part, path)
