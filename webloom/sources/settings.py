"""Settings in layers: defaults, then a YAML file, then explicit arguments."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from pathlib import Path
from typing import Any, TypeVar

T = TypeVar("T")


@dataclass(frozen=True)
class Host:
    name: str
    domains: tuple[str, ...] = ()


@dataclass(frozen=True)
class Crawl:
    archive_dir: str = "archive"
    archive_time: int | None = None
    hosts: tuple[Host, ...] = ()
    workers: int = 1
    seed_urls: tuple[str, ...] = ()
    user_agent: str = "webloom"
    reset: bool = False


@dataclass(frozen=True)
class Search:
    collection: str = "archive"
    limit: int = 5
    source: str | None = None
    query: str = "hello world"


@dataclass(frozen=True)
class Indexing:
    chunk_size: int = 500
    overlap: int = 96
    least_bytes: int = 5000
    embed_batch: int = 64
    extra: dict = field(default_factory=dict)


def layered(kind: type[T], path: str | None = None, **given: Any) -> T:
    """An instance of ``kind``: its defaults, overridden by the file, overridden by arguments that are not None."""
    import yaml

    known = {f.name for f in fields(kind)}
    found = (yaml.safe_load(Path(path).read_text()) or {}) if path else {}
    if unknown := {*found, *given} - known:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    if "hosts" in found:
        found["hosts"] = tuple(Host(h["name"], tuple(h.get("domains", ()))) for h in found["hosts"])
    if "seed_urls" in found:
        found["seed_urls"] = tuple(found["seed_urls"])
    return replace(kind(), **{**found, **{k: v for k, v in given.items() if v is not None}})
