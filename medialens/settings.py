"""Settings: typed, tolerant of wrong values, with the defaults of each pass."""

from __future__ import annotations

import dataclasses
import json
import os
import re
import shutil
from collections.abc import Sequence
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class NearDuplicates:
    enabled: bool = True
    hamming_threshold: int = 12


@dataclass(frozen=True)
class Detection:
    enabled: bool = False
    nms_iou: float = 0.8
    max_regions: int = 10
    score_threshold: float = 0.25
    area_gamma: float = 0.3
    center_penalty: float = 0.6
    secondary_min_priority: float = 0.03
    secondary_min_relative: float = 0.3


@dataclass(frozen=True)
class Objects:
    top_k: int = 5
    score_min: float = 0.32
    margin_min: float = 0.08
    min_regions: int = 1
    rollup_score_min: float = 0.32
    whitelist: tuple[str, ...] = ()
    blacklist: tuple[str, ...] = ()


@dataclass(frozen=True)
class Clusters:
    enabled: bool = True
    k: int = 20
    threshold: float = 0.78
    region_threshold: float = 0.82
    min_size: int = 3


@dataclass(frozen=True)
class Scenes:
    score_min: float = 0.15
    margin_min: float = 0.01
    head_threshold: float = 0.5


@dataclass(frozen=True)
class Settings:
    near_duplicates: NearDuplicates = field(default_factory=NearDuplicates)
    detection: Detection = field(default_factory=Detection)
    objects: Objects = field(default_factory=Objects)
    clusters: Clusters = field(default_factory=Clusters)
    scenes: Scenes = field(default_factory=Scenes)

    def fingerprint(self) -> dict[str, Any]:
        """What results depend on; a table written under another fingerprint is not used again."""
        return dataclasses.asdict(self)


def _fitted(default: Any, value: Any) -> Any:
    if isinstance(default, bool):
        return value if isinstance(value, bool) else default
    if isinstance(default, int):
        return value if isinstance(value, int) and not isinstance(value, bool) else default
    if isinstance(default, float):
        return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else default
    if isinstance(default, tuple):
        return tuple(x for x in value if isinstance(x, str)) if isinstance(value, list) else default
    return default


def parse(raw: Any) -> Settings:
    """Settings from nested dicts; unknown names and values of the wrong type are left out."""
    parts = {}
    for f in dataclasses.fields(Settings):
        section, default = (raw.get(f.name) if isinstance(raw, dict) else None), f.default_factory()
        section = section if isinstance(section, dict) else {}
        parts[f.name] = dataclasses.replace(default, **{g.name: _fitted(getattr(default, g.name), section[g.name]) for g in dataclasses.fields(default) if g.name in section})
    return Settings(**parts)


def load(path: str | None = None) -> Settings:
    """Settings of a JSON or YAML file: the argument, $MEDIALENS_SETTINGS, or settings.json or .yaml here; defaults where there is none or it can't be read.
    YAML needs the yaml module; without it such a file is an error."""
    for place in (path, os.environ.get("MEDIALENS_SETTINGS"), "settings.json", "settings.yaml"):
        if place and Path(place).is_file():
            return parse(_read(Path(place)))
    return Settings()


def _read(path: Path) -> Any:
    text = path.read_text()
    if path.suffix.lower() not in (".yaml", ".yml"):
        try:
            return json.loads(text)
        except ValueError:
            return None
    import yaml

    try:
        return yaml.safe_load(text)
    except yaml.YAMLError:
        return None


#: Presets of model names by kind; an explicit name goes before a preset, a preset before the default.
def model_name(explicit: str | None, preset: str | None, presets: dict[str, str], default: str) -> str:
    if explicit:
        return explicit
    if preset:
        if preset not in presets:
            raise KeyError(f"unknown preset {preset}")
        return presets[preset]
    return default


def checked_database_url(url: str | None) -> str:
    """A PostgreSQL URL with a database name; anything else is an error."""
    url = (url or "").strip()
    scheme, sep, rest = url.partition("://")
    if not sep or scheme.split("+")[0] not in ("postgresql", "postgres"):
        raise ValueError("a postgresql:// URL is needed")
    if not rest.partition("/")[2].split("?")[0]:
        raise ValueError("the URL names no database")
    return url


def checked_cache_root(path: str | None) -> Path:
    """A folder for tables; URLs and database files are errors."""
    text = (path or "").strip()
    if not text or "://" in text or text.endswith(".db"):
        raise ValueError("the cache root must be a folder")
    return Path(text)


def masked_url(url: str) -> str:
    """A database URL whose password can't be read, for logs."""
    return re.sub(r"(://[^:/@?#]*):[^@/?#]*@", r"\1:***@", url)


def checked_identifier(name: str) -> str:
    """A name of a database or role: letters of ASCII, digits and underscores; anything else is an error."""
    if not re.fullmatch(r"[A-Za-z0-9_]+", name or ""):
        raise ValueError(f"not an identifier: {name!r}")
    return name


def checked_binary(name: str) -> str:
    """The path of a program; an error if there is none."""
    found = shutil.which(name)
    if found is None:
        raise FileNotFoundError(f"{name} is not on the path")
    return found


def detector_backend(enabled: bool, backend: str, known: Sequence[str] = ("owlvit", "grounding_dino")) -> str:
    """The name of the detector to load; detection that is switched off and unknown names are errors."""
    if not enabled:
        raise RuntimeError("detection is switched off")
    name = (backend or "").strip().lower()
    if name not in known:
        raise ValueError(f"unknown detector: {backend!r}")
    return name


def model_ids(*names: str | None) -> list[str]:
    """Distinct ids of the models that a run needs, in order; for fetching them beforehand."""
    return sorted({n.strip() for n in names if n and n.strip()})
