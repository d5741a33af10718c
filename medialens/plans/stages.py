"""The batch pipeline: ordered stages, resumed by a journal, invalidated by a manifest."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path
from typing import Any

import pyarrow.fs as pafs

from medialens.operators.ingest import stages_to_run
from medialens.settings import Settings

FORMAT_VERSION = 1


@dataclass(frozen=True)
class Stage:
    name: str
    run: Callable[[str | None, Callable[[str], None]], None]
    enabled: bool = True


class _Note:
    """A small JSON file below a folder or a URI of any store that pyarrow knows, replaced as a whole."""

    name = ""

    def __init__(self, root: Path | str):
        place = str(root)
        self.store, folder = pafs.FileSystem.from_uri(place) if "://" in place else (pafs.LocalFileSystem(), place)
        self.path = f"{folder.rstrip('/')}/{self.name}"

    def _read(self) -> Any:
        try:
            with self.store.open_input_stream(self.path) as file:
                return json.loads(file.read())
        except (OSError, ValueError):
            return None

    def _write(self, said: dict) -> None:
        self.store.create_dir(self.path.rpartition("/")[0], recursive=True)
        with self.store.open_output_stream(f"{self.path}.tmp") as file:
            file.write(json.dumps(said).encode())
        self.store.move(f"{self.path}.tmp", self.path)

    def clear(self) -> None:
        if self.store.get_file_info(self.path).type != pafs.FileType.NotFound:
            self.store.delete_file(self.path)


class Journal(_Note):
    """What a run has finished: a stage and, inside it, the last image."""

    name = "journal.json"

    def read(self) -> tuple[str | None, str | None]:
        x = self._read()
        return (x.get("stage"), x.get("cursor")) if isinstance(x, dict) else (None, None)

    def write(self, stage: str, cursor: str | None) -> None:
        self._write({"stage": stage, "cursor": cursor, "updated_at": time.time()})


class Manifest(_Note):
    """The settings that the tables of a folder were written with."""

    name = "manifest.json"

    def matches(self, settings: Settings) -> bool:
        x = self._read()
        return isinstance(x, dict) and x.get("format") == FORMAT_VERSION and x.get("settings") == json.loads(json.dumps(settings.fingerprint()))

    def write(self, settings: Settings) -> None:
        self._write({"format": FORMAT_VERSION, "created_at": time.time(), "settings": settings.fingerprint()})


def run_pipeline(root: Path | str, settings: Settings, stages: list[Stage], wipe: Callable[[], None]) -> list[str]:
    """Runs what is left of the stages, in order, and returns their names.

    root is a folder or a URI, best beside the tables in the shared store: a new driver goes on from there. Tables of other settings are wiped first. A stage gets the cursor it stopped at (only the first one of a resumed
    run has one) and a function that notes its progress. A failure leaves the journal for the next run.
    """
    journal, manifest = Journal(root), Manifest(root)
    if not manifest.matches(settings):
        wipe()
        journal.clear()
        manifest.write(settings)
    chosen = [s for s in stages if s.enabled]
    done, cursor = journal.read()
    left = stages_to_run([s.name for s in chosen], done, cursor)
    for stage in chosen:
        if stage.name in left:
            stage.run(cursor if stage.name == done else None, lambda at, name=stage.name: journal.write(name, at))
            journal.write(stage.name, None)
    journal.clear()
    return left
