"""Structured logs: one JSON object a line, in files that turn over."""

from __future__ import annotations

import json
import logging
from logging.handlers import RotatingFileHandler
from pathlib import Path

#: Bytes of a file, and how many old ones are kept.
MAX_BYTES, BACKUPS = 10_000_000, 5
_OWN = frozenset(vars(logging.makeLogRecord({}))) | {"message", "asctime", "taskName"}


class JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        out = {"time": record.created, "level": record.levelname, "name": record.name, "message": record.getMessage()}
        out |= {k: v for k, v in vars(record).items() if k not in _OWN}
        if record.exc_info:
            out["error"] = self.formatException(record.exc_info)
        return json.dumps(out, default=str, ensure_ascii=False)


def logger(name: str, path: str, max_bytes: int = MAX_BYTES, backups: int = BACKUPS) -> logging.Logger:
    """A logger of the driver that writes there; asked for again it gets no second handler."""
    log = logging.getLogger(name)
    target = str(Path(path).resolve())
    if not any(isinstance(h, RotatingFileHandler) and h.baseFilename == target for h in log.handlers):
        Path(target).parent.mkdir(parents=True, exist_ok=True)
        handler = RotatingFileHandler(target, maxBytes=max_bytes, backupCount=backups, encoding="utf-8")
        handler.setFormatter(JsonLines())
        log.addHandler(handler)
        log.setLevel(logging.INFO)
    return log
