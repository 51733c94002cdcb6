"""A driver-side logger that drops a record equal to the one before it."""

from __future__ import annotations

import logging
import os


class NoRepeats(logging.Filter):
    def __init__(self):
        super().__init__()
        self.last: tuple | None = None

    def filter(self, record: logging.LogRecord) -> bool:
        now = (record.module, record.levelno, record.getMessage())
        fresh, self.last = now != self.last, now
        return fresh


def get_logger(name: str = "popsieve") -> logging.Logger:
    """The level comes from LOGGING_LEVEL (INFO where it is unset)."""
    logger = logging.getLogger(name)
    if not logger.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        handler.addFilter(NoRepeats())
        logger.addHandler(handler)
        logger.setLevel(os.environ.get("LOGGING_LEVEL", "INFO").upper())
        logger.propagate = False
    return logger
