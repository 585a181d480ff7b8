"""Logs of runs: a logger for console and file, and a record of each experiment's settings, results and duration."""

from __future__ import annotations

import json
import logging
import sys
import time
from collections.abc import Iterator
from contextlib import contextmanager

FORMAT = "%(asctime)s %(levelname)s %(name)s: %(message)s"


def setup(name: str = "tesserae", level: str | int = "INFO", file: str | None = None, console: bool = True) -> logging.Logger:
    """The logger of a name, writing to the console and to a file on the driver; called again it starts anew with its handlers."""
    log = logging.getLogger(name)
    for old in list(log.handlers):
        log.removeHandler(old)
        old.close()
    log.setLevel(level)
    log.propagate = False
    for handler in [*([logging.StreamHandler(sys.stderr)] if console else []), *([logging.FileHandler(file, encoding="utf-8")] if file else [])]:
        handler.setFormatter(logging.Formatter(FORMAT))
        log.addHandler(handler)
    return log


def experiment_start(log: logging.Logger, name: str, settings: dict) -> float:
    """Say what begins and with which settings; the time of the start."""
    log.info("start %s %s", name, json.dumps(settings, sort_keys=True, default=str))
    return time.time()


def experiment_end(log: logging.Logger, name: str, results: dict, began: float | None = None) -> None:
    """Say what ended, with which results and after how many seconds."""
    took = {} if began is None else {"seconds": round(time.time() - began, 3)}
    log.info("end %s %s", name, json.dumps(results | took, sort_keys=True, default=str))


@contextmanager
def experiment(log: logging.Logger, name: str, settings: dict) -> Iterator[dict]:
    """An experiment around a block: results put into the dictionary are logged at the end, an exception is logged and goes on."""
    results: dict = {}
    began = experiment_start(log, name, settings)
    try:
        yield results
    except Exception:
        log.exception("failed %s", name)
        raise
    experiment_end(log, name, results, began)


@contextmanager
def level(log: logging.Logger, now: str | int) -> Iterator[logging.Logger]:
    """Another level within a block."""
    before = log.level
    log.setLevel(now)
    try:
        yield log
    finally:
        log.setLevel(before)
