"""What runs need around their queries: settings, prompts, provenance, timing, and result files."""

from __future__ import annotations

import hashlib
import json
import logging
import os
import platform
import subprocess
import time
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime
from pathlib import Path

import pyspark
from pyspark.sql import DataFrame

PROMPTS = Path(__file__).resolve().parent.parent / "prompts"
logger = logging.getLogger("versicle")


def read_env(path: str | Path = ".env") -> dict[str, str]:
    """``KEY=value`` lines of a file; comments and other lines don't count, quotes around a value go. No file is no setting."""
    if not Path(path).is_file():
        return {}
    pairs = (line.split("=", 1) for line in map(str.strip, Path(path).read_text(encoding="utf-8").splitlines()) if "=" in line and not line.startswith("#"))
    return {key.strip(): value.strip().strip("\"'") for key, value in pairs}


def setting(name: str, default: str = "", path: str | Path = ".env") -> str:
    """From the environment, else from the file, else the default."""
    return os.environ.get(name) or read_env(path).get(name, default)


def load_prompt(name: str) -> str:
    return (PROMPTS / f"{name}.md").read_text(encoding="utf-8").strip()


def prompt_sha256(name: str) -> str:
    return hashlib.sha256(load_prompt(name).encode()).hexdigest()


def git_state(folder: str | Path = ".") -> str:
    """The commit that is checked out, with ``-dirty`` where files differ from it; ``unknown`` outside a repository."""
    git = lambda *args: subprocess.run(["git", "-C", str(folder), *args], capture_output=True, text=True, check=True).stdout.strip()
    try:
        return git("rev-parse", "HEAD") + ("-dirty" if git("status", "--porcelain") else "")
    except (OSError, subprocess.CalledProcessError):
        return "unknown"


def provenance(models: dict[str, str], build: dict, settings: dict | None = None, folder: str | Path = ".") -> dict:
    """What it takes to make a result again: code, models with their digests, prompts, index build, settings, versions and date."""
    run = os.environ.get("GITHUB_RUN_ID", "")
    server, repository = os.environ.get("GITHUB_SERVER_URL", "https://github.com"), os.environ.get("GITHUB_REPOSITORY", "")
    return {
        "code": git_state(folder),
        "date": datetime.now(UTC).isoformat(timespec="seconds"),
        "models": dict(sorted(models.items())),
        "prompts": {p.stem: prompt_sha256(p.stem) for p in sorted(PROMPTS.glob("*.md"))},
        "build": build,
        "settings": settings or {},
        "python": platform.python_version(),
        "spark": pyspark.__version__,
        "ci": {"event": os.environ.get("GITHUB_EVENT_NAME", ""), "run": f"{server}/{repository}/actions/runs/{run}"} if run else {},
    }


def write_result(rows: DataFrame, path: str, facts: dict) -> None:
    """An evaluation's rows as JSON under ``path/cases``, wherever Spark writes, and its facts beside them in ``path/facts``."""
    rows.write.mode("overwrite").json(f"{path}/cases")
    rows.sparkSession.createDataFrame([(json.dumps(facts, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/facts")


class _Console(logging.StreamHandler):
    """The one handler of this engine's lines."""


def console(silent: bool = False) -> logging.Logger:
    """Each line is printed once, whoever else logs; a silent console still shows warnings, as fallbacks must not be hidden."""
    logger.setLevel(logging.INFO)
    logger.propagate = False
    handler = next((h for h in logger.handlers if isinstance(h, _Console)), None)
    if handler is None:
        handler = _Console()
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        logger.addHandler(handler)
    handler.setLevel(logging.WARNING if silent else logging.INFO)
    return logger


@contextmanager
def stage(name: str, trace: bool = False) -> Iterator[None]:
    """Times what an action takes; the line is written in trace mode only."""
    began = time.perf_counter()
    try:
        yield
    finally:
        if trace:
            console().info("%s latency=%.3fs", name, time.perf_counter() - began)
