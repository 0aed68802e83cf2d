"""What the jobs share: configuration and the log."""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

log = logging.getLogger("granary.jobs")


def configured(description: str, defaults: Path, argv: list[str] | None) -> dict:
    """The values of a JSON file, by default the one beside the job, each of which an option of its name overrides."""
    p = argparse.ArgumentParser(description=description)
    p.add_argument("--config", default=str(defaults))
    known, rest = p.parse_known_args(argv)
    values = json.loads(Path(known.config).read_text())
    for name, v in values.items():
        p.add_argument(f"--{name}", type=type(v) if v is not None else str, default=v)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    found = vars(p.parse_args(rest))
    found.pop("config")
    missing = [k for k, v in found.items() if v in (None, "")]
    if missing:
        p.error(f"not given: {', '.join(missing)}")
    return found
