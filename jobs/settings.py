"""What the jobs' command lines share: a config file, its values overridden by options, a session, a log."""

from __future__ import annotations

import argparse
import json
import logging
import os
from collections.abc import Callable

HERE = os.path.dirname(os.path.abspath(__file__))


def read_config(name: str, path: str | None = None) -> dict:
    """The job's own config file, and over it the one at ``path``; a key that the first lacks is an error."""
    with open(os.path.join(HERE, f"{name}.json"), encoding="utf-8") as f:
        config = json.load(f)
    if path:
        with open(path, encoding="utf-8") as f:
            more = json.load(f)
        if unknown := set(more) - set(config):
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        config |= more
    return config


def command_line(name: str, run: Callable, args: list[str] | None = None) -> None:
    """Read the settings, start a session, call ``run(spark, **settings)``, stop the session."""
    defaults = read_config(name)
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=run.__doc__)
    parser.add_argument("--config", help="a JSON file of settings")
    parser.add_argument("--master", default="local[*]")
    for key, value in defaults.items():
        parser.add_argument(f"--{key}", type=type(value), default=None, help=f"default {value!r}")
    given = vars(parser.parse_args(args))
    master = given.pop("master")
    config = read_config(name, given.pop("config")) | {k: v for k, v in given.items() if v is not None}
    if missing := [k for k, v in config.items() if v == ""]:
        parser.error(f"no value for: {', '.join(missing)}")
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)

    from quern.session import session

    spark = session(master)
    try:
        run(spark, **config)
    finally:
        spark.stop()
