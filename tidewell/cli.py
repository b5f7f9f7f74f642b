"""Command line: ``serve`` checks the configuration, ``config`` prints it or writes the template."""

from __future__ import annotations

import argparse
import dataclasses
import json
import sys

from .config import Config, default_path, template
from .errors import ConfigError


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidewell")
    commands = parser.add_subparsers(dest="command", required=True)
    serve = commands.add_parser("serve")
    serve.add_argument("--config")
    config = commands.add_parser("config")
    config.add_argument("--generate", action="store_true")
    config.add_argument("--file")
    o = parser.parse_args(args)
    try:
        if o.command == "config" and o.generate:
            print(template(), end="")
            return 0
        loaded = Config.load(o.config if o.command == "serve" else o.file)
    except ConfigError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    if o.command == "serve":
        print(f"configuration: {o.config or default_path()}\ndata: {loaded.data_dir()}\npoll interval: {loaded.polling.default_interval_minutes} min")
    else:
        print(json.dumps(dataclasses.asdict(loaded), indent=2))
    return 0


if __name__ == "__main__":
    sys.exit(main())
