"""Configuration: five sections with defaults, a TOML file, environment overrides and validation."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Callable
from dataclasses import dataclass, field, fields
from pathlib import Path
from urllib.parse import urlparse

from .errors import ConfigError

PREFIX = "TIDEWELL"
LOG_LEVELS = ("trace", "debug", "info", "warn", "error")


@dataclass
class Service:
    data_dir: str = "~/.local/share/tidewell"
    log_level: str = "info"


@dataclass
class Polling:
    default_interval_minutes: int = 30
    max_concurrent_fetches: int = 4


@dataclass
class Llm:
    api_base_url: str = "http://localhost:11434"
    model: str = "llama3.2"
    embedding_model: str = "nomic-embed-text"
    embedding_dimensions: int = 768
    max_tokens: int = 2048
    temperature: float = 0.7


@dataclass
class Extraction:
    user_agent: str = "tidewell/0.1"
    request_timeout_seconds: int = 30
    max_article_size_bytes: int = 5 * 1024 * 1024


@dataclass
class Mcp:
    stdio_enabled: bool = True
    sse_enabled: bool = False
    sse_host: str = "127.0.0.1"
    sse_port: int = 8080


@dataclass
class Config:
    service: Service = field(default_factory=Service)
    polling: Polling = field(default_factory=Polling)
    llm: Llm = field(default_factory=Llm)
    extraction: Extraction = field(default_factory=Extraction)
    mcp: Mcp = field(default_factory=Mcp)

    @classmethod
    def from_dict(cls, values: dict) -> Config:
        """Unknown sections and keys are ignored; a value of the wrong type is an error."""
        config = cls()
        for section in fields(cls):
            part = getattr(config, section.name)
            for f in fields(part):
                value = values.get(section.name, {}).get(f.name)
                if value is None:
                    continue
                default = getattr(part, f.name)
                if isinstance(default, float) and isinstance(value, int) and not isinstance(value, bool):
                    value = float(value)
                if type(value) is not type(default):
                    raise ConfigError(f"{section.name}.{f.name}: {value!r} is no {type(default).__name__}")
                setattr(part, f.name, value)
        return config

    @classmethod
    def load(cls, path: str | Path | None = None, env: Callable[[str], str | None] = os.environ.get) -> Config:
        """Reads a file; without a path the default one, which is written first where it is missing."""
        at = Path(path) if path else default_path()
        if path is None and not at.exists():
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_text(template())
        try:
            values = tomllib.loads(at.read_text())
        except (OSError, tomllib.TOMLDecodeError) as e:
            raise ConfigError(str(e)) from e
        config = cls.from_dict(values).override(env)
        config.validate()
        return config

    def override(self, env: Callable[[str], str | None]) -> Config:
        """TIDEWELL_<SECTION>_<KEY>; values that do not parse are left out silently."""
        for section in fields(self):
            part = getattr(self, section.name)
            for f in fields(part):
                text = env(f"{PREFIX}_{section.name}_{f.name}".upper())
                if text is None:
                    continue
                kind = type(getattr(part, f.name))
                try:
                    value = {"true": True, "false": False}[text] if kind is bool else kind(text)
                except (KeyError, ValueError):
                    continue
                if not (kind is int and value < 0):
                    setattr(part, f.name, value)
        return self

    def data_dir(self) -> Path:
        return Path(self.service.data_dir).expanduser()

    def validate(self) -> None:
        url = urlparse(self.llm.api_base_url)
        tests = (
            (not self.data_dir().is_absolute() or any(p.exists() for p in (self.data_dir(), *self.data_dir().parents)), "no ancestor of data_dir exists"),
            (self.service.log_level.lower() in LOG_LEVELS, f"log_level must be one of {', '.join(LOG_LEVELS)}"),
            (self.polling.default_interval_minutes >= 1, "default_interval_minutes must be at least 1"),
            (self.polling.max_concurrent_fetches >= 1, "max_concurrent_fetches must be at least 1"),
            (bool(url.scheme and url.netloc), "api_base_url is no URL"),
            (0 <= self.llm.temperature <= 2, "temperature must lie between 0 and 2"),
            (self.extraction.request_timeout_seconds >= 1, "request_timeout_seconds must be at least 1"),
            (self.extraction.max_article_size_bytes >= 1024, "max_article_size_bytes must be at least 1024"),
            (self.llm.embedding_dimensions > 0, "embedding_dimensions must be above 0"),
            (bool(self.mcp.sse_host), "sse_host must not be empty"),
        )
        for good, message in tests:
            if not good:
                raise ConfigError(message)


def default_path() -> Path:
    return Path(os.environ.get("XDG_CONFIG_HOME", "~/.config")).expanduser() / "tidewell" / "config.toml"


def template() -> str:
    """A file with every key at its default, commented out."""
    lines = ["# Configuration; every key is shown with its default."]
    show = lambda v: f'"{v}"' if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)
    for section in fields(Config):
        part = section.default_factory()
        lines += ["", f"[{section.name}]", *[f"# {f.name} = {show(getattr(part, f.name))}" for f in fields(part)]]
    return "\n".join(lines) + "\n"
