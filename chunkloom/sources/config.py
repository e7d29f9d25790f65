"""Configuration files and the stored default context of the command line."""

from __future__ import annotations

import json
import os
import re
import time
from dataclasses import dataclass, field
from pathlib import Path

from chunkloom.operators.rules import CrawlRules

CATALOG = re.compile(r"[a-z0-9]+(?:-[a-z0-9]+)*")
LABEL = re.compile(r"[a-z0-9]+(?:[./=-][a-z0-9]+)*")
HOME_VARIABLE, HOME_FOLDER = "CHUNKLOOM_HOME", ".chunkloom"
RULES_FILE = "chunkloom-crawl.json"


class ConfigError(ValueError):
    pass


def check_catalog(name: str) -> str:
    if not CATALOG.fullmatch(name) or len(name.encode()) > 64:
        raise ConfigError(f"{name!r} is no catalog name: lower-case letters, digits and single hyphens between them, at most 64 bytes")
    return name


def check_label(name: str) -> str:
    if ":" in name:
        raise ConfigError(f"{name!r} holds a colon: give catalog and label separately")
    if not LABEL.fullmatch(name) or len(name.encode()) > 128:
        raise ConfigError(f"{name!r} is no label: lower-case letters, digits and single '.', '/', '-' or '=' between them, at most 128 bytes")
    return name


def strip_comments(text: str) -> str:
    """JSON without ``//``, ``/* */`` and ``#`` comments; those inside strings stay."""
    return re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/|#[^\n]*', lambda m: m[1] or "", text, flags=re.S)


def tool_home() -> Path:
    """The folder of configuration: from the environment, else in the user's home."""
    said = os.environ.get(HOME_VARIABLE, "").strip()
    return Path(said).absolute() if said else Path.home() / HOME_FOLDER


def absolute_path(field_name: str, value: str) -> Path:
    if value.startswith("~") or "$" in value or not Path(value).is_absolute():
        raise ConfigError(f"{field_name} must be an absolute path without '~' and '$': {value!r}")
    return Path(value)


@dataclass
class Config:
    """Catalogs with their repositories, where the database lies, and the model that embeds."""

    catalogs: dict[str, str] = field(default_factory=dict)
    database: Path = field(default_factory=lambda: tool_home() / "default-db")
    model_dir: Path | None = None
    vector_dim: int = 768
    model_instances: int | str = "auto"
    threads_per_instance: int | str = "auto"

    @classmethod
    def load(cls, path: Path) -> Config:
        try:
            data = json.loads(strip_comments(path.read_text()))
        except FileNotFoundError as e:
            raise ConfigError(f"no configuration at {path}") from e
        except ValueError as e:
            raise ConfigError(f"{path} can't be read: {e}") from e
        _fields(data, {"catalogs"}, {"database", "embeddingModel"}, "configuration")
        catalogs = {}
        for name, catalog in data["catalogs"].items():
            _fields(catalog, {"path"}, {"type"}, f"catalog {name!r}")
            catalogs[check_catalog(name)] = str(absolute_path(f"catalogs.{name}.path", catalog["path"]))
        out = cls(catalogs)
        database, model = data.get("database") or {}, data.get("embeddingModel") or {}
        _fields(database, set(), {"path"}, "database")
        _fields(model, set(), {"modelInstances", "threadsPerInstance", "modelDir", "vectorDim"}, "embeddingModel")
        if database.get("path"):
            out.database = absolute_path("database.path", database["path"])
        if model.get("modelDir"):
            out.model_dir = absolute_path("embeddingModel.modelDir", model["modelDir"])
        out.vector_dim = _count(model.get("vectorDim", 768), "vectorDim", auto=False)
        out.model_instances = _count(model.get("modelInstances", "auto"), "modelInstances")
        out.threads_per_instance = _count(model.get("threadsPerInstance", "auto"), "threadsPerInstance")
        return out


def _fields(data: object, needed: set[str], known: set[str], what: str) -> None:
    if not isinstance(data, dict) or not needed <= set(data) <= needed | known:
        raise ConfigError(f"{what}: expected the fields {sorted(needed)}, and at most {sorted(known)} besides")


def _count(value: object, what: str, auto: bool = True) -> int | str:
    if auto and value == "auto":
        return value
    if isinstance(value, int) and not isinstance(value, bool) and value > 0:
        return value
    raise ConfigError(f"{what} must be a positive number" + " or 'auto'" * auto)


def resolve_sizing(config: Config, cores: int, ram: int) -> tuple[int, int]:
    """Instances and threads of each: what is configured, the rest as fits the machine."""
    usable = max(0, ram - max(4 << 30, ram // 4))
    instances = config.model_instances
    if instances == "auto":
        if config.threads_per_instance != "auto":
            instances = max(1, min(max(1, usable // (2560 << 20)), cores // config.threads_per_instance or 1))
        else:
            instances = max(1, min(max(1, usable // (2560 << 20)), 4, cores))
    threads = max(1, cores // instances) if config.threads_per_instance == "auto" else config.threads_per_instance
    return instances, threads


def load_rules(repo: str | None) -> CrawlRules:
    """The repository's rules, else the user's, else the built-in ones; they aren't merged."""
    for path in ([Path(repo) / RULES_FILE] if repo else []) + [tool_home() / "crawl.json"]:
        if path.exists():
            return CrawlRules.from_json(path.read_text())
    return CrawlRules()


@dataclass
class Context:
    catalog: str
    label: str

    @staticmethod
    def path() -> Path:
        return tool_home() / "context.json"

    @classmethod
    def load(cls) -> Context | None:
        """The stored default; None if there is none or it doesn't hold together."""
        try:
            data = json.loads(cls.path().read_text())
            return cls(check_catalog(data["catalog"]), check_label(data["label"]))
        except (OSError, ValueError, KeyError, TypeError):
            return None

    def save(self) -> None:
        self.path().parent.mkdir(parents=True, exist_ok=True)
        self.path().write_text(json.dumps({"catalog": self.catalog, "label": self.label, "set_at": time.strftime("%H:%M:%S", time.gmtime())}, indent=2))


def resolve_context(catalog: str | None, label: str | None) -> Context:
    """What was said, filled up from the stored default."""
    stored = Context.load()
    catalog, label = catalog or (stored and stored.catalog), label or (stored and stored.label)
    if not catalog or not label:
        raise ConfigError("give --catalog and --label, or set defaults with 'use'")
    return Context(check_catalog(catalog), check_label(label))
