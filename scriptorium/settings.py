"""Frozen settings, checked across fields; unknown keys are refused.

Layers, later ones win: defaults, a YAML mapping, JSON overrides (only the keys allowed), the lines of a dotenv file,
environment variables (``SCRIPTORIUM_`` and the key in capitals; lists are separated by commas), arguments.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace


class SettingsError(ValueError):
    pass


@dataclass(frozen=True)
class Settings:
    include: tuple[str, ...] = ("**/*.md",)
    exclude: tuple[str, ...] = ("**/.trash/**",)
    personal: tuple[str, ...] = ()
    target_tokens: int = 600
    hard_tokens: int = 1000
    fts_top_k: int = 40
    vec_top_k: int = 40
    fusion_top_k: int = 20
    max_per_doc: int = 0
    graph_enabled: bool = True
    graph_siblings: int = 5
    graph_discount: float = 0.5
    graph_slots: int = 2
    rerank: bool = False
    rerank_top_k: int = 30
    final_top_k: int = 8
    web: bool = False
    thin_hits: int = 3
    thin_distance: float = 1.0
    delete_floor: int = 25
    delete_fraction: float = 0.2
    source_url: str = ""
    source_user: str = ""
    source_password: str = ""

    def __post_init__(self) -> None:
        if self.target_tokens > self.hard_tokens:
            raise SettingsError("target_tokens exceeds hard_tokens")
        if self.fusion_top_k > self.fts_top_k + self.vec_top_k:
            raise SettingsError("fusion_top_k exceeds what both arms return")
        if self.rerank and self.rerank_top_k < self.final_top_k:
            raise SettingsError("rerank_top_k is below final_top_k")
        if self.source_url and not self.source_password:
            raise SettingsError("source_url needs source_password")

    def with_(self, **changes) -> Settings:
        unknown = set(changes) - {f.name for f in fields(self)}
        if unknown:
            raise SettingsError(f"unknown settings: {', '.join(sorted(unknown))}")
        return replace(self, **changes)


#: Keys that a running service may override.
OVERRIDABLE = frozenset({"fts_top_k", "vec_top_k", "fusion_top_k", "max_per_doc", "graph_enabled", "graph_siblings", "graph_discount", "graph_slots", "rerank", "rerank_top_k", "final_top_k", "web", "thin_hits", "thin_distance"})


def overrides(text: str | None) -> dict:
    """The allowed keys of a JSON object; anything malformed counts as none."""
    try:
        data = json.loads(text or "{}")
    except ValueError:
        return {}
    return {k: v for k, v in data.items() if k in OVERRIDABLE} if isinstance(data, dict) else {}


PREFIX = "SCRIPTORIUM_"


def dotenv(text: str | None) -> dict[str, str]:
    """The ``KEY=value`` lines of a dotenv file; comments and other lines are skipped, quotes around values dropped."""
    found = {}
    for line in (text or "").splitlines():
        key, mark, value = line.strip().removeprefix("export ").partition("=")
        if mark and key.strip() and not key.startswith("#"):
            value = value.strip()
            found[key.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value
    return found


def from_environment(variables: Mapping[str, str]) -> dict:
    """The settings among environment variables, read as the kind of their default."""
    out = {}
    for f in fields(Settings):
        text = variables.get(PREFIX + f.name.upper())
        if text is None:
            continue
        kind = type(f.default)
        try:
            if kind is bool:
                out[f.name] = {"1": True, "true": True, "yes": True, "on": True, "0": False, "false": False, "no": False, "off": False}[text.strip().lower()]
            else:
                out[f.name] = tuple(p.strip() for p in text.split(",") if p.strip()) if kind is tuple else kind(text)
        except (KeyError, ValueError) as e:
            raise SettingsError(f"{PREFIX}{f.name.upper()} is not a {kind.__name__}") from e
    return out


def load(yaml_text: str | None = None, override_text: str | None = None, *, dotenv_text: str | None = None, environment: Mapping[str, str] | None = None, **arguments) -> Settings:
    import yaml

    data = yaml.safe_load(yaml_text) if yaml_text else {}
    if not isinstance(data, dict):
        raise SettingsError("the configuration is not a mapping")
    lists = {k: tuple(v) if isinstance(v, list) else v for k, v in data.items()}
    return Settings().with_(**(lists | overrides(override_text) | from_environment(dotenv(dotenv_text)) | from_environment(environment or {}) | arguments))
