"""A store's configuration file over the defaults; an unreadable one gives the defaults."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from recordloom.functions.records import Settings


@dataclass(frozen=True)
class Profile:
    """How a search ranks and how much it may give."""

    max_tokens: int = 2000
    types: tuple[str, ...] = ("fact", "decision", "procedure")
    min_confidence: float = 0.7
    relevance: float = 0.4
    confidence: float = 0.3
    recency: float = 0.3


@dataclass(frozen=True)
class Config:
    """All of a configuration file. Retired parts (confidence, stabilisation) are read and have no effect."""

    settings: Settings = Settings()
    profiles: dict[str, Profile] = field(default_factory=lambda: {"default": Profile()})
    engine: str = "fts5"
    embeddings: dict | None = None
    stabilization: dict = field(default_factory=lambda: {"enabled": False, "min_confirmations": 2, "auto_promote_confidence": 0.9})
    stores: tuple[dict, ...] = ()
    repo_search_paths: tuple[str, ...] = ()

    @classmethod
    def read(cls, text: str | None) -> Config:
        """From YAML text; parts that are no mapping of the expected kind keep their defaults."""
        import yaml

        base = cls()
        try:
            data = yaml.safe_load(text or "") or {}
            part = lambda name, kind=dict: data[name] if isinstance(data.get(name), kind) else kind()
            days = {k: int(m[1]) for k, v in part("decay").items() if (m := re.match(r"^(\d+)d$", str(v)))}
            profiles = base.profiles | {name: _profile(p) for name, p in part("profiles").items() if isinstance(p, dict)}
            first = profiles["default"]
            known = {k: v for k, v in part("stabilization").items() if k in base.stabilization and isinstance(v, bool) == (k == "enabled")}
            return cls(
                replace(base.settings, decay_days=base.settings.decay_days | days, relevance=first.relevance, recency=first.recency), profiles,
                part("search").get("engine", base.engine), part("search").get("embeddings"), base.stabilization | known,
                tuple(s for s in part("stores", list) if isinstance(s, dict)), tuple(x for x in part("anchors").get("repo_search_paths") or () if isinstance(x, str)),
            )
        except (yaml.YAMLError, AttributeError, TypeError, ValueError):
            return base


def _profile(said: dict) -> Profile:
    base, ranking = Profile(), said.get("ranking") or {}
    numbers = {k: float(ranking.get(k, getattr(base, k))) for k in ("relevance", "confidence", "recency")}
    return Profile(
        int(said.get("max_tokens", base.max_tokens)), tuple(said.get("types", base.types)),
        float(said.get("min_confidence", base.min_confidence)), **numbers,
    )


def load(text: str | None) -> Settings:
    """The settings alone."""
    return Config.read(text).settings
