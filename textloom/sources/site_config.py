"""Site configurations in TOML, checked on the driver; secrets are filled in there and never enter a plan."""

from __future__ import annotations

import math
import os
import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

# The actions before a crawl, and the keys each of them takes.
ACTIONS = {"click": {"selector": (str, True)}, "type": {"selector": (str, True), "value": (str, True)}, "wait": {"selector": (str, True), "timeout": (int, False)}, "delay": {"ms": (int, True)}}


class ConfigError(ValueError):
    """A site configuration that can't be used."""


@dataclass
class SiteConfig:
    name: str
    startUrl: str | None = None
    match: list[str] | None = None
    exclude: list[str] | None = None
    preserveQuery: bool | None = None
    settleMs: float | None = None
    recycleTabEvery: int | None = None
    preActions: list[dict] | None = field(default=None)


def _number(v) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def _texts(v) -> bool:
    return isinstance(v, list) and all(isinstance(x, str) for x in v)


_CHECKS = {
    "startUrl": (lambda v: isinstance(v, str), "a string"),
    "exclude": (_texts, "an array of strings"),
    "match": (lambda v: isinstance(v, str) or _texts(v), "a string or an array of strings"),
    "preserveQuery": (lambda v: isinstance(v, bool), "a boolean"),
    "settleMs": (lambda v: _number(v) and math.isfinite(v) and v >= 0, "a non-negative number"),
    "recycleTabEvery": (lambda v: _number(v) and v == int(v) and v >= 1, "a positive integer"),
    "preActions": (lambda v: isinstance(v, list), "an array"),
}


def _action(own, at: str) -> dict:
    if not isinstance(own, dict):
        raise ConfigError(f"{at} must be a table")
    kind = own.get("action")
    if kind not in ACTIONS:
        raise ConfigError(f"{at} has the unknown action {kind!r}; use one of {', '.join(ACTIONS)}")
    keys = ACTIONS[kind]
    if odd := [k for k in own if k != "action" and k not in keys]:
        raise ConfigError(f"{at} ({kind}) has unknown keys: {', '.join(odd)}. Settings of the site belong above the first [[preActions]]; below, TOML counts them to the action")
    out = {"action": kind}
    for key, (of, needed) in keys.items():
        fits = _number(own.get(key)) if of is int else isinstance(own.get(key), of)
        if fits:
            out[key] = own[key]
        elif needed:
            raise ConfigError(f"{at} ({kind}) needs {key}")
    return out


def parse(text: str, where: str = "site config") -> SiteConfig:
    try:
        raw = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(f"{where}: invalid TOML: {e}") from e
    if not isinstance(raw.get("name"), str) or not raw["name"]:
        raise ConfigError(f"{where}: the field name is missing")
    out = SiteConfig(raw["name"])
    for key, (check, what) in _CHECKS.items():
        if key in raw:
            if not check(raw[key]):
                raise ConfigError(f"{where}: {key} must be {what}")
            setattr(out, key, raw[key])
    if isinstance(out.match, str):
        out.match = [out.match]
    if out.preActions is not None:
        out.preActions = [_action(a, f"{where}: preActions[{k}]") for k, a in enumerate(out.preActions)]
    return out


def load(path: str) -> SiteConfig:
    if not Path(path).exists():
        raise ConfigError(f"no site config at {path}")
    return parse(Path(path).read_text(encoding="utf-8"), path)


def resolve_path(name: str, home: str, folder: str = ".") -> str:
    """A path as it is; a bare name in the home's sites, then in the folder's sites; the home's if neither is there."""
    if "/" in name or "\\" in name or Path(name).suffix:
        return name
    options = [Path(home) / "sites" / f"{name}.toml", Path(folder) / "sites" / f"{name}.toml"]
    return str(next((p for p in options if p.exists()), options[0]))


def fill_env(text: str, env: dict | None = None) -> str:
    """$NAME and ${NAME} from the environment; an unset one is an error."""
    env = os.environ if env is None else env

    def value(m: re.Match) -> str:
        name = m[1] or m[2]
        if name not in env:
            raise ConfigError(f"the environment variable {name} is not set")
        return env[name]

    return re.sub(r"\$\{(\w+)\}|\$([A-Za-z_]\w*)", value, text)
