"""Settings from loose values: nothing raises; what can't be used falls back to its default and is reported."""

from dataclasses import dataclass, field
from urllib.parse import urljoin

from lodestead.functions.urls import normal_url

TIERS = ("retrieval", "small", "standard")


@dataclass
class Config:
    sitemap: str = "/sitemap.xml"
    max_tier: str = "small"
    enrich: str = "idle"
    enrich_pages: int = 25
    max_pages: int = 500
    version: str | None = None
    debug: bool = False
    warnings: list[str] = field(default_factory=list)


def _choice(raw, allowed: tuple[str, ...], default: str, key: str, warnings: list[str]) -> str:
    if raw is None or raw == "":
        return default
    if str(raw).strip().lower() in allowed:
        return str(raw).strip().lower()
    warnings.append(f"{key}: {raw!r} is none of {', '.join(allowed)}; {default!r} holds")
    return default


def _flag(raw, default: bool, key: str, warnings: list[str]) -> bool:
    if raw is None:
        return default
    value = str(raw).strip().lower()
    if value in ("", "true", "1", "yes"):
        return True
    if value in ("false", "0", "no"):
        return False
    warnings.append(f"{key}: {raw!r} is no boolean; {default} holds")
    return default


def _number(raw, default: int, low: int, high: int, key: str, warnings: list[str]) -> int:
    if raw is None or str(raw).strip() == "":
        return default
    try:
        value = float(raw)
    except (TypeError, ValueError):
        value = float("nan")
    if value != value or abs(value) == float("inf") or value != int(value):
        warnings.append(f"{key}: {raw!r} is no whole number; {default} holds")
        return default
    kept = min(high, max(low, int(value)))
    if kept != value:
        warnings.append(f"{key}: {int(value)} is outside {low} to {high}; {kept} holds")
    return kept


def resolve_config(values: dict | None = None, base: str = "http://localhost/", **overrides) -> Config:
    """Config from raw values, with overrides taken as they are."""
    values, c = values or {}, Config()
    raw = values.get("sitemap")
    found = normal_url(str(raw), base) if raw is not None and str(raw).strip() else None
    if raw is not None and str(raw).strip() and found is None:
        c.warnings.append(f"sitemap: {raw!r} is no http(s) URL; the default holds")
    c.sitemap = found or urljoin(base, c.sitemap)
    c.max_tier = _choice(values.get("max_tier"), TIERS, c.max_tier, "max_tier", c.warnings)
    c.enrich = _choice(values.get("enrich"), ("idle", "never"), c.enrich, "enrich", c.warnings)
    c.enrich_pages = _number(values.get("enrich_pages"), c.enrich_pages, 0, 5000, "enrich_pages", c.warnings)
    c.max_pages = _number(values.get("max_pages"), c.max_pages, 1, 5000, "max_pages", c.warnings)
    c.version = (str(values["version"]).strip() or None) if values.get("version") is not None else None
    c.debug = _flag(values.get("debug"), c.debug, "debug", c.warnings)
    for name, value in overrides.items():
        setattr(c, name, value)
    return c


def lower_tier(a: str, b: str) -> str:
    return TIERS[min(TIERS.index(a), TIERS.index(b))]
