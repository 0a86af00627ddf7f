"""Settings of a corpus: a JSON file, overridden by environment variables, checked."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Config:
    org_id: str
    org_name: str
    base_url: str
    org_short_name: str | None = None
    site_title: str | None = None
    site_tagline: str = ""
    site_url: str = ""
    attachments_since: str | None = None
    meetings_since: str | None = None
    request_delay_ms: int = 1200
    user_agent: str = ""
    max_retries: int = 4
    max_attachment_bytes: int = 50_000_000
    max_attachment_pages: int = 500
    max_text_chars: int = 1_000_000
    ocr_enabled: bool = False
    ocr_min_chars: int = 40
    ocr_max_pages: int = 10

    @property
    def title(self) -> str:
        return self.site_title or f"{self.org_name} Document Search"


OVERRIDES = {"TARNFOLD_ORG_ID": "org_id", "TARNFOLD_USER_AGENT": "user_agent", "TARNFOLD_DELAY_MS": "request_delay_ms", "TARNFOLD_ATTACHMENTS_SINCE": "attachments_since", "TARNFOLD_MEETINGS_SINCE": "meetings_since", "TARNFOLD_OCR": "ocr_enabled"}


def load(path: str | None = None, environ: dict[str, str] | None = None) -> Config:
    """The settings in path (or $TARNFOLD_CONFIG). Raises on unknown or missing ones."""
    env = os.environ if environ is None else environ
    with open(path or env["TARNFOLD_CONFIG"], encoding="utf-8") as f:
        values = json.load(f)
    known = {f.name for f in fields(Config)}
    if wrong := set(values) - known:
        raise ValueError(f"unknown settings: {', '.join(sorted(wrong))}")
    for need in ("org_id", "org_name", "base_url"):
        if not values.get(need):
            raise ValueError(f"{need} must be set")
    c = Config(**values)
    for variable, name in OVERRIDES.items():
        if env.get(variable):
            raw = env[variable]
            c = replace(c, **{name: raw == "1" if name == "ocr_enabled" else int(raw) if name == "request_delay_ms" else raw})
    if c.request_delay_ms < 0:
        raise ValueError("request_delay_ms must not be negative")
    return replace(c, base_url=c.base_url.rstrip("/"))
