"""Settings of a deployment, checked as a whole: every problem is named at once."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

# Least length of the jobs' secret.
SECRET = 32
ADDRESS = re.compile(r"https?://[^\s/?#]+[^\s]*")
FLAG = re.compile(r"SOURCE_([A-Z0-9]+)_ENABLED")


@dataclass(frozen=True)
class Settings:
    """site_url has no slash at its end; sources: those that are named with a flag (the others are on)."""

    site_url: str
    cron_secret: str = field(repr=False)
    sources: Mapping[str, bool] = field(default_factory=dict)

    def on(self, source: str) -> bool:
        return self.sources.get(source.lower(), True)


def read_settings(values: Mapping[str, str]) -> Settings:
    """Settings from names and texts; ValueError with every setting that is missing or wrong, never with a secret's text."""
    url, secret, problems, sources = values.get("SITE_URL", ""), values.get("CRON_SECRET", ""), [], {}
    if not ADDRESS.fullmatch(url):
        problems.append("SITE_URL must be an absolute address")
    if len(secret) < SECRET:
        problems.append(f"CRON_SECRET must have {SECRET} characters or more")
    for name, value in values.items():
        flag = FLAG.fullmatch(name)
        if flag and value not in ("true", "false"):
            problems.append(f"{name} must be true or false")
        elif flag:
            sources[flag[1].lower()] = value == "true"
    if problems:
        raise ValueError("; ".join(problems))
    return Settings(url.rstrip("/"), secret, sources)
