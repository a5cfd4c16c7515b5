"""Secrets and credentials, on the driver only: nothing here goes into a plan, a broadcast or a log."""

from __future__ import annotations

import base64
import json
import os
import re
import stat
from collections.abc import Callable


class EnvSecrets:
    def __init__(self, prefix: str = "", environ: dict | None = None):
        self.prefix, self.environ = prefix, os.environ if environ is None else environ

    def get(self, name: str) -> str | None:
        return self.environ.get(self.prefix + re.sub(r"[-\s]", "_", name).upper())


class FileSecrets:
    """A JSON file that only its owner may read and write."""

    def __init__(self, path: str):
        self.path = path

    def _all(self) -> dict:
        try:
            if stat.S_IMODE(os.stat(self.path).st_mode) & 0o077:
                raise PermissionError(f"{self.path} is open to others")
            with open(self.path, encoding="utf-8") as f:
                return json.load(f)
        except FileNotFoundError:
            return {}

    def get(self, name: str) -> str | None:
        return self._all().get(name)

    def names(self) -> list[str]:
        return sorted(self._all())

    def remove(self, name: str) -> bool:
        values = self._all()
        known = values.pop(name, None) is not None
        if known:
            self._write(values)
        return known

    def put(self, name: str, value: str) -> None:
        self._write(self._all() | {name: value})

    def _write(self, values: dict) -> None:
        with os.fdopen(os.open(self.path, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w", encoding="utf-8") as f:
            json.dump(values, f)


class Chain:
    """The first provider that has a secret gives it; ``audit`` hears its name, never its value."""

    def __init__(self, *providers, audit: Callable[[dict], None] | None = None):
        self.providers, self.audit = providers, audit or (lambda _: None)

    def get(self, name: str) -> str | None:
        for p in self.providers:
            value = p.get(name)
            if value is not None:
                self.audit({"kind": "secret-accessed", "secret_name": name, "provider_label": type(p).__name__})
                return value
        return None


def auth_headers(profile: dict, secrets) -> dict[str, str]:
    """Request headers of an api-key, bearer or basic profile."""
    value = secrets.get(profile["secret"])
    if value is None:
        raise KeyError(f"no secret {profile['secret']}")
    kind = profile["type"]
    if kind == "bearer":
        return {"authorization": f"Bearer {value}"}
    if kind == "basic":
        return {"authorization": "Basic " + base64.b64encode(f"{profile['user']}:{value}".encode()).decode()}
    if kind == "api-key":
        return {profile.get("header", "x-api-key").lower(): profile.get("template", "{secret}").replace("{secret}", value)}
    raise ValueError(f"unknown auth {kind}")
