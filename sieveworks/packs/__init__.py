"""Rules that come with the engine; each has a text that breaks it and one that does not."""

from __future__ import annotations

import json
from pathlib import Path

from sieveworks.operators.scan import Rule

PATH = Path(__file__).with_name("core.json")


def core() -> list[dict]:
    return json.loads(PATH.read_text(encoding="utf-8"))


def rules(category: str | None = None) -> list[Rule]:
    return [Rule(r["check_id"], r["pattern"], r["name"], "problem", r["severity"], r["category"], r["file_pattern"], r["suggestion"]) for r in core() if category in (None, r["category"])]
