"""Settings from the environment: comments cut, quotes taken off, numbers and flags parsed."""

from __future__ import annotations

import os
import re


def text(key: str, default: str = "") -> str:
    """A # begins a comment only at the start or after white space."""
    value = re.sub(r"(?:^|\s)#.*$", "", os.environ.get(key, "")).strip()
    if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
        value = value[1:-1]
    return value or default


def number(key: str, default: int) -> int:
    value = text(key)
    return int(value) if re.fullmatch(r"[+-]?\d+", value) else default


def flag(key: str, default: bool = False) -> bool:
    value = text(key).lower()
    return value in ("1", "true", "yes", "on") if value else default
