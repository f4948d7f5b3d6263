"""A configured rule and its arguments."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any


class RuleError(ValueError):
    """The rule cannot be evaluated: bad arguments, unknown column or dataset."""


@dataclass(frozen=True)
class Rule:
    """One expectation configured for one dataset."""

    rule_config_id: int
    expectation: str
    kwargs: dict[str, Any] = field(default_factory=dict)
    dataset_id: int | None = None
    expectation_id: int | None = None
    severity: str | None = None
    dimension: str | None = None
    column_name: str | None = None
    error_flag: bool = True
    is_active: bool = True

    def config_json(self) -> str:
        return json.dumps(
            {
                "rule_config_id": self.rule_config_id,
                "expectation_name": self.expectation,
                "dataset_id": self.dataset_id,
                "kwargs": self.kwargs,
                "error_flag": self.error_flag,
            },
            default=str,
        )


def parse_kwargs(text: str | None) -> dict[str, Any]:
    """Rule arguments from their JSON text; an empty text means no arguments."""
    if not text:
        return {}
    try:
        value = json.loads(text)
    except json.JSONDecodeError as exc:
        raise RuleError(f"arguments are not valid JSON: {exc}") from exc
    if not isinstance(value, dict):
        raise RuleError("arguments must be a JSON object")
    return value


def require(kwargs: dict[str, Any], *names: str) -> list[Any]:
    missing = [n for n in names if kwargs.get(n) is None]
    if missing:
        raise RuleError(f"required argument missing: {', '.join(missing)}")
    return [kwargs[n] for n in names]


def flag(kwargs: dict[str, Any], name: str, default: bool = False) -> bool:
    """A boolean argument given as bool or as text."""
    value = kwargs.get(name)
    if value is None:
        return default
    if isinstance(value, str):
        return value.strip().lower() in ("true", "t", "yes", "y", "1", "on")
    return bool(value)


def number(kwargs: dict[str, Any], name: str, default: float | None = None):
    """A numeric argument given as number or as text."""
    value = kwargs.get(name)
    if value is None or (isinstance(value, str) and not value.strip()):
        return default
    if isinstance(value, bool):
        raise RuleError(f"{name} must be a number")
    if isinstance(value, (int, float)):
        return value
    try:
        return int(value)
    except (TypeError, ValueError):
        pass
    try:
        return float(value)
    except (TypeError, ValueError) as exc:
        raise RuleError(f"{name} must be a number, got {value!r}") from exc


def mostly(kwargs: dict[str, Any]) -> float:
    return float(number(kwargs, "mostly", 1.0))


def name_list(kwargs: dict[str, Any], name: str) -> list[str]:
    """A list of names given as an array, JSON text or comma-separated text."""
    value = kwargs.get(name)
    if value is None:
        return []
    if isinstance(value, str):
        text = value.strip()
        if text.startswith("["):
            value = json.loads(text)
        else:
            value = [part for part in text.split(",")]
    return [str(v).strip() for v in value if str(v).strip()]


def value_list(kwargs: dict[str, Any], name: str) -> list[Any]:
    """A value set given as an array or as the JSON text of one."""
    (value,) = require(kwargs, name)
    if isinstance(value, str):
        try:
            value = json.loads(value)
        except json.JSONDecodeError as exc:
            raise RuleError(f"{name} is not a JSON array: {exc}") from exc
    if not isinstance(value, list):
        raise RuleError(f"{name} must be an array")
    return value
