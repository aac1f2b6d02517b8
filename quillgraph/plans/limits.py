"""Ceilings of an interactive request; the engine itself has none."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Limits:
    # fixed values: default ceilings
    upload_max_file_bytes: int = 8 << 20
    upload_max_files: int = 10
    upload_max_total_bytes: int = 8 << 20
    analyze_max_patents: int = 20_000
    analyze_max_body_bytes: int = 8 << 20


@dataclass(frozen=True)
class Refusal:
    status: int
    reason: str


def positive(raw: str | None, default: int) -> int:
    """A positive number, rounded down; anything else leaves the default, so that no typo lifts a ceiling."""
    try:
        value = float(raw) if raw and raw.strip() else 0.0
    except ValueError:
        return default
    return int(value) if 0 < value < float("inf") and int(value) > 0 else default


def from_env(env: Mapping[str, str]) -> Limits:
    """Each ceiling from the variable of its name in upper case."""
    return Limits(**{f.name: positive(env.get(f.name.upper()), f.default) for f in fields(Limits)})


def check_upload(files: list[tuple[str, int]], limits: Limits = Limits()) -> Refusal | None:  # noqa: B008
    """The first reason to refuse files (name, bytes), or None."""
    if not files:
        return Refusal(400, "no file")
    if len(files) > limits.upload_max_files:
        return Refusal(413, f"{len(files)} files; at most {limits.upload_max_files}")
    for name, size in files:
        if not name.lower().endswith(".xlsx"):
            return Refusal(400, f"{name}: not an .xlsx file")
        if size == 0:
            return Refusal(400, f"{name}: empty")
        if size > limits.upload_max_file_bytes:
            return Refusal(413, f"{name}: {size} bytes; at most {limits.upload_max_file_bytes}")
    total = sum(s for _, s in files)
    return Refusal(413, f"{total} bytes together; at most {limits.upload_max_total_bytes}") if total > limits.upload_max_total_bytes else None


def check_analysis(n_patents: int, body_bytes: int, limits: Limits = Limits()) -> Refusal | None:  # noqa: B008
    """Too many patents are refused, never cut off."""
    if n_patents < 1:
        return Refusal(400, "no patents")
    if n_patents > limits.analyze_max_patents:
        return Refusal(413, f"{n_patents} patents; at most {limits.analyze_max_patents}")
    return Refusal(413, f"{body_bytes} bytes; at most {limits.analyze_max_body_bytes}") if body_bytes > limits.analyze_max_body_bytes else None
