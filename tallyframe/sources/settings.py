"""Run configuration on the driver: defaults, files, environment files and their checks."""

from __future__ import annotations

import json
import re
from copy import deepcopy

#: The sections and their defaults.
DEFAULTS = {
    "budget": {"maxCostUsd": 0.25, "maxLatencyMs": 120_000, "maxCandidates": 2, "maxCompletionTokens": 4_000, "maxRepairRounds": 1},
    "models": {},
    "sampling": {"seedPolicy": "best_effort"},
    "provider": {"allowFallbacks": False, "requireParameters": True, "dataCollection": "deny"},
}
ALIAS = re.compile(r"(^~|/auto$|:)")


def load_settings(path: str | None = None) -> dict:
    """The file's sections merged one level deep over the defaults; anything but objects is refused."""
    out = deepcopy(DEFAULTS)
    if path:
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        if not isinstance(given, dict):
            raise ValueError("the configuration is no object")
        for section, values in given.items():
            if section not in out:
                raise ValueError(f"unknown section {section}")
            if not isinstance(values, dict):
                raise ValueError(f"{section} is no object")
            out[section] |= values
    return out


def settings_problems(settings: dict) -> list[str]:
    """Budget bounds, fixed model names (no router aliases), and the rule that the baselines use the direct model."""
    out = []
    for name, value in settings["budget"].items():
        least = 0 if name == "maxRepairRounds" else 1e-12
        if isinstance(value, bool) or not isinstance(value, int | float) or value != value or value < least:
            out.append(f"budget.{name}")
    models = settings["models"]
    out += [f"models.{k}" for k, v in models.items() for x in (v if isinstance(v, list) else [v]) if not isinstance(x, str) or not x.strip() or ALIAS.search(x)]
    direct = models.get("directModelId")
    out += [f"models.{k}_not_baseline" for k in ("selfReviewModelId", "repeatedModelId") if k in models and models[k] != direct]
    candidates = models.get("candidateModels")
    if candidates is not None and (not isinstance(candidates, list) or len(candidates) != 2 or len(set(candidates)) != 2):
        out.append("models.candidateModels")
    return out


def configs_problem(names: list[str], known: tuple[str, ...]) -> str | None:
    if not names:
        return "empty"
    if set(names) - set(known):
        return "unknown"
    return "repeated" if len(set(names)) != len(names) else None


def parse_env(text: str) -> dict[str, str]:
    """NAME=value lines; comments, blank lines and ``export`` are skipped, quotes are taken off."""
    out = {}
    for line in text.splitlines():
        found = re.fullmatch(r"\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*?)\s*", line)
        if not found:
            continue
        name, value = found.groups()
        if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
            value = value[1:-1]
        else:
            value = re.sub(r"\s+#.*$", "", value)
        out[name] = value
    return out


def parse_pairs(text: str) -> list[tuple[str, str]]:
    """``a:b,c:d`` as pairs of different arms."""
    pairs = [tuple(x.strip() for x in part.split(":")) for part in text.split(",") if part.strip()]
    if any(len(p) != 2 or p[0] == p[1] or not all(p) for p in pairs):
        raise ValueError("pairs are written a:b")
    return pairs  # type: ignore[return-value]
