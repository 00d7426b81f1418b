"""Run settings: YAML files flattened by one level, and command-line values over them."""

from __future__ import annotations


def flattened(settings: dict) -> dict:
    """One level of nesting joined by `_`; dashes in names become `_`."""
    out = {}
    for name, value in settings.items():
        if isinstance(value, dict):
            out |= {f"{name}_{k}".replace("-", "_"): v for k, v in value.items()}
        else:
            out[name.replace("-", "_")] = value
    return out


def load(path: str) -> dict:
    """Settings of a YAML file on the driver."""
    import yaml

    with open(path) as f:
        return flattened(yaml.safe_load(f) or {})


def merged(defaults: dict, file: dict, explicit: dict) -> dict:
    """Explicit values win over the file's, and these over defaults; unknown names are kept."""
    return {**defaults, **file, **{k: v for k, v in explicit.items() if v is not None}}
