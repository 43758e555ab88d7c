"""Settings from YAML or JSON text with dotted overrides, and tables as LaTeX text."""

from __future__ import annotations

import copy
import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(text: str) -> dict:
    """A mapping from JSON, or from YAML where its library is there."""
    try:
        found = json.loads(text)
    except ValueError:
        import yaml

        found = yaml.safe_load(text)
    if not isinstance(found, dict):
        raise ValueError("settings are no mapping")
    return found


def override(settings: dict, *changes: str) -> dict:
    """A copy with each "a.b=value" applied; the key must exist, and the value is read as JSON or else as text."""
    out = copy.deepcopy(settings)
    for change in changes:
        path, mark, text = change.partition("=")
        *above, last = path.split(".")
        at = out
        for name in above:
            at = at.get(name) if isinstance(at, dict) else None
        if not mark or not isinstance(at, dict) or last not in at:
            raise KeyError(change)
        try:
            at[last] = json.loads(text)
        except ValueError:
            at[last] = text
    return out


def latex_mean_sd(mean: Column, sd: Column, places: int = 2) -> Column:
    """"mean ± sd" in math mode; only the mean where the deviation is null."""
    one, two = f"%.{places}f", f"$%.{places}f \\pm %.{places}f$"
    return F.when(sd.isNull(), F.format_string(f"${one}$", mean)).otherwise(F.format_string(two, mean, sd))


def latex_row(*cells: Column) -> Column:
    return F.concat(F.concat_ws(" & ", *[c.cast("string") for c in cells]), F.lit(" \\\\"))


def frozen_violations(settings: dict, contract: dict, at: str = "") -> list[str]:
    """Paths at which settings differ from a frozen contract: other values, missing keys and keys it does not know."""
    out = []
    for key in sorted({*settings, *contract}):
        path = f"{at}.{key}" if at else key
        if key not in settings:
            out.append(f"{path}: missing")
        elif key not in contract:
            out.append(f"{path}: unknown")
        elif isinstance(settings[key], dict) and isinstance(contract[key], dict):
            out += frozen_violations(settings[key], contract[key], path)
        elif type(settings[key]) is not type(contract[key]) or settings[key] != contract[key]:
            out.append(f"{path}: {settings[key]!r} in place of {contract[key]!r}")
    return out


def option_map(options: list[str]) -> dict[str, str]:
    """NAME=PATH options as a mapping, split at the first equals sign; a blank name or path, or a name given twice, is an error."""
    out: dict[str, str] = {}
    for option in options:
        name, mark, path = (x.strip() for x in option.partition("="))
        if not mark or not name or not path or name in out:
            raise ValueError(f"option {option!r}")
        out[name] = path
    return out


def stage_id(prefix: str, stage: object, identity: object) -> str:
    """prefix and 13 hex digits of the SHA-256 of what a stage is, as compact JSON with sorted keys."""
    import hashlib

    text = json.dumps([stage, identity], sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return f"{prefix}-{hashlib.sha256(text.encode()).hexdigest()[:13]}"
