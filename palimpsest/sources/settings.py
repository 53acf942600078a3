"""Settings of a run: from a file, the environment and flags."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping
from pathlib import Path
from typing import Any

from palimpsest.functions.entities import Switches
from palimpsest.operators.masking import Options
from palimpsest.operators.recognizing import load_or_none, routed
from palimpsest.sources.texts import as_bool, setting

#: Model folders below models_dir, unless set. Fixed values.
MODELS = {"en_model_id": "Xenova/bert-base-NER", "zh_model_id": "Xenova/bert-base-multilingual-cased-ner-hrl"}


def load_settings(path: str | None) -> dict[str, Any]:
    """A YAML or JSON file of settings. No path: none; a path that does not exist is an error."""
    if not path:
        return {}
    text = Path(path).expanduser().read_text(encoding="utf-8")
    if path.endswith(".json"):
        return json.loads(text) or {}
    try:
        import yaml
    except ImportError:
        return _plain_yaml(text)
    return yaml.safe_load(text) or {}


def _plain_yaml(text: str) -> dict[str, Any]:
    """Keys with scalar values, and one level of keys below them: all that settings need where no YAML library is installed."""
    out: dict[str, Any] = {}
    below: dict[str, Any] | None = None
    for number, line in enumerate(text.splitlines(), 1):
        line = line.split(" #")[0].rstrip() if not line.lstrip().startswith("#") else ""
        if not line.strip():
            continue
        key, colon, value = line.strip().partition(":")
        if not colon:
            raise ValueError(f"line {number} has no key")
        value = value.strip()
        scalar: Any = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else {"true": True, "false": False, "null": None, "~": None}.get(value.lower(), value)
        if line[0] in " \t":
            if below is None:
                raise ValueError(f"line {number} is indented below nothing")
            below[key] = scalar
        elif value:
            out[key], below = scalar, None
        else:
            out[key] = below = {}
    return out


def temperature(flag: Any = None, file: Mapping[str, Any] | None = None) -> float:
    value = setting("temperature", flag, file, 0.0, float)
    if not math.isfinite(value):
        raise ValueError(f"no temperature: {value}")
    return value


def options_of(file: Mapping[str, Any], models_dir: str | None = None) -> Options:
    """A masking plan's options: switches, token models by language as far as they are there, address fallback."""
    root = setting("models_dir", models_dir, file)
    models = {key: load_or_none(key, str(Path(root).expanduser() / setting(key, None, file, default))) if root else None for key, default in MODELS.items()}
    found = routed(models["en_model_id"], models["zh_model_id"])
    fallback = setting("address_fallback", None, file, True, as_bool)
    return Options(switches=Switches().patched(file.get("mask_config") or {}), recognizers=found, addresses=bool(found), fallback=fallback)
