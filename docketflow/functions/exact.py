"""Row helpers that run in Python workers: JSON whose numbers must stay as written.

Only a few rows come here. The functions use nothing but each other and the standard library, so
they travel to the workers by value.
"""

from __future__ import annotations

import json
import math

import pandas as pd

# The fields of a movement that have a meaning of their own.
KNOWN_FIELDS = ("codigo", "dataHora", "nome", "orgaoJulgador", "complementosTabelados")
# The key of a page cursor, and what stands for a hidden value.
CURSOR_KEY = "search_after"
HIDDEN_CURSOR = "<cursor-redigido>"
HIDDEN_NUMBER = "<numeroProcesso-observado-redigido>"


def all_finite(value: object) -> bool:
    if isinstance(value, float):
        return math.isfinite(value)
    if isinstance(value, list):
        return all(all_finite(item) for item in value)
    if isinstance(value, dict):
        return all(all_finite(item) for item in value.values())
    return True


def dump_canonical(value: object) -> str:
    """Canonical text of one parsed value; non-finite numbers are an error."""
    if not all_finite(value):
        raise ValueError("non-finite number")
    return json.dumps(value, ensure_ascii=False, allow_nan=False, separators=(",", ":"), sort_keys=True)


def canonical_texts(texts: pd.Series) -> pd.Series:
    """Canonical text per row, None for a missing text and for text that is no JSON."""

    def one(text: str | None) -> str | None:
        if text is None or text != text:
            return None
        try:
            return dump_canonical(json.loads(text))
        except ValueError:
            return None

    return pd.Series([one(text) for text in texts], dtype="object")


def hidden(value: object) -> object:
    """A parsed value without case numbers and cursor values."""
    if isinstance(value, dict):
        return {
            key: [HIDDEN_CURSOR] * len(item) if key == CURSOR_KEY and isinstance(item, list) else hidden(item)
            for key, item in value.items()
        }
    if isinstance(value, list):
        return [hidden(item) for item in value]
    if isinstance(value, str) and len(value) == 20 and value.isascii() and value.isdigit():
        return HIDDEN_NUMBER
    return value


def redacted_texts(texts: pd.Series) -> pd.Series:
    """Canonical text without case numbers and cursor values; None for a missing text and for text that is no JSON."""

    def one(text: str | None) -> str | None:
        if text is None or text != text:
            return None
        try:
            return dump_canonical(hidden(json.loads(text)))
        except ValueError:
            return None

    return pd.Series([one(text) for text in texts], dtype="object")


def movement_parts(
    texts: pd.Series, statuses: pd.Series, normalized: pd.Series, comparable: pd.Series
) -> pd.DataFrame:
    """Content and auxiliary key per movement text, None where there is no text."""
    contents: list[str | None] = []
    keys: list[str | None] = []
    for text, status, instant, comparison in zip(texts, statuses, normalized, comparable):
        if text is None or text != text:
            contents.append(None)
            keys.append(None)
            continue
        movement = json.loads(text)
        content = {name: movement[name] for name in KNOWN_FIELDS if name in movement}
        if isinstance(content.get("complementosTabelados"), list):
            ordered = sorted(content["complementosTabelados"], key=lambda item: dump_canonical(item).encode())
            content["complementosTabelados"] = ordered
        key = None
        if movement.get("codigo") is not None and movement.get("dataHora") is not None:
            fields = {"codigo": movement["codigo"], "dataHora": json.loads(comparison)}
            for name in ("orgaoJulgador", "complementosTabelados"):
                known = name in content
                fields[name] = {"present": True, "value": content[name]} if known else {"present": False}
            key = dump_canonical(fields)
        if "dataHora" in movement:
            content["dataHoraStatus"] = status
            if instant is not None and instant == instant:
                content["dataHoraNormalizada"] = instant
        content["camposExtras"] = {name: value for name, value in movement.items() if name not in KNOWN_FIELDS}
        contents.append(dump_canonical(content))
        keys.append(key)
    return pd.DataFrame({"content": contents, "auxiliary_key": keys}, dtype="object")
