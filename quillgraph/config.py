"""Settings of a run, read from a JSON file or one of (indented) `key: value` lines."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    raw_folder: str = "data/raw"
    interim_folder: str = "data/interim"
    graph_folder: str = "data/graph"
    years: tuple[int, ...] = ()
    similarity: float = 0.92
    largest_block: int = 50
    chunk_words: int = 650
    chunk_overlap: int = 80
    partial: bool = False

    @classmethod
    def read(cls, path: str) -> Settings:
        """Settings of a file; names that are not known are refused."""
        with open(path) as f:
            text = f.read()
        if text.lstrip().startswith("{"):
            given = json.loads(text)
        else:
            given = nested(text)
        known = {f.name for f in dataclasses.fields(cls)}
        given = flat(given, known)
        if set(given) - known:
            raise ValueError(f"unknown settings: {sorted(set(given) - known)}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def nested(text: str) -> dict:
    """Indented `key: value` lines as nested dictionaries; `- item` lines below a key are its list."""
    root: dict = {}
    stack: list[tuple[int, dict, str | None]] = [(-1, root, None)]
    for raw in text.splitlines():
        line = raw.split("#")[0].rstrip()
        if not line.strip():
            continue
        depth, word = len(line) - len(line.lstrip()), line.strip()
        while stack[-1][0] >= depth and not (word.startswith("- ") and stack[-1][0] == depth and stack[-1][2]):
            stack.pop()
        if word.startswith("- "):
            _, inside, name = stack[-1]
            held = inside.get(name)
            inside[name] = [*(held if isinstance(held, list) else []), _value(word[2:])]
            continue
        key, _, value = word.partition(":")
        _, inside, name = stack[-1]
        if name is not None:
            if not isinstance(inside.get(name), dict):
                inside[name] = {}
            inside = inside[name]
        inside[key.strip()] = _value(value) if value.strip() else None
        stack.append((depth, inside, key.strip()))
    return root


def flat(given: dict, known: set[str], above: str = "") -> dict:
    """Nested settings under the names that are known: a leaf by its own name or with its sections' names before it."""
    out: dict = {}
    for k, v in given.items():
        path = f"{above}_{k}" if above else k
        if isinstance(v, dict):
            out |= flat(v, known, path)
        else:
            out[path if path in known or k not in known else k] = v
    return out


def _value(v: str):
    v = v.strip()
    return json.loads(v) if _json(v) else v.strip("\"'")


def _json(v: str) -> bool:
    try:
        json.loads(v)
        return True
    except ValueError:
        return False
