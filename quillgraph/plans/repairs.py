"""What can be told of a candidate tree without its author: variants that mend a common slip, and a score of faults that its execution shows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from .algebra import AlgebraError, check

_NUMBER = re.compile(r"\bhow (?:many|much)\b|\bnumber of\b|\btotal\b|\bsum\b", re.I)
_YES_NO = re.compile(r"^\s*(?:is|are|was|were|did|does|do|has|have|can)\b", re.I)


def rewritten(tree: Any, change: Callable[[dict], dict | None]) -> Any:
    """The tree with every object that `change` gives another one for, from the leaves up."""
    if isinstance(tree, list):
        return [rewritten(x, change) for x in tree]
    if not isinstance(tree, dict):
        return tree
    inner = {k: rewritten(v, change) for k, v in tree.items()}
    return change(inner) or inner


def inclusive(p: dict) -> dict | None:
    """A strict bound on a whole number as the inclusive one that means the same."""
    step = {"gt": ("gte", 1), "lt": ("lte", -1)}.get(p.get("op"))
    whole = isinstance(p.get("value"), int) and not isinstance(p.get("value"), bool)
    return {**p, "op": step[0], "value": p["value"] + step[1]} if step and "field" in p and "node" not in p and whole else None


def in_schema(fields: frozenset[str]) -> Callable[[dict], dict | None]:
    """A field that the schema lacks as the shortest one that begins with its base name."""

    def change(x: dict) -> dict | None:
        name = x.get("field")
        if not isinstance(name, str) or name in fields:
            return None
        near = sorted((f for f in fields if f.startswith(name.split("__")[0])), key=lambda f: (len(f), f))
        return {**x, "field": near[0]} if near else None

    return change


def variants(tree: dict, fields: frozenset[str], answers: tuple[str, ...] = ()) -> Iterator[tuple[str, dict]]:
    """(what was mended, tree) of the well-formed variants: strict bounds, unknown fields, records without an answer column."""
    for name, change in (("bounds", inclusive), ("fields", in_schema(fields))):
        out = rewritten(tree, change)
        if out != tree and _typed(out):
            yield name, out
    mended = rewritten(rewritten(tree, inclusive), in_schema(fields))
    if _typed(mended) == "RECORDS":
        for f in (f for f in answers if f in fields):
            yield f"answer:{f}", {"node": "values", "of": mended, "field": f}


def _typed(tree: Any) -> str | None:
    try:
        return check(tree)
    except AlgebraError:
        return None


@dataclass(frozen=True)
class Outcome:
    """What running a tree showed: the type and value of its answer, and how many records each of its filters matched."""

    kind: str
    answer: Any
    matched: tuple[int, ...] = ()


def faults(tree: dict, outcome: Outcome, question: str, linked: tuple[str, ...] = ()) -> dict[str, int]:
    """Faults with their weights: a filter that matches nothing 3, an empty answer 3, an answer of the wrong kind 2 (a number nobody asked for
    1), an answer that only repeats the question 2, up to two linked columns that the tree does not use 1 each, a zero for a number 1."""
    values = list(outcome.answer) if isinstance(outcome.answer, (list, tuple, set)) else [outcome.answer]
    number, yes_no = bool(_NUMBER.search(question)), bool(_YES_NO.search(question))
    used: set[str] = set()
    rewritten(tree, lambda x: used.add(str(x.get("field", "")).split("__")[0]))
    said = question.casefold()
    repeats = any(len(s := str(v).strip().casefold()) > 3 and s in said for v in values[:3] if v is not None)
    found = {
        "nothing_matched": 3 * any(n == 0 for n in outcome.matched),
        "empty": 3 * all(v is None or str(v).strip() == "" for v in values),
        "kind": 2 * ((number and outcome.kind != "NUMBER") + (yes_no and outcome.kind != "BOOL")) + (not number and not yes_no and outcome.kind == "NUMBER"),
        "repeats_question": 2 * repeats,
        "unused_links": min(2, len({c.split("__")[0] for c in linked} - used)),
        "zero": int(number and bool(values) and str(values[0]) in ("0", "0.0")),
    }
    return {k: int(n) for k, n in found.items() if n}
