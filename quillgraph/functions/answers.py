"""Whether two answers are the same within the usual tolerances."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from typing import Any

from .dates import iso_day


@dataclass(frozen=True)
class Tolerance:
    """How far numbers may differ, absolutely or relatively, and whether rankings are compared by their names alone."""

    absolute: float = 0.01
    relative: float = 1e-6
    names_only: bool = False


USUAL = Tolerance()
#: For evaluation runs: a millionth, so that small shares tell; rankings by name.
STRICT = Tolerance(absolute=0.0, names_only=True)


def same_number(a: Any, b: Any, within: Tolerance = USUAL) -> bool:
    """Within the absolute or the relative tolerance."""
    x, y = float(a), float(b)
    return abs(x - y) <= max(within.absolute, within.relative * max(abs(x), abs(y)))


def _numeric(x: Any) -> bool:
    if isinstance(x, bool):
        return False
    if isinstance(x, (int, float, Decimal)):
        return True
    try:
        float(x)
        return True
    except (TypeError, ValueError):
        return False


def same_answer(a: Any, b: Any, within: Tolerance = USUAL) -> bool:
    """Numbers within tolerance, days by their date, text without case, sets in any order (a set of one is its member), rankings by their
    keys in order and, unless names alone count, their numbers within tolerance."""
    if isinstance(a, (set, frozenset)):
        a = sorted(a, key=str)
    if isinstance(b, (set, frozenset)):
        b = sorted(b, key=str)
    if isinstance(a, (list, tuple)) and isinstance(b, (list, tuple)):
        if len(a) != len(b):
            return False
        pairs = a and all(isinstance(x, (list, tuple)) and len(x) == 2 for x in (*a, *b))
        if pairs:
            return all(same_answer(x[0], y[0], within) and (within.names_only or same_answer(x[1], y[1], within)) for x, y in zip(a, b))
        return all(same_answer(x, y, within) for x, y in zip(sorted(a, key=lambda x: str(x).casefold()), sorted(b, key=lambda x: str(x).casefold())))
    if isinstance(a, (list, tuple)) or isinstance(b, (list, tuple)):
        one, other = (a, b) if isinstance(a, (list, tuple)) else (b, a)
        return len(one) == 1 and same_answer(one[0], other, within)
    if a is None or b is None or isinstance(a, bool) or isinstance(b, bool):
        return a is b or (isinstance(a, bool) and isinstance(b, bool) and a == b)
    if _numeric(a) and _numeric(b):
        return same_number(a, b, within)
    x, y = str(a).strip().casefold(), str(b).strip().casefold()
    return x == y or (iso_day(x[:10]) is not None and x[:10] == y[:10])
