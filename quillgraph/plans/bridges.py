"""Named sub-queries that restrict an outer query: the values a set of records gives for one field."""

from __future__ import annotations

from dataclasses import dataclass

from .queryspec import ALIASES, Constraint, QuerySpec

# The names under which plans call them. A name says what is given and by which parameters it is found.
NAMES = ("suppliers_of_buyer", "buyers_of_supplier", "suppliers_for_cpv", "cpvs_of_buyer", "suppliers_in_year_category", "buyers_in_category")


@dataclass(frozen=True)
class Bridge:
    """What a sub-query gives, and the field each of its parameters restricts."""

    gives: str
    by: dict[str, str]

    @classmethod
    def named(cls, name: str) -> Bridge:
        """`<things>_<of, for or in>_<parameters>`, each word an alias of a field."""
        things, _, parameters = name.split("_", 2)
        return cls(ALIASES[things.removesuffix("s")], {p: ALIASES[p] for p in parameters.split("_")})

    def spec(self, given: dict) -> QuerySpec | None:
        """The set of values for the parameters that are given; None if none is."""
        where = tuple(Constraint(f, "eq", given[p]) for p, f in self.by.items() if given.get(p) not in (None, ""))
        return QuerySpec("set", where, self.gives) if where else None


BRIDGES = {name: Bridge.named(name) for name in NAMES}
