"""Languages C: chains and graphs of query specs, where a step's set restricts later steps by a semi-join inside one lazy plan."""

from __future__ import annotations

import re
import dataclasses
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import amount_of, iso_day
from .queryspec import Constraint, QuerySpec, Result, answer_frame, execute, ground, matched
from .universe import Universe

MAX_HOPS = 4


@dataclass(frozen=True)
class Step:
    """A query whose distinct `emit` values are a set for later steps, or (emit empty) an answer. `binds`: field → earlier step."""

    name: str
    spec: QuerySpec
    emit: str = ""
    binds: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Decomposition:
    steps: tuple[Step, ...]
    combine: str = "identity"  # or compare_gt
    finals: tuple[str, ...] = ()
    max_hops: int = MAX_HOPS


def emitted(step: Step, u: Universe, sets: dict[str, DataFrame]) -> DataFrame:
    """The distinct values a set step gives, `value`, not computed yet."""
    spec = bound(step, sets)
    v = u.narrow({c.field for c in spec.constraints} | {step.emit})
    df = matched(v, spec.constraints)
    c = F.explode(step.emit) if v.is_array(step.emit) else F.col(step.emit).cast("string")
    return df.select(c.alias("value")).where("value is not null and value <> ''").distinct()


def bound(step: Step, sets: dict[str, DataFrame]) -> QuerySpec:
    """The step's spec with its bindings as constraints."""
    extra = tuple(Constraint(into, "in", visible=False, frame=sets[source]) for into, source in step.binds)
    return replace(step.spec, constraints=step.spec.constraints + extra)


def plan_frame(plan: Decomposition, u: Universe) -> DataFrame:
    """The whole chain as one lazy frame: the answer frame of the last step."""
    sets: dict[str, DataFrame] = {}
    for step in plan.steps:
        if step.emit:
            sets[step.name] = emitted(step, u, sets)
        else:
            last = ground(bound(step, sets), u)
            if not last.ok:
                raise ValueError(last.reason)
            frame = answer_frame(last.spec, u)
    return frame


def execute_decomposition(plan: Decomposition, u: Universe) -> Result:
    """Runs a chain with its statuses: too deep is unsupported, an empty set ends in no_results, an unknown source is an error."""
    if len(plan.steps) > plan.max_hops:
        return Result("unsupported", reason=f"plan depth {len(plan.steps)} exceeds max_hops={plan.max_hops}")
    sets: dict[str, DataFrame] = {}
    answers: dict[str, Any] = {}
    trace: list[dict] = []
    for step in plan.steps:
        for _, source in step.binds:
            if source not in sets:
                return Result("error", reason=f"step '{step.name}' binds unknown or later step '{source}'", checks=tuple(trace))
        if step.emit:
            sets[step.name] = emitted(step, u, sets)
            if not sets[step.name].limit(1).count():
                trace.append({"step": step.name, "status": "no_results"})
                return Result("no_results", reason=f"step '{step.name}' emitted an empty set", checks=tuple(trace))
            trace.append({"step": step.name, "status": "passed"})
            continue
        g = ground(bound(step, sets), u)
        if not g.ok:
            return Result("unsupported", reason=g.reason, checks=tuple(trace))
        r = execute(g.spec, u, with_evidence=False)
        trace.append({"step": step.name, "status": r.status})
        if not r.passed:
            return Result(r.status, reason=f"step '{step.name}': {r.status}", checks=tuple(trace))
        answers[step.name] = r.answer
    finals = plan.finals or (plan.steps[-1].name,)
    if plan.combine == "identity":
        return Result("passed", answers.get(finals[0]), tuple(trace))
    if plan.combine == "compare_gt" and len(finals) == 2:
        a, b = (float(answers[f]) for f in finals)
        return Result("passed", {"answer": a > b, finals[0]: answers[finals[0]], finals[1]: answers[finals[1]]}, tuple(trace))
    return Result("error", reason=f"cannot combine by '{plan.combine}' over {len(finals)} steps", checks=tuple(trace))


# --- graph plans ------------------------------------------------------------------------------------------------------------------------

# Slots of a graph plan and the columns they mean.
SLOTS = {"buyer": "buyer_name", "supplier": "supplier_name", "cpv": "tender_cpv_id", "category": "tender_category", "year": "release_year", "title": "tender_title", "date": "award_date_signed", "record": "contract_node_id"}
_NON_ZERO = re.compile(r"\bnon-?\s?zero\b|\bexcluding zero\b", re.I)


@dataclass(frozen=True)
class Variable:
    """A set of records, a set of one role's values, or a scalar, over filters (slot, value) and the variables it depends on."""

    name: str
    kind: str = "record_set"  # record_set, entity_set, entity, scalar
    role: str = ""
    filters: tuple[tuple[str, Any], ...] = ()
    depends_on: tuple[str, ...] = ()


@dataclass(frozen=True)
class GraphPlan:
    """Variables and what to return: operation, its input (or left and right to compare), field and options."""

    variables: tuple[Variable, ...]
    operation: str
    input: str = ""
    left: Any = ""
    right: Any = ""
    field: str = ""
    question: str = ""
    options: dict[str, Any] = dataclasses.field(default_factory=dict)


class PlanError(ValueError):
    pass


def normalise_graph(g: GraphPlan) -> GraphPlan:
    """Rewrites that keep the meaning: a filter that names a variable is a dependency, empty filters go, zero filters of a non-zero question
    become exclude_zero, an entity with a dependency and no filter is a set, a binding's own anchor is not repeated, a set refiltered in the
    same role is folded into its root, a scalar with one literal is a threshold, a comparison without left compares its input."""
    names = {v.name for v in g.variables}
    options = dict(g.options)
    out: dict[str, Variable] = {}
    for v in g.variables:
        kept, deps = [], list(v.depends_on)
        for slot, value in v.filters:
            s = str(value).strip() if value is not None else ""
            if s in names and s != v.name:
                deps.append(s)
            elif s in ("0", "0.0") and _NON_ZERO.search(g.question):
                options["exclude_zero"] = True
            elif s:
                kept.append(("year" if slot == "date" and re.fullmatch(r"(19|20)\d\d", s) else slot, value))
        kind = "entity_set" if v.kind == "entity" and deps and not kept and g.input != v.name else v.kind
        out[v.name] = replace(v, kind=kind, filters=tuple(kept), depends_on=tuple(dict.fromkeys(d for d in deps if d in names)))
    for name, v in out.items():
        anchors = {(out[d].role, str(x).casefold()) for d in v.depends_on if out[d].kind == "entity_set" for _, x in out[d].filters}
        out[name] = replace(v, filters=tuple(f for f in v.filters if (f[0], str(f[1]).casefold()) not in anchors))
    folded: dict[str, str] = {}
    for name, v in list(out.items()):
        if v.kind != "entity_set" or len(v.depends_on) != 1:
            continue
        parent = out[v.depends_on[0]]
        if parent.kind != "entity_set" or parent.role != v.role:
            continue
        root, seen = parent, set()
        while root.kind != "record_set" and len(root.depends_on) == 1 and root.name not in seen:
            seen.add(root.name)
            root = out[root.depends_on[0]]
        if root.kind == "record_set":
            out[root.name] = replace(root, filters=root.filters + v.filters)
            folded[name] = parent.name

    def to(name: Any) -> Any:
        while name in folded:
            name = folded[name]
        return name

    out = {n: replace(v, depends_on=tuple(dict.fromkeys(to(d) for d in v.depends_on))) for n, v in out.items() if n not in folded}
    left, right = to(g.left), to(g.right)
    sides = []
    for side in (left, right):
        v = out.get(side) if isinstance(side, str) else None
        if g.operation == "compare" and v is not None and v.kind == "scalar" and not v.depends_on and len(v.filters) == 1 and v.filters[0][0] in ("date", "amount", "value", "threshold"):
            side = v.filters[0][1]
            if not any(v.name in w.depends_on for w in out.values()):
                out.pop(v.name)
        sides.append(side)
    if g.operation == "compare" and not sides[0]:
        sides[0] = to(g.input)
    return replace(g, variables=tuple(out.values()), input=to(g.input), left=sides[0], right=sides[1], options=options)


def order_variables(variables: tuple[Variable, ...]) -> list[Variable]:
    """Variables after those they depend on; PlanError for a cycle or an unknown one."""
    by = {v.name: v for v in variables}
    done: list[Variable] = []
    state: dict[str, int] = {}

    def visit(name: str) -> None:
        if name not in by:
            raise PlanError(f"unknown variable '{name}'")
        if state.get(name) == 1:
            raise PlanError(f"cycle through '{name}'")
        if name not in state:
            state[name] = 1
            for d in by[name].depends_on:
                visit(d)
            state[name] = 2
            done.append(by[name])

    for v in variables:
        visit(v.name)
    return done


def variable_constraints(v: Variable, sets: dict[str, tuple[str, DataFrame]]) -> tuple[Constraint, ...]:
    own = tuple(Constraint(SLOTS.get(slot, slot), "eq", value) for slot, value in v.filters)
    return own + tuple(Constraint(sets[d][0], "in", visible=False, frame=sets[d][1]) for d in v.depends_on if d in sets)


def compile_graph(g: GraphPlan, u: Universe) -> tuple[GraphPlan, dict[str, tuple[Constraint, ...]]]:
    """The normalised plan and the constraints of each variable; sets stay lazy frames. A set without any constraint may not be bound."""
    g = normalise_graph(g)
    sets: dict[str, tuple[str, DataFrame]] = {}
    constraints: dict[str, tuple[Constraint, ...]] = {}
    for v in order_variables(g.variables):
        c = constraints[v.name] = variable_constraints(v, sets)
        if any(v.name in w.depends_on for w in g.variables):
            if not c:
                raise PlanError(f"'{v.name}' is bound but has no constraint")
            emit = SLOTS.get(v.role, "contract_node_id") if v.kind == "entity_set" else u.key
            sets[v.name] = (emit, emitted(Step(v.name, QuerySpec("set", c), emit), u, {}))
    return g, constraints


def execute_graph(g: GraphPlan, u: Universe) -> Result:
    """Runs a graph plan; unknown variables and cycles are unsupported."""
    try:
        g, constraints = compile_graph(g, u)
    except PlanError as e:
        return Result("unsupported", reason=str(e))

    def value(side: Any) -> Result:
        if side not in constraints:
            return Result("passed", side)
        spec = ground(QuerySpec(g.options.get("metric", "count"), constraints[side], g.field), u)
        return execute(spec.spec, u, with_evidence=False) if spec.ok else Result("unsupported", reason=spec.reason)

    if g.operation == "compare":
        a, b = value(g.left), value(g.right)
        bad = next((r for r in (a, b) if not r.passed), None)
        if bad:
            return bad
        told = compare_scalars(a.answer, b.answer)
        return Result("passed", told) if told is not None else Result("error", reason="incomparable")
    if g.input not in constraints:
        return Result("unsupported", reason=f"unknown input '{g.input}'")
    v = next(x for x in g.variables if x.name == g.input)
    name = g.field or (SLOTS.get(v.role, "") if v.kind == "entity_set" else "")
    operation = {"select": "select_unique", "distinct": "distinct_set", "min": "argmin", "max": "argmax"}.get(g.operation, g.operation)
    spec = ground(QuerySpec(operation, constraints[g.input], name, options=g.options), u)
    return execute(spec.spec, u, with_evidence=False) if spec.ok else Result("unsupported", reason=spec.reason)


def compare_scalars(a: Any, b: Any) -> bool | None:
    """a > b as ISO days if both are, else as amounts ('GBP 10 million' is one); None if they cannot be compared."""
    x, y = iso_day(str(a)[:10]), iso_day(str(b)[:10])
    if x and y:
        return x > y
    p, q = (float(v) if isinstance(v, (int, float)) else amount_of(str(v)) for v in (a, b))
    return None if p is None or q is None or bool(x) != bool(y) else p > q
