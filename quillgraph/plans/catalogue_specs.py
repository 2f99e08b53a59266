"""Queries of the spec language, chains, graph plans and the SQL subset over the star universe, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .algebra import check, lower
from .catalogue import BUYER, SUPPLIER, UNIVERSE_SQL
from .multihop import SLOTS, Decomposition, GraphPlan, Step, Variable, compile_graph, plan_frame
from .queryspec import Constraint, QuerySpec, answer_frame, ground
from .sqlsubset import translate
from .universe import star_universe

Y98, URGENT = Constraint("year", "eq", "1998"), Constraint("category", "eq", "1-URGENT")
OF_BUYER = Constraint("buyer", "eq", BUYER)

_ADD = "sum(value_amount::decimal(38,6))"
#: name → (spec, SQL). One-row answers come out as n, answer.
SPECS: dict[str, tuple[QuerySpec, str]] = {
    "spec_count": (QuerySpec("count", (Y98, URGENT)), "select count(*) as n, count(*)::varchar as answer from u where release_year = 1998 and tender_category = '1-URGENT'"),
    "spec_sum_guarded": (QuerySpec("sum", (Y98,), "value"), f"select count(*) as n, {_ADD}::varchar as answer from u where release_year = 1998 and value_is_additive"),
    "spec_date_eq": (QuerySpec("count", (Constraint("award_date", "eq", "3 March 1998"),)), "select count(*) as n, count(*)::varchar as answer from u where contains(award_date_signed, '1998-03-03')"),
    "spec_between": (QuerySpec("count", (Constraint("value", "between", [1000, 90000.5]), Constraint("year", "gte", 1997))), "select count(*) as n, count(*)::varchar as answer from u where value_amount between 1000 and 90000.5 and release_year >= 1997"),
    "spec_argmax": (QuerySpec("argmax", (Y98,), "buyer_name", sort_field="value"), "select (select count(*) from u where release_year = 1998) as n, buyer_name as answer from u where release_year = 1998 order by value_amount desc, contract_node_id limit 1"),
    "spec_argmin_non_zero": (
        QuerySpec("argmin", (Constraint("supplier_count", "lte", 1),), "contract_node_id", sort_field="supplier_count", options={"exclude_zero": True}),
        "select (select count(*) from u where supplier_count <= 1) as n, contract_node_id as answer from u where supplier_count <= 1 and supplier_count <> 0 order by supplier_count, contract_node_id limit 1",
    ),
    "spec_distinct_set": (QuerySpec("distinct_set", (OF_BUYER,), "cpv"), f"select distinct tender_cpv_id as value from u where buyer_name = '{BUYER}' and tender_cpv_id <> ''"),
    "spec_distinct_list": (QuerySpec("set", (OF_BUYER,), "supplier_names"), f"select distinct s as value from (select unnest(supplier_names) as s from u where buyer_name = '{BUYER}') where s <> ''"),
    "spec_top_k_count": (
        QuerySpec("top_k", (Y98,), options={"group_by": "supplier", "k": 4}),
        "select row_number() over (order by count(*) desc, supplier_name)::int as rank, supplier_name as key, count(*)::double as val from u where release_year = 1998 and supplier_name <> '' group by supplier_name order by 1 limit 4",
    ),
    "spec_top_k_sum": (
        QuerySpec("top_k", (URGENT,), options={"group_by": "buyer", "k": 3, "metric": "sum"}),
        f"select row_number() over (order by {_ADD} desc, buyer_name)::int as rank, buyer_name as key, {_ADD}::double as val from u where tender_category = '1-URGENT' and value_is_additive group by buyer_name order by 1 limit 3",
    ),
    "spec_select_unique": (QuerySpec("select_unique", (Constraint("contract_node_id", "eq", "contract:77"),), "buyer"), "select count(*) as n, min(buyer_name) as answer from u where contract_node_id = 'contract:77'"),
    "spec_predicate_sum": (
        QuerySpec("predicate", (OF_BUYER,), options={"subject": "sum", "comparator": "gt", "threshold": 1e6, "threshold_type": "number"}),
        f"select count(*) as n, {_ADD}::varchar as answer from u where buyer_name = '{BUYER}' and value_is_additive",
    ),
    "spec_dedupe_buyer": (QuerySpec("count", (Y98,), dedupe_key="buyer"), "select count(distinct buyer_name) as n, count(distinct buyer_name)::varchar as answer from u where release_year = 1998 and trim(buyer_name) <> ''"),
}

_HOP1 = Step("suppliers", QuerySpec("set", (Constraint("buyer_name", "eq", BUYER),)), "supplier_name")
_HOP2 = Step("buyers", QuerySpec("set"), "buyer_name", (("supplier_name", "suppliers"),))
_S1 = f"select supplier_name from u where buyer_name = '{BUYER}' and supplier_name <> ''"
_S2 = f"select buyer_name from u where supplier_name in ({_S1}) and buyer_name <> ''"
CHAINS: dict[str, tuple[Decomposition, str]] = {
    "chain_two_hop_sum": (
        Decomposition((_HOP1, Step("answer", QuerySpec("sum", (Y98,), "value_amount"), binds=(("supplier_name", "suppliers"),)))),
        f"select count(*) as n, {_ADD}::varchar as answer from u where release_year = 1998 and value_is_additive and supplier_name in ({_S1})",
    ),
    "chain_three_hop_count": (
        Decomposition((_HOP1, _HOP2, Step("answer", QuerySpec("count"), binds=(("buyer_name", "buyers"),)))),
        f"select count(*) as n, count(*)::varchar as answer from u where buyer_name in ({_S2})",
    ),
    "chain_list_bind": (
        Decomposition((Step("mine", QuerySpec("set", (Constraint("buyer_name", "eq", BUYER),)), "supplier_names"), Step("answer", QuerySpec("count"), binds=(("supplier_names", "mine"),)))),
        f"select count(*) as n, count(*)::varchar as answer from u where list_has_any(supplier_names, (select list(distinct s) from (select unnest(supplier_names) as s from u where buyer_name = '{BUYER}')))",
    ),
}

GRAPHS: dict[str, tuple[GraphPlan, str]] = {
    "graph_bridge_set": (
        GraphPlan(
            (Variable("a", "record_set", filters=(("buyer", BUYER),)), Variable("s", "entity_set", "supplier", depends_on=("a",)), Variable("b", "record_set", filters=(("year", 1998),), depends_on=("s",))),
            "distinct_set", input="b", field="buyer_name",
        ),
        f"select distinct buyer_name as value from u where release_year = 1998 and buyer_name <> '' and supplier_name in (select supplier_name from u where contract_node_id in (select contract_node_id from u where buyer_name = '{BUYER}'))",
    ),
    "graph_refilter_fold": (
        GraphPlan(
            (Variable("a", "record_set", filters=(("year", 1998),)), Variable("s", "entity_set", "supplier", depends_on=("a",)), Variable("t", "entity_set", "supplier", filters=(("category", "1-URGENT"),), depends_on=("s",)),
             Variable("b", "record_set", depends_on=("t",))),
            "count", input="b",
        ),
        "select count(*) as n, count(*)::varchar as answer from u where supplier_name in (select supplier_name from u where release_year = 1998 and tender_category = '1-URGENT' and supplier_name <> '')",
    ),
}

STATEMENTS = {
    "count": "select count(*) from u where release_year = 1998 and tender_category = '1-URGENT'",
    "count_distinct": "select count(distinct buyer_name) from u where value_amount > 300000",
    "sum": "select sum(value_amount) from u where release_year between 1996 and 1997",
    "avg": "select avg(value_amount) from u where tender_category in ('1-URGENT', '2-HIGH')",
    "max": "select max(value_amount) from u where release_year = 1999",
    "min": "select min(value_amount) from u where release_year <> 1999",
    "distinct": "select distinct tender_category from u where award_date_signed is not null",
    "group_top": "select buyer_name from u group by buyer_name order by count(*) desc limit 5",
    "group_one": "select tender_cpv_id from u where tender_cpv_id is not null group by tender_cpv_id order by sum(value_amount) desc limit 1",
    "having": "select buyer_name from u where release_year >= 1998 group by buyer_name having count(*) >= 8",
    "difference": "select (select count(*) from u where release_year = 1998) - (select count(*) from u where release_year = 1997)",
    "greater": "select (select sum(value_amount) from u where release_year = 1998) > (select sum(value_amount) from u where release_year = 1997)",
    "order_limit": "select buyer_name from u where release_year = 1998 order by value_amount desc limit 1",
    "member": f"select distinct buyer_name from u where supplier_name in (select supplier_name from u where buyer_name = '{BUYER}')",
}
_STATEMENT_SQL = {
    "count": "select count(*)::double as value from u where release_year = 1998 and tender_category = '1-URGENT'",
    "count_distinct": "select count(distinct buyer_name)::double as value from u where not coalesce(value_amount <= 300000, false) and buyer_name <> ''",
    "sum": f"select {_ADD}::double as value from u where release_year between 1996 and 1997",
    "avg": f"select {_ADD}::double / count(value_amount) as value from u where tender_category in ('1-URGENT', '2-HIGH')",
    "max": None,
    "min": None,
    "distinct": "select distinct tender_category as value from u where trim(award_date_signed) <> ''",
    "group_top": "select row_number() over (order by count(*) desc, buyer_name)::int as rank, buyer_name as key, count(*)::double as val from u where buyer_name <> '' group by buyer_name order by 1 limit 5",
    "group_one": f"select tender_cpv_id as value from u where tender_cpv_id <> '' group by 1 order by {_ADD} desc, 1 limit 1",
    "having": "select buyer_name as value from u where release_year >= 1998 and buyer_name <> '' group by 1 having count(*) >= 8",
    "difference": "select ((select count(*) from u where release_year = 1998) - (select count(*) from u where release_year = 1997))::double as value",
    "greater": f"select (select {_ADD} from u where release_year = 1998) > (select {_ADD} from u where release_year = 1997) as value",
    "order_limit": "select distinct buyer_name as value from u where release_year = 1998 and value_amount = (select max(value_amount) from u where release_year = 1998)",
    "member": f"select distinct buyer_name as value from u where buyer_name <> '' and supplier_name in ({_S1})",
}


def _shown(df: DataFrame) -> DataFrame:
    """One-row answers without what only the statuses need."""
    return df.select("n", "answer") if "answer" in df.columns else df


def _spec(spec: QuerySpec) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        u = star_universe(spark, d)
        return _shown(answer_frame(ground(spec, u).spec, u))

    return run


def _chain(plan: Decomposition) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: _shown(plan_frame(plan, star_universe(spark, d)))


def _graph(plan: GraphPlan) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        u = star_universe(spark, d)
        g, constraints = compile_graph(plan, u)
        return _shown(answer_frame(ground(QuerySpec(g.operation, constraints[g.input], g.field, options=g.options), u).spec, u))

    return run


def _statement(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        tree = translate(sql)
        df = lower(tree, star_universe(spark, d))
        # An extreme value comes out as text; as a number it does not depend on how text shows it.
        if check(tree) == "VALUES" and tree.get("field") == "value_amount":
            return df.select(F.col("value").cast("double").alias("value"))
        return df.select("value") if "status" in df.columns else df

    return run


_STATEMENT_SQL["max"] = "select max(value_amount) as value from u where release_year = 1999"
_STATEMENT_SQL["min"] = "select min(value_amount) as value from u where not coalesce(release_year = 1999, false)"

QUERIES = {
    **{k: _spec(s) for k, (s, _) in SPECS.items()}, **{k: _chain(p) for k, (p, _) in CHAINS.items()}, **{k: _graph(p) for k, (p, _) in GRAPHS.items()},
    **{f"sql_subset_{k}": _statement(s) for k, s in STATEMENTS.items()},
}
SQL = {
    **{k: f"with {UNIVERSE_SQL} {s}" for d in (SPECS, CHAINS, GRAPHS) for k, (_, s) in d.items()},
    **{f"sql_subset_{k}": f"with {UNIVERSE_SQL} {s}" for k, s in _STATEMENT_SQL.items()},
}
