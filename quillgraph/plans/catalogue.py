"""Query catalogue of the algebra over the star universe, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .algebra import check, lower
from .universe import star_universe

#: The star universe in SQL, one row per contract; lists are joined with | where they are returned.
UNIVERSE_SQL = """
  place as (select n_nationkey as nk, r_name || '/' || n_name as place from nation join region on n_regionkey = r_regionkey),
  sup as (select l_orderkey, list_sort(list_distinct(list(s_name))) as supplier_names, list_sort(list_distinct(list(place) filter (place is not null))) as supplier_regions, count(distinct l_suppkey)::int as supplier_count
    from lineitem join supplier on l_suppkey = s_suppkey left join place on s_nationkey = nk group by l_orderkey),
  lines as (select l_orderkey, min(p_brand) as brand, min(p_name) as title, strftime(min(l_shipdate), '%Y-%m-%d') as signed, strftime(max(l_shipdate), '%Y-%m-%d') as period_end,
    floor((epoch(max(l_shipdate)) - epoch(min(l_shipdate))) / 86400)::bigint as days, count(*)::int as n from lineitem left join part on l_partkey = p_partkey group by l_orderkey),
  u as (select 'contract:' || o_orderkey as contract_node_id, 'ocds-' || o_orderkey as ocid, strftime(o_orderdate, '%Y-%m-%d') as release_date, year(o_orderdate)::int as release_year, o_orderpriority as tender_category,
    coalesce(brand, '') as tender_cpv_id, coalesce(title, '') as tender_title, case when isnan(o_totalprice) then null else o_totalprice end as value_amount,
    case o_orderstatus when 'F' then 'award' when 'P' then 'contract' else 'tender' end as value_source, o_orderstatus in ('F', 'P') as value_is_additive,
    coalesce(c_name, '') as buyer_name, list_filter([place], lambda x: x is not null) as buyer_regions, case when c_name is null then 0 else 1 end as buyer_count,
    coalesce(supplier_names, []) as supplier_names, coalesce(supplier_names[1], '') as supplier_name, coalesce(supplier_regions, []) as supplier_regions, coalesce(supplier_count, 0) as supplier_count,
    coalesce(signed, '') as award_date_signed, coalesce(signed, '') <> '' as has_award_signed_date, coalesce(period_end, '') as contract_period_end, days as contract_duration_days, coalesce(n, 0) as evidence_count
    from orders left join customer on o_custkey = c_custkey left join place on c_nationkey = nk left join sup on sup.l_orderkey = o_orderkey left join lines on lines.l_orderkey = o_orderkey)
"""

YEAR = {"field": "release_year", "op": "eq", "value": 1998}
ADDITIVE = {"field": "value_is_additive", "op": "eq", "value": True}
URGENT = {"field": "tender_category", "op": "eq", "value": "1-URGENT"}
BUYER, SUPPLIER = "Customer#000000037", "Supplier#000000007"
OF_BUYER = {"field": "buyer_name", "op": "eq", "value": BUYER}
OF_SUPPLIER = {"field": "supplier_names", "op": "eq", "value": SUPPLIER}


def flt(*preds: dict) -> dict:
    return {"node": "filter", "where": list(preds)}


def grp(of: dict, key: str, field: str | None = None) -> dict:
    return {"node": "groupby", "of": of, "key": key, **({"metric": "sum", "field": field} if field else {"metric": "count"})}


def vals(of: dict, field: str) -> dict:
    return {"node": "values", "of": of, "field": field}


def count(*preds: dict) -> dict:
    return {"node": "count", "of": flt(*preds)}


def total(*preds: dict) -> dict:
    return {"node": "sum", "of": flt(*preds, ADDITIVE), "field": "value_amount"}


def two(node: str, op: str, left: dict, right: dict) -> dict:
    return {"node": node, "op": op, "left": left, "right": right}


def member(field: str, expr: dict, negate: bool = False) -> dict:
    return {"op": "in_expr", "field": field, "expr": expr, **({"negate": True} if negate else {})}


def num(x: float) -> dict:
    return {"node": "num", "value": x}


def extreme(op: str, of: dict) -> dict:
    return {"node": "extreme", "op": op, "of": of, "field": "value_amount"}


_IDS = "select contract_node_id from u where "
_ADD = "sum(value_amount::decimal(38,6))::double"
#: name → (tree, SQL after the universe). Records come out as their ids.
TREES: dict[str, tuple[dict, str]] = {
    "flt_eq": (flt(YEAR, URGENT), _IDS + "release_year = 1998 and tender_category = '1-URGENT'"),
    "flt_in": (flt({"field": "tender_category", "op": "in", "value": ["1-URGENT", "5-LOW"]}), _IDS + "tender_category in ('1-URGENT', '5-LOW')"),
    "flt_in_number": (flt({"field": "release_year", "op": "in", "value": ["1997", 1999]}), _IDS + "release_year in (1997, 1999)"),
    "flt_contains": (flt({"field": "tender_title", "op": "contains", "value": "RED"}), _IDS + "contains(lower(tender_title), 'red')"),
    "flt_exists": (flt({"field": "supplier_name", "op": "exists"}), _IDS + "supplier_name is not null and trim(supplier_name) <> ''"),
    "flt_gte": (flt({"field": "value_amount", "op": "gte", "value": "400000"}), _IDS + "value_amount >= 400000"),
    "flt_lte": (flt({"field": "value_amount", "op": "lte", "value": 5000}), _IDS + "value_amount <= 5000"),
    "flt_between": (flt({"field": "release_year", "op": "gte", "value": 1996}, {"field": "release_year", "op": "lte", "value": 1997}), _IDS + "release_year between 1996 and 1997"),
    "flt_not_missing": (flt({"op": "not", "pred": {"field": "contract_duration_days", "op": "gte", "value": 30}}), _IDS + "not coalesce(contract_duration_days >= 30, false)"),
    "flt_any": (flt({"op": "any", "preds": [URGENT, {"field": "value_amount", "op": "lte", "value": 3000}]}), _IDS + "coalesce(tender_category = '1-URGENT', false) or coalesce(value_amount <= 3000, false)"),
    "flt_strict_not": (flt({"op": "not", "pred": {"field": "supplier_count", "op": "lte", "value": 3}}), _IDS + "not coalesce(supplier_count <= 3, false)"),
    "flt_array_any": (flt(OF_SUPPLIER), _IDS + f"list_contains(supplier_names, '{SUPPLIER}')"),
    "flt_array_contains": (flt({"field": "buyer_regions", "op": "contains", "value": "asia"}), _IDS + "len(list_filter(buyer_regions, lambda x: contains(lower(x), 'asia'))) > 0"),
    "flt_nested_member": (
        flt({"op": "any", "preds": [member("buyer_name", vals(flt(OF_SUPPLIER), "buyer_name")), URGENT]}),
        _IDS + f"buyer_name in (select buyer_name from u where list_contains(supplier_names, '{SUPPLIER}')) or tender_category = '1-URGENT'",
    ),
    "agg_count": (count(YEAR), "select count(distinct contract_node_id)::double as value from u where release_year = 1998"),
    "agg_sum_decimal": (total(YEAR), f"select {_ADD} as value from u where release_year = 1998 and value_is_additive"),
    "agg_exists": ({"node": "exists", "of": flt(OF_BUYER, YEAR)}, f"select count(*) > 0 as value from u where buyer_name = '{BUYER}' and release_year = 1998"),
    "agg_size": ({"node": "size", "of": vals(flt(OF_BUYER), "supplier_names")}, f"select count(distinct s)::double as value from (select unnest(supplier_names) as s from u where buyer_name = '{BUYER}')"),
    "val_distinct": (vals(flt(YEAR, URGENT), "tender_cpv_id"), "select distinct tender_cpv_id as value from u where release_year = 1998 and tender_category = '1-URGENT' and tender_cpv_id <> ''"),
    "select_unique": (
        {"node": "select", "of": flt({"field": "contract_node_id", "op": "eq", "value": "contract:100"}), "field": "buyer_name"},
        "select case when count(distinct buyer_name) = 1 then min(buyer_name) end as value from u where contract_node_id = 'contract:100'",
    ),
    "select_many": (
        {"node": "select", "of": flt(OF_BUYER), "field": "tender_category"},
        f"select case when count(distinct tender_category) = 1 then min(tender_category) end as value from u where buyer_name = '{BUYER}'",
    ),
    "extreme_max": (extreme("argmax", flt(YEAR)), "select contract_node_id as value from u where release_year = 1998 and value_amount is not null order by value_amount desc, contract_node_id limit 1"),
    "extreme_min": (extreme("argmin", flt(YEAR, ADDITIVE)), "select contract_node_id as value from u where release_year = 1998 and value_is_additive and value_amount is not null order by value_amount, contract_node_id limit 1"),
    "extreme_rows_ties": ({"node": "extreme_rows", "op": "argmax", "of": flt(YEAR), "field": "supplier_count"}, _IDS + "release_year = 1998 and supplier_count = (select max(supplier_count) from u where release_year = 1998)"),
    "extreme_rows_date": (
        {"node": "extreme_rows", "op": "argmin", "of": flt(URGENT), "field": "award_date_signed"},
        _IDS + "tender_category = '1-URGENT' and award_date_signed = (select min(award_date_signed) from u where tender_category = '1-URGENT' and award_date_signed <> '')",
    ),
    "grp_count": (grp(flt(), "tender_category"), "select tender_category as key, count(distinct contract_node_id)::double as val from u where trim(tender_category) <> '' group by 1"),
    "grp_sum": (grp(flt(ADDITIVE), "release_year", "value_amount"), "select release_year::varchar as key, sum(coalesce(value_amount, 0)::decimal(38,6))::double as val from u where value_is_additive group by 1"),
    "grp_argmax": ({"node": "argext", "op": "argmax", "of": grp(flt(YEAR), "buyer_name")}, "select buyer_name as value from u where release_year = 1998 and buyer_name <> '' group by 1 order by count(*) desc, 1 limit 1"),
    "grp_argmin": ({"node": "argext", "op": "argmin", "of": grp(flt(), "tender_cpv_id")}, "select tender_cpv_id as value from u where tender_cpv_id <> '' group by 1 order by count(*), 1 limit 1"),
    "top_k_count": (
        {"node": "top", "k": 3, "of": grp(flt(YEAR, ADDITIVE), "buyer_name")},
        "select row_number() over (order by count(*) desc, buyer_name)::int as rank, buyer_name as key, count(*)::double as val from u where release_year = 1998 and value_is_additive and buyer_name <> '' group by buyer_name order by 1 limit 3",
    ),
    "top_k_sum": (
        {"node": "top", "k": 5, "of": grp(flt(ADDITIVE), "supplier_name", "value_amount")},
        f"select row_number() over (order by {_ADD} desc, supplier_name)::int as rank, supplier_name as key, {_ADD} as val from u where value_is_additive and supplier_name <> '' group by supplier_name order by 1 limit 5",
    ),
    "keys_where": ({"node": "keys_where", "op": "ge", "value": 12, "of": grp(flt(), "buyer_name")}, "select buyer_name as value from u where buyer_name <> '' group by 1 having count(*) >= 12"),
    "set_union": (two("setop", "union", vals(flt(OF_BUYER), "tender_cpv_id"), vals(flt(OF_SUPPLIER), "tender_cpv_id")), f"select distinct tender_cpv_id as value from u where tender_cpv_id <> '' and (buyer_name = '{BUYER}' or list_contains(supplier_names, '{SUPPLIER}'))"),
    "set_intersect": (
        two("setop", "intersect", vals(flt(YEAR), "buyer_name"), vals(flt(OF_SUPPLIER), "buyer_name")),
        f"select buyer_name as value from u where release_year = 1998 and buyer_name <> '' intersect select buyer_name from u where list_contains(supplier_names, '{SUPPLIER}')",
    ),
    "set_difference": (
        two("setop", "difference", vals(flt(), "buyer_name"), vals(flt(URGENT), "buyer_name")),
        "select buyer_name as value from u where buyer_name <> '' except select buyer_name from u where tender_category = '1-URGENT'",
    ),
    "division_universal": (
        two("setop", "difference", vals(flt(YEAR), "buyer_name"), vals(flt(YEAR, {"op": "not", "pred": ADDITIVE}), "buyer_name")),
        "select buyer_name as value from u where release_year = 1998 and buyer_name <> '' group by 1 having bool_and(value_is_additive)",
    ),
    "semi_in_expr": (flt(member("buyer_name", vals(flt(OF_SUPPLIER), "buyer_name"))), _IDS + f"buyer_name in (select buyer_name from u where list_contains(supplier_names, '{SUPPLIER}'))"),
    "anti_in_expr": (flt(member("buyer_name", vals(flt(OF_SUPPLIER), "buyer_name"), True)), _IDS + f"not exists (select 1 from u v where list_contains(v.supplier_names, '{SUPPLIER}') and v.buyer_name = u.buyer_name)"),
    "three_hop_count": (
        count(member("buyer_name", vals(flt(member("supplier_name", vals(flt(OF_BUYER), "supplier_name"))), "buyer_name"))),
        f"select count(*)::double as value from u where buyer_name in (select buyer_name from u where supplier_name in (select supplier_name from u where buyer_name = '{BUYER}' and supplier_name <> ''))",
    ),
    "compare_two": (two("combine", "gt", count(OF_BUYER), count(OF_SUPPLIER)), f"select (select count(*) from u where buyer_name = '{BUYER}') > (select count(*) from u where list_contains(supplier_names, '{SUPPLIER}')) as value"),
    "comb_gt": (two("combine", "gt", total(YEAR), num(1e7)), "select sum(value_amount) > 1e7 as value from u where release_year = 1998 and value_is_additive"),
    "comb_diff": (two("combine", "diff", total(YEAR), total(URGENT)), f"select ((select sum(value_amount::decimal(38,6)) from u where release_year = 1998 and value_is_additive) - (select sum(value_amount::decimal(38,6)) from u where tender_category = '1-URGENT' and value_is_additive))::double as value"),
    "comb_add": (two("combine", "add", count(YEAR), num(2.5)), "select count(*) + 2.5::double as value from u where release_year = 1998"),
    "comb_ratio": (two("combine", "ratio", total(YEAR), count(YEAR, ADDITIVE)), f"select {_ADD} / count(*) as value from u where release_year = 1998 and value_is_additive"),
    "vcompare_date": (
        {"node": "vcompare", "op": "gt", "normalize": "date", "value": "1997-01-01", "of": {"node": "select", "of": flt({"field": "contract_node_id", "op": "eq", "value": "contract:100"}), "field": "award_date_signed"}},
        "select substr(min(award_date_signed), 1, 10) > '1997-01-01' as value from u where contract_node_id = 'contract:100'",
    ),
}

_G = "(select tender_cpv_id as key, count(*)::double as l from u where release_year = 1997 and tender_cpv_id <> '' group by 1) a full join (select tender_cpv_id as key, count(*)::double as r from u where release_year = 1998 and tender_cpv_id <> '' group by 1) b using (key)"
for _op, _x in (("gt", "case when coalesce(l, 0) > coalesce(r, 0) then 1.0 else 0.0 end::double"), ("diff", "coalesce(l, 0) - coalesce(r, 0)"), ("ratio", "coalesce(l, 0) / r")):
    TREES[f"gcombine_{_op}"] = (
        two("gcombine", _op, grp(flt({"field": "release_year", "op": "eq", "value": 1997}), "tender_cpv_id"), grp(flt(YEAR), "tender_cpv_id")),
        f"select key, {_x} as val from {_G}" + (" where coalesce(r, 0) <> 0" if _op == "ratio" else ""),
    )

#: Named sub-queries whose values restrict an outer query: name → (where, projected field, restricted field).
BRIDGES = {
    "suppliers_of_buyer": ([OF_BUYER], "supplier_name", "supplier_name", f"buyer_name = '{BUYER}'"),
    "buyers_of_supplier": ([{"field": "supplier_name", "op": "eq", "value": SUPPLIER}], "buyer_name", "buyer_name", f"supplier_name = '{SUPPLIER}'"),
    "suppliers_for_cpv": ([{"field": "tender_cpv_id", "op": "eq", "value": "Brand#11"}], "supplier_name", "supplier_name", "tender_cpv_id = 'Brand#11'"),
    "cpvs_of_buyer": ([OF_BUYER], "tender_cpv_id", "tender_cpv_id", f"buyer_name = '{BUYER}'"),
    "suppliers_in_year_category": ([YEAR, URGENT], "supplier_name", "supplier_name", "release_year = 1998 and tender_category = '1-URGENT'"),
    "buyers_in_category": ([URGENT], "buyer_name", "buyer_name", "tender_category = '1-URGENT'"),
}
for _name, (_where, _field, _into, _sql) in BRIDGES.items():
    TREES[f"bridge_{_name}"] = (
        {"node": "top", "k": 10, "of": grp(flt(YEAR, member(_into, vals(flt(*_where), _field))), "buyer_name")},
        f"select row_number() over (order by count(*) desc, buyer_name)::int as rank, buyer_name as key, count(*)::double as val from u where release_year = 1998 and buyer_name <> ''"
        f" and {_into} in (select {_field} from u where {_sql} and {_field} <> '') group by buyer_name order by 1 limit 10",
    )


def _query(tree: dict) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = lower(tree, star_universe(spark, d))
        kind = check(tree)
        return df.select("contract_node_id") if kind == "RECORDS" else df.select("value") if "status" in df.columns else df

    return run


def universe_build(spark: SparkSession, d: str) -> DataFrame:
    """The whole universe, lists joined with |."""
    u = star_universe(spark, d)
    return u.df.select(*[F.array_join(c, "|").alias(c) if u.is_array(c) else F.col(c) for c in u.df.columns])


_LISTS = ("buyer_regions", "supplier_names", "supplier_regions")
QUERIES = {"universe_build": universe_build, **{k: _query(t) for k, (t, _) in TREES.items()}}
SQL = {
    "universe_build": f"with {UNIVERSE_SQL} select * replace ({', '.join(f'array_to_string({c}, {chr(39)}|{chr(39)}) as {c}' for c in _LISTS)}) from u",
    **{k: f"with {UNIVERSE_SQL} {s}" for k, (_, s) in TREES.items()},
}
