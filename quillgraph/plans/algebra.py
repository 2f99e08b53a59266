"""Language A: typed trees over the record universe. Checked first, then lowered to one lazy DataFrame plan."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .universe import Universe

MAX_DEPTH, MAX_NODES = 16, 64
COMPARE = ("gt", "ge", "lt", "le", "eq")
LEAF_PREDICATES = ("eq", "in", "contains", "exists", "gte", "lte")


class AlgebraError(ValueError):
    """A tree that is not well formed: why, and where."""

    def __init__(self, reason: str, path: str = "$") -> None:
        super().__init__(f"{reason} at {path}")
        self.reason, self.path = reason, path


class DataError(ValueError):
    """A well-formed tree whose answer the data do not have."""


def _text(x: Any) -> bool:
    return isinstance(x, str) and x != ""


def _number(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


@dataclass(frozen=True)
class Node:
    """Signature of a node: result type, operand types, and what its own attributes must be (attribute test, reason when it fails)."""

    gives: str
    takes: tuple[tuple[str, str], ...] = ()
    needs: tuple[tuple[Any, str], ...] = ()


def _field(node: str) -> tuple[Any, str]:
    return lambda t: _text(t.get("field")), f"{node}_needs_field"


def _op(node: str, allowed: tuple[str, ...]) -> tuple[Any, str]:
    return lambda t: t.get("op") in allowed, f"{node}_op_invalid"


def _op_named(node: str, allowed: tuple[str, ...]) -> tuple[Any, str]:
    return lambda t: t.get("op") in allowed, f"{node}_op_invalid:{{op}}"


_ENDS = ("argmax", "argmin")
NODES = {
    "filter": Node("RECORDS", (), ((lambda t: isinstance(t.get("where", []), list), "filter_where_not_list"),)),
    "values": Node("VALUES", (("of", "RECORDS"),), (_field("values"),)),
    "count": Node("NUMBER", (("of", "RECORDS"),)),
    "size": Node("NUMBER", (("of", "VALUES"),)),
    "sum": Node("NUMBER", (("of", "RECORDS"),), (_field("sum"),)),
    "exists": Node("BOOL", (("of", "RECORDS"),)),
    "select": Node("VALUE", (("of", "RECORDS"),), (_field("select"),)),
    "extreme_rows": Node("RECORDS", (("of", "RECORDS"),), (_op("extreme_rows", _ENDS), _field("extreme_rows"))),
    "extreme": Node("VALUE", (("of", "RECORDS"),), (_op("extreme", _ENDS), _field("extreme"))),
    "groupby": Node(
        "GROUPS", (("of", "RECORDS"),),
        ((lambda t: _text(t.get("key")), "groupby_needs_key"), (lambda t: t.get("metric", "count") in ("count", "sum"), "groupby_metric_invalid:{metric}"),
         (lambda t: t.get("metric", "count") != "sum" or _text(t.get("field")), "groupby_sum_needs_field")),
    ),
    "argext": Node("VALUE", (("of", "GROUPS"),), (_op("argext", _ENDS),)),
    "top": Node("RANKING", (("of", "GROUPS"),), ((lambda t: isinstance(t.get("k"), int) and 1 <= t["k"] <= 50, "top_k_out_of_range"),)),
    "num": Node("NUMBER", (), ((lambda t: _number(t.get("value")), "num_needs_numeric_value"),)),
    "vcompare": Node(
        "BOOL", (("of", "VALUE"),),
        (_op("vcompare", COMPARE), (lambda t: "value" in t, "vcompare_needs_value"), (lambda t: t.get("normalize") in (None, "date"), "vcompare_normalize_invalid:{normalize}")),
    ),
    "combine": Node("NUMBER", (("left", "NUMBER"), ("right", "NUMBER")), (_op_named("combine", (*COMPARE, "diff", "ratio", "add")),)),
    "setop": Node("VALUES", (("left", "VALUES"), ("right", "VALUES")), (_op_named("setop", ("union", "intersect", "difference")),)),
    "gcombine": Node("GROUPS", (("left", "GROUPS"), ("right", "GROUPS")), (_op_named("gcombine", ("gt", "diff", "ratio")),)),
    "keys_where": Node("VALUES", (("of", "GROUPS"),), (_op("keys_where", COMPARE), (lambda t: "value" in t, "keys_where_needs_value"))),
}


@dataclass(frozen=True)
class Form:
    """What a predicate must be: tests of its attributes, trees it takes, predicates inside it."""

    needs: tuple[tuple[Any, str], ...] = ()
    takes: tuple[tuple[str, str], ...] = ()
    inside: Any = lambda p: ()


_NAMED = (lambda p: _text(p.get("field")), "pred_needs_field")
FORMS = {
    **{op: Form((_NAMED,) if op == "exists" else (_NAMED, (lambda p: "value" in p, "pred_needs_value"))) for op in LEAF_PREDICATES},
    "not": Form(inside=lambda p: ((".pred", p.get("pred")),)),
    "any": Form(((lambda p: isinstance(p.get("preds"), list) and len(p["preds"]) > 1, "any_needs_two_preds"),), inside=lambda p: ((f".preds[{i}]", q) for i, q in enumerate(p["preds"]))),
    "in_expr": Form(((lambda p: _text(p.get("field")), "in_expr_needs_field"),), (("expr", "VALUES"),)),
}


class Checker:
    """Types a tree, counting its nodes."""

    def __init__(self) -> None:
        self.nodes = 0

    def tree(self, t: Any, path: str = "$") -> str:
        self.nodes += 1
        if self.nodes > MAX_NODES:
            raise AlgebraError("tree_too_large", path)
        if path.count(".") > MAX_DEPTH:
            raise AlgebraError("tree_too_deep", path)
        if not isinstance(t, dict):
            raise AlgebraError("node_not_object", path)
        name = t.get("node")
        kind = NODES.get(name) if isinstance(name, str) else None
        if kind is None:
            raise AlgebraError(f"unknown_node:{name}", path)
        for test, reason in kind.needs:
            if not test(t):
                raise AlgebraError(reason.format(op=t.get("op"), metric=t.get("metric"), normalize=t.get("normalize")), path)
        found = [(side, want, self.tree(t.get(side), f"{path}.{side}")) for side, want in kind.takes]
        for side, want, got in found:
            if got != want:
                raise AlgebraError(f"{name}{'' if side == 'of' else '_' + side}_expects_{want}_got_{got}", path)
        if name == "filter":
            for i, p in enumerate(t.get("where", [])):
                self.predicate(p, f"{path}.where[{i}]")
        return "BOOL" if name == "combine" and t["op"] in COMPARE else kind.gives

    def predicate(self, p: Any, path: str) -> None:
        if not isinstance(p, dict):
            raise AlgebraError("pred_not_object", path)
        form = FORMS.get(p["op"]) if isinstance(p.get("op"), str) else None
        if form is None:
            raise AlgebraError(f"unknown_pred_op:{p.get('op')}", path)
        for test, reason in form.needs:
            if not test(p):
                raise AlgebraError(reason, path)
        for side, want in form.takes:
            got = self.tree(p.get(side), f"{path}.{side}")
            if got != want:
                raise AlgebraError(f"{p['op']}_expects_{want}_got_{got}", path)
        for place, inner in form.inside(p):
            self.predicate(inner, path + place)


def check(tree: Any) -> str:
    """The result type of a tree; AlgebraError if it is not well formed."""
    return Checker().tree(tree)


def known(test: Column) -> Column:
    """Two-valued: what cannot be told is false, so its negation is true."""
    return F.coalesce(test, F.lit(False))


def as_number(u: Universe, name: str) -> Column:
    """A column as a finite-or-null double."""
    x = F.col(name) if u.is_number(name) else F.expr(f"try_cast(trim(cast(`{name}` as string)) as double)")
    return F.when(~F.isnan(x.cast("double")), x.cast("double"))


def compare(op: str, a: Column, b: Column) -> Column:
    return {"gt": a > b, "ge": a >= b, "lt": a < b, "le": a <= b, "eq": a == b}[op]


def text_of(u: Universe, name: str) -> Column:
    """A scalar column as a string."""
    return F.col(name).cast("string")


class Plan:
    """Lowers a checked tree. Records, values, groups and rankings are frames; scalars are frames of one row `value, status` whose status
    tells what the data lack (null: nothing)."""

    def __init__(self, universe: Universe) -> None:
        self.u = universe
        self._n = 0

    # --- predicates -------------------------------------------------------------------------------------------------------------------
    def _has(self, name: str) -> None:
        if name not in self.u.fields:
            raise DataError(f"unknown_field:{name}")

    def leaf(self, p: dict) -> Column:
        """A predicate as it is, null where it cannot be told; a filter may take it so, and a scan can then test it."""
        name, op, value = p["field"], p["op"], p.get("value")
        self._has(name)
        c = F.col(name)
        if op in ("gte", "lte"):
            try:
                bound = float(value)
            except (TypeError, ValueError):
                return F.lit(False)
            x = as_number(self.u, name) if not self.u.is_array(name) else F.lit(None).cast("double")
            return x >= bound if op == "gte" else x <= bound
        if self.u.is_array(name):
            if op == "eq":
                return F.array_contains(c, F.lit(str(value)))
            if op == "in":
                return F.arrays_overlap(c, F.array(*[F.lit(str(v)) for v in value])) if value else F.lit(False)
            if op == "contains":
                return F.exists(c, lambda x: F.contains(F.lower(x), F.lit(str(value).lower())))
            return F.exists(c, lambda x: F.trim(x) != "")
        if op == "eq":
            return self._equal(c, name, value)
        if op == "in":
            return text_of(self.u, name).isin([self._literal(v) for v in value]) if value else F.lit(False)
        if op == "contains":
            return F.contains(F.lower(text_of(self.u, name)), F.lit(str(value).lower()))
        return c.isNotNull() & (F.trim(text_of(self.u, name)) != "")

    @staticmethod
    def _literal(v: Any) -> str:
        return str(v).lower() if isinstance(v, bool) else str(v)

    def _equal(self, c: Column, name: str, value: Any) -> Column:
        kind = self.u.df.schema[name].dataType.simpleString()
        if kind == "boolean":
            return c == F.lit(value) if isinstance(value, bool) else F.lit(None).cast("boolean")
        if self.u.is_number(name):
            return c == F.lit(value) if _number(value) else F.lit(None).cast("boolean")
        return c == F.lit(value) if isinstance(value, str) else F.lit(None).cast("boolean")

    def where(self, df: DataFrame, preds: list[dict]) -> DataFrame:
        """`df` restricted by all predicates. A membership in a computed set is a semi- or anti-join; one inside `not` or `any` becomes a flag."""
        plain = [p for p in preds if not self._joins(p)]
        if plain:
            df = df.where(reduce(lambda a, b: a & b, map(self.test, plain)))
        for p in preds:
            if p["op"] == "in_expr":
                df = self._member(df, p)
            elif self._joins(p):
                df, m = self.mask(df, p)
                df = df.where(m)
        return df.select(*self.u.df.columns)

    def _joins(self, p: dict) -> bool:
        return p["op"] == "in_expr" or (p["op"] == "not" and self._joins(p["pred"])) or (p["op"] == "any" and any(map(self._joins, p["preds"])))

    def _member(self, df: DataFrame, p: dict) -> DataFrame:
        self._has(p["field"])
        inner = self.values(p["expr"]).withColumnRenamed("value", "__v")
        how = "left_anti" if p.get("negate") else "left_semi"
        if self.u.is_array(p["field"]):
            ids = df.select(self.u.key, F.explode(p["field"]).alias("__v")).join(inner, "__v", "left_semi").select(self.u.key).distinct()
            return df.join(ids, self.u.key, how)
        return df.join(inner, text_of(self.u, p["field"]) == F.col("__v"), how)

    def mask(self, df: DataFrame, p: dict) -> tuple[DataFrame, Column]:
        """A predicate as a two-valued column, with the frame that has what it needs."""
        if p["op"] == "not":
            df, m = self.mask(df, p["pred"])
            return df, ~m
        if p["op"] == "any":
            parts = []
            for q in p["preds"]:
                df, m = self.mask(df, q)
                parts.append(m)
            return df, reduce(lambda a, b: a | b, parts)
        if p["op"] == "in_expr":
            self._has(p["field"])
            self._n += 1
            flag = f"__in{self._n}"
            inner = self.values(p["expr"]).select(F.col("value").alias(f"{flag}v"))
            if self.u.is_array(p["field"]):
                ids = df.select(self.u.key, F.explode(p["field"]).alias(f"{flag}v")).join(inner, f"{flag}v", "left_semi").select(F.col(self.u.key).alias(f"{flag}k")).distinct()
                df = df.join(ids.withColumn(flag, F.lit(True)), F.col(self.u.key) == F.col(f"{flag}k"), "left")
            else:
                df = df.join(inner.withColumn(flag, F.lit(True)), text_of(self.u, p["field"]) == F.col(f"{flag}v"), "left")
            m = known(F.col(flag))
            return df, ~m if p.get("negate") else m
        return df, known(self.leaf(p))

    def test(self, p: dict) -> Column:
        """A predicate without joins where only true matters: null is kept outside negations, so that scans can test it."""
        if p["op"] == "not":
            return ~self.mask(self.u.df, p["pred"])[1]
        if p["op"] == "any":
            return reduce(lambda a, b: a | b, map(self.test, p["preds"]))
        return self.leaf(p)

    # --- records ----------------------------------------------------------------------------------------------------------------------
    def records(self, t: dict) -> DataFrame:
        if t["node"] == "filter":
            return self.where(self.u.df, t.get("where", []))
        df = self.records(t["of"])
        name = t["field"]
        self._has(name)
        text = F.trim(text_of(self.u, name))
        filled = F.col(name).isNotNull() & (text != "")
        number, day = as_number(self.u, name), F.expr(f"try_to_timestamp(cast(`{name}` as string))")
        pick = F.max if t["op"] == "argmax" else F.min
        seen = df.agg(
            pick(number).alias("__n"), pick(F.when(filled, day)).alias("__d"), pick(F.when(filled, F.lower(text))).alias("__t"), F.count_if(filled & day.isNull()).alias("__undated")
        ).withColumn("__one", F.lit(1))
        # One row of extremes, joined on a constant: numbers if any cell is one, else dates if all cells are, else text.
        both = df.withColumn("__one", F.lit(1)).join(F.broadcast(seen), "__one")
        hit = F.when(F.col("__n").isNotNull(), number == F.col("__n")).when((F.col("__undated") == 0) & F.col("__d").isNotNull(), day == F.col("__d")).otherwise(F.lower(text) == F.col("__t"))
        return both.where(known(hit & (filled | F.col("__n").isNotNull()))).select(*self.u.df.columns)

    def ids(self, t: dict) -> DataFrame:
        df = self.records(t)
        return df if self.u.unique else df.dropDuplicates([self.u.key])

    # --- values -----------------------------------------------------------------------------------------------------------------------
    def values(self, t: dict) -> DataFrame:
        """A set of strings: `value`, distinct."""
        node = t["node"]
        if node == "values":
            self._has(t["field"])
            df = self.records(t["of"])
            c = F.explode(t["field"]) if self.u.is_array(t["field"]) else text_of(self.u, t["field"])
            return df.select(c.alias("value")).where("value is not null and value <> '' and value <> 'nan'").distinct()
        if node == "keys_where":
            return self.groups(t["of"]).where(compare(t["op"], F.col("val"), F.lit(float(t["value"])))).select(F.col("key").alias("value"))
        a, b = self.values(t["left"]), self.values(t["right"])
        return a.union(b).distinct() if t["op"] == "union" else a.intersect(b) if t["op"] == "intersect" else a.subtract(b)

    # --- groups -----------------------------------------------------------------------------------------------------------------------
    def groups(self, t: dict) -> DataFrame:
        """Keys with a number: `key, val`. Null and blank keys are left out."""
        if t["node"] == "gcombine":
            a = self.groups(t["left"]).withColumnRenamed("val", "l")
            b = self.groups(t["right"]).withColumnRenamed("val", "r")
            x = a.join(b, "key", "full").select("key", F.coalesce("l", F.lit(0.0)).alias("l"), F.coalesce("r", F.lit(0.0)).alias("r"))
            if t["op"] == "gt":
                return x.select("key", (F.col("l") > F.col("r")).cast("double").alias("val"))
            if t["op"] == "diff":
                return x.select("key", (F.col("l").cast("decimal(38,6)") - F.col("r").cast("decimal(38,6)")).cast("double").alias("val"))
            return x.where("r <> 0").select("key", (F.col("l") / F.col("r")).alias("val"))
        df = self.records(t["of"])
        self._has(t["key"])
        key = F.explode(t["key"]).alias("key") if self.u.is_array(t["key"]) else text_of(self.u, t["key"]).alias("key")
        blank = "key is not null and trim(key) <> ''"
        if t.get("metric", "count") == "count":
            n = F.count(F.lit(1)) if self.u.unique and not self.u.is_array(t["key"]) else F.count_distinct(self.u.key)
            return df.select(self.u.key, key).where(blank).groupBy("key").agg(n.cast("double").alias("val"))
        self._has(t["field"])
        x = F.coalesce(as_number(self.u, t["field"]), F.lit(0.0)).cast("decimal(38,6)")
        return df.select(key, x.alias("x")).where(blank).groupBy("key").agg(F.sum("x").cast("double").alias("val"))

    def ranking(self, t: dict) -> DataFrame:
        """`rank, key, val`: the k largest, ties by key."""
        from pyspark.sql import Window as W

        top = self.groups(t["of"]).orderBy(F.desc("val"), F.asc("key")).limit(t["k"])
        return top.select(F.row_number().over(W.orderBy(F.desc("val"), F.asc("key"))).alias("rank"), "key", "val")

    # --- scalars ----------------------------------------------------------------------------------------------------------------------
    def scalar(self, t: dict) -> DataFrame:
        """One row `value, status`."""
        node = t["node"]
        fine = F.lit(None).cast("string").alias("status")
        if node == "num":
            return self.u.df.sparkSession.range(1).select(F.lit(float(t["value"])).alias("value"), fine)
        if node == "count":
            n = F.count(F.lit(1)) if self.u.unique else F.count_distinct(self.u.key)
            return self.records(t["of"]).agg(n.cast("double").alias("value")).select("value", fine)
        if node == "size":
            return self.values(t["of"]).agg(F.count(F.lit(1)).cast("double").alias("value")).select("value", fine)
        if node == "exists":
            return self.records(t["of"]).limit(1).agg((F.count(F.lit(1)) > 0).alias("value")).select("value", fine)
        if node == "sum":
            return self._sum(t)
        if node == "select":
            self._has(t["field"])
            c = F.explode(t["field"]) if self.u.is_array(t["field"]) else text_of(self.u, t["field"])
            v = self.records(t["of"]).select(c.alias("v")).where("v <> '' and v <> 'nan'")
            a = v.agg(F.count_distinct("v").alias("n"), F.min("v").alias("v"))
            status = F.when(F.col("n") == 0, "no_results").when(F.col("n") > 1, F.concat(F.lit("multiple_answers:"), F.col("n")))
            return a.select(F.when(F.col("n") == 1, F.col("v")).alias("value"), status.alias("status"))
        if node == "extreme":
            self._has(t["field"])
            x = as_number(self.u, t["field"])
            order = F.struct(-x if t["op"] == "argmax" else x, F.col(self.u.key))
            best = self.ids(t["of"]).where(x.isNotNull()).agg(F.min_by(self.u.key, order).alias("value"))
            return best.select("value", F.when(F.col("value").isNull(), "no_results").alias("status"))
        if node == "argext":
            v = -F.col("val") if t["op"] == "argmax" else F.col("val")
            best = self.groups(t["of"]).agg(F.min_by("key", F.struct(v, F.col("key"))).alias("value"))
            return best.select("value", F.when(F.col("value").isNull(), "no_groups").alias("status"))
        if node == "vcompare":
            cut = (lambda c: F.substring(c, 1, 10)) if t.get("normalize") == "date" else (lambda c: c)
            return self.scalar(t["of"]).select(compare(t["op"], cut(F.col("value")), cut(F.lit(str(t["value"])))).alias("value"), "status")
        return self._combine(t)

    def _sum(self, t: dict) -> DataFrame:
        name = t["field"]
        self._has(name)
        df = self.ids(t["of"])
        raw = text_of(self.u, name)
        number = F.expr(f"try_cast(trim(cast(`{name}` as string)) as double)")
        endless = F.isnan(number) | (F.abs(number) == F.lit(float("inf")))
        exact = F.col(name).cast("decimal(38,6)") if self.u.is_number(name) else F.expr(f"try_cast(trim(`{name}`) as decimal(38,6))")
        a = df.agg(
            F.sum(F.when(~endless, exact)).alias("s"), F.count_if(endless).alias("bad"), F.min(F.when(F.col(name).isNotNull() & number.isNull(), raw)).alias("odd")
        )
        status = F.when(F.col("odd").isNotNull(), F.concat(F.lit("non_numeric_value_in_sum:'"), F.col("odd"), F.lit("'"))).when(F.col("bad") > 0, "non_finite_value_in_sum")
        return a.select(F.coalesce(F.col("s").cast("double"), F.lit(0.0)).alias("value"), status.alias("status"))

    def _combine(self, t: dict) -> DataFrame:
        sides = [self.scalar(t[s]).select(F.lit(s).alias("side"), F.col("value").cast("double").alias("value"), "status") for s in ("left", "right")]
        at = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
        x = sides[0].unionByName(sides[1]).agg(at("left", "value").alias("l"), at("right", "value").alias("r"), F.coalesce(at("left", "status"), at("right", "status")).alias("status"))
        op = t["op"]
        if op in COMPARE:
            return x.select(compare(op, F.col("l"), F.col("r")).alias("value"), "status")
        if op == "ratio":
            zero = F.when(F.col("r") == 0, "ratio_division_by_zero")
            return x.select(F.expr("try_divide(l, r)").alias("value"), F.coalesce("status", zero).alias("status"))
        l, r = F.col("l").cast("decimal(38,6)"), F.col("r").cast("decimal(38,6)")
        return x.select((l - r if op == "diff" else l + r).cast("double").alias("value"), "status")

    def answer(self, t: dict) -> DataFrame:
        """The lazy result of a checked tree."""
        kind = check(t)
        return {"RECORDS": self.records, "VALUES": self.values, "GROUPS": self.groups, "RANKING": self.ranking}.get(kind, self.scalar)(t)


def named_fields(tree: Any) -> set[str]:
    """Every column a tree names."""
    if isinstance(tree, dict):
        own = {v for k, v in tree.items() if k in ("field", "key") and isinstance(v, str)}
        return own.union(*(named_fields(v) for k, v in tree.items() if k != "value"))
    if isinstance(tree, list):
        return set().union(*map(named_fields, tree))
    return set()


def lower(tree: dict, universe: Universe) -> DataFrame:
    """A tree as one lazy DataFrame: records, `value`, `key, val`, `rank, key, val`, or one row `value, status`.

    The universe is narrowed to the columns the tree names, so sides it does not need are not joined; records keep those columns.
    """
    check(tree)
    return Plan(universe.narrow(named_fields(tree))).answer(tree)


def run(tree: Any, universe: Universe) -> dict:
    """The answer envelope of a tree: status ok (type, answer), invalid (reason, path) or failed (reason). Never raises for a bad tree."""
    try:
        kind = check(tree)
    except AlgebraError as e:
        return {"status": "invalid", "reason": e.reason, "path": e.path}
    try:
        df = lower(tree, universe)
    except DataError as e:
        return {"status": "failed", "reason": str(e)}
    if kind == "RECORDS":
        rows = df.select(universe.key).orderBy(universe.key).collect()
        if not rows and tree["node"] == "extreme_rows":
            return {"status": "failed", "reason": "no_results"}
        return {"status": "ok", "type": kind, "answer": [r[0] for r in rows]}
    if kind == "VALUES":
        return {"status": "ok", "type": kind, "answer": [r[0] for r in df.orderBy("value").collect()]}
    if kind == "GROUPS":
        return {"status": "ok", "type": kind, "answer": {r["key"]: r["val"] for r in df.collect()}}
    if kind == "RANKING":
        rows = df.orderBy("rank").collect()
        if not rows:
            return {"status": "failed", "reason": "no_groups"}
        return {"status": "ok", "type": kind, "answer": [[r["key"], int(r["val"]) if float(r["val"]).is_integer() else r["val"]] for r in rows]}
    value, status = df.first()
    if status:
        return {"status": "failed", "reason": status}
    if kind == "NUMBER" and tree["node"] in ("count", "size"):
        value = int(value)
    return {"status": "ok", "type": kind, "answer": value}
