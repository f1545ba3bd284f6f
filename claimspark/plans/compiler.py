"""Propositions and values as DataFrame plans.

A proposition maps *bindings*, a DataFrame with one column for each variable, to bindings. Claim
patterns are joins on the shared variables, ``not``/``exists`` are anti/semi joins, sums are
grouped by the outer variables that they use and joined back (decorrelated, never a loop). Bags
stay bags: nothing is made distinct but what the language says is.

Where a correlated body can be matched on its own (every variable it uses is bound by one of its
own patterns), it is, and the result is joined; otherwise it starts from the distinct values of
the outer variables that it uses, which pushes these into it.
"""

from __future__ import annotations

from dataclasses import dataclass, is_dataclass, replace
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar
from ..kinds import DECIMAL_INEXACT, EMPTY_EXTREMUM, VALUE_AMBIGUOUS, VALUE_MISSING, ZERO_DIVISOR, KindError, kind_of_type, literal, measured, unit_of
from ..lang import ir
from ..lang.lower import branches, in_force, is_recursive
from ..operators.disciplines import versions_in_force
from ..operators.recursion import least_fixpoint


class Unbound(ValueError):
    """A name is used where nothing has bound it."""


@dataclass(frozen=True)
class Bindings:
    df: DataFrame
    kinds: dict[str, str]
    unit: bool = False  # the single empty binding, which needs no join

    def names(self) -> list[str]:
        return list(self.kinds)

    def with_df(self, df: DataFrame) -> Bindings:
        return replace(self, df=df, unit=False)


@dataclass(frozen=True)
class Value:
    column: Column
    kind: str
    error: Column | None = None
    unit: str | None = None


def tells_by_itself(prop) -> bool:
    """Whether a proposition only compares what is bound, so that each row tells whether it holds."""
    parts = prop.items if isinstance(prop, ir.And) else (prop,)
    return all(isinstance(x, ir.Compare) and all(isinstance(n, ir.Compare | ir.Var | ir.Lit | ir.Bin) for n in ir.walk(x) if is_dataclass(n)) for x in parts)


class Compiler:
    """Compiles against current claims, and ``pre`` claims where a rule asks for them.

    ``claims`` maps predicates to DataFrames whose columns are the declared fields, in order.
    With ``flag_errors`` a value's error is left in ``Value.error``; otherwise it is raised when rows
    are computed.
    """

    def __init__(self, spark: SparkSession, programme: ir.Programme, claims: dict[str, DataFrame], pre: dict[str, DataFrame] | None = None, flag_errors: bool = False, constants: dict[str, Value] | None = None):
        self.spark, self.programme, self.claims, self.pre, self.flag_errors = spark, programme, claims, pre, flag_errors
        self.constants = constants or {}
        self.fresh = count()
        self.relations: dict[str, DataFrame] = {}

    # --- names and frames

    def name(self, hint: str = "v") -> str:
        return f"__{hint}{next(self.fresh)}"

    def one(self) -> Bindings:
        return Bindings(self.spark.range(1).select(), {}, unit=True)

    def kinds_of(self, predicate: str, df: DataFrame) -> list[str]:
        declared = self.programme.predicates.get(predicate)
        by_type = [kind_of_type(f.dataType) for f in df.schema.fields]
        if declared is None or len(declared.fields) != len(by_type):
            return by_type
        # Durations are held as numbers, so the declaration tells them from decimals.
        return [measured(f.kind if f.kind == "Duration" else k, f.unit) for f, k in zip(declared.fields, by_type, strict=True)]

    # --- propositions

    def match(self, prop, b: Bindings | None = None) -> Bindings:
        """All bindings that extend ``b`` and make ``prop`` hold."""
        b = b or self.one()
        out = getattr(self, f"match_{type(prop).__name__.lower()}")(prop, b)
        # Columns made for computed arguments serve the one proposition that computed them.
        return replace(out, kinds={n: k for n, k in out.kinds.items() if n in b.kinds or not n.startswith("__arg")})

    def bindings(self, prop) -> DataFrame:
        """All bindings of a proposition, a column for each variable."""
        b = self.match(prop)
        return b.df.select(*(F.col(f"`{n}`") for n in b.kinds))

    def match_claim(self, p: ir.Claim, b: Bindings) -> Bindings:
        if p.predicate not in self.claims:
            raise KeyError(f"no claims of {p.predicate}")
        df = self.claims[p.predicate]
        return self.pattern(df, self.kinds_of(p.predicate, df), p.args, b)

    def pattern(self, df: DataFrame, kinds: list[str], args: tuple, b: Bindings) -> Bindings:
        """Join a relation whose columns stand for ``args``."""
        b, df, bound, new = self.terms(df, kinds, args, b)
        kinds_out = {**b.kinds, **{n: k for n, (_, k) in new.items()}}
        if b.unit:
            return Bindings(df.select(*(c.alias(n) for n, (c, _) in new.items())), kinds_out, unit=False) if new else Bindings(df.select(), kinds_out)
        keys = {n: self.name("k") for n in bound}
        right = df.select(*(c.alias(keys[n]) for n, (c, _) in bound.items()), *(c.alias(n) for n, (c, _) in new.items()))
        if not keys:
            return Bindings(b.df.crossJoin(right), kinds_out)
        on = reduce(Column.__and__, (F.col(f"`{n}`") == F.col(k) for n, k in keys.items()))
        return Bindings(b.df.join(right, on).drop(*keys.values()), {n: k for n, k in kinds_out.items()})

    def counted(self, p: ir.Claim, b: Bindings, n: str) -> Bindings | None:
        """Rows of ``b`` with the claims that a pattern matches and, as ``n``, how many these are; rows without one too.

        None where nothing bound is in the pattern. Claims are counted where the join has them sorted.
        """
        df = self.claims[p.predicate]
        b, df, bound, new = self.terms(df, self.kinds_of(p.predicate, df), p.args, b)
        if b.unit or not bound:
            return None
        keys = {name: self.name("k") for name in bound}
        whole = reduce(Column.__and__, (c.isNotNull() for c, _ in bound.values()))
        right = df.where(whole).select(*(c.alias(keys[name]) for name, (c, _) in bound.items()), *(c.alias(name) for name, (c, _) in new.items()))
        right = right.withColumn(n, F.count(F.lit(1)).over(Window.partitionBy(*keys.values())))
        on = reduce(Column.__and__, (F.col(f"`{name}`") == F.col(k) for name, k in keys.items()))
        rows = b.df.join(right, on, "left").withColumn(n, F.coalesce(n, F.lit(0)))
        kinds = {**b.kinds, **{name: k for name, (_, k) in new.items()}}
        return Bindings(rows.drop(*keys.values()), {name: k for name, k in kinds.items() if not name.startswith("__arg")})

    def terms(self, df: DataFrame, kinds: list[str], args: tuple, b: Bindings) -> tuple[Bindings, DataFrame, dict, dict]:
        """A relation's rows that fit ``args`` by themselves, and its columns for bound and for new variables."""
        if len(df.columns) != len(args):
            raise ValueError(f"{len(df.columns)} fields, {len(args)} terms")
        filters, bound, new, names = [], {}, {}, {}
        for i, (arg, kind) in enumerate(zip(args, kinds, strict=True)):
            column = F.col(f"`{df.columns[i]}`")
            if isinstance(arg, ir.Wild):
                continue
            if isinstance(arg, ir.Lit):
                filters.append(column == literal(arg.kind, arg.value))
            elif isinstance(arg, ir.Var) and arg.name in self.constants and arg.name not in b.kinds:
                filters.append(column == self.constants[arg.name].column)
            elif isinstance(arg, ir.Var):
                if arg.name in names:
                    filters.append(column == F.col(f"`{names[arg.name]}`"))
                    continue
                names[arg.name] = df.columns[i]
                if (one := unit_of(b.kinds.get(arg.name, ""))) and (other := unit_of(kind)) and one != other:
                    raise KindError(f"{arg.name} is in {one} and in {other}")
                (bound if arg.name in b.kinds else new)[arg.name] = (column, kind)
            else:  # a computed term: a name for its value, then a bound variable
                value = self.value(arg, b)
                hidden = self.name("arg")
                b = replace(value[0], df=value[0].df.withColumn(hidden, self.checked(value[1])), kinds={**value[0].kinds, hidden: measured(value[1].kind, value[1].unit)}, unit=False)
                bound[hidden] = (column, kind)
        if filters:
            df = df.where(reduce(Column.__and__, filters))
        return b, df, bound, new

    def match_and(self, p: ir.And, b: Bindings) -> Bindings:
        return reduce(lambda out, item: self.match(item, out), p.items, b)

    def match_or(self, p: ir.Or, b: Bindings) -> Bindings:
        made = [self.match(item, b) for item in p.items]
        common = [n for n in made[0].kinds if all(n in m.kinds for m in made)]
        if not common and b.unit:
            frames = [m.df.select(F.lit(1).alias("__some")) for m in made]
            return Bindings(reduce(DataFrame.union, frames).drop("__some"), {})
        frames = [m.df.select(*(F.col(f"`{n}`") for n in common)) for m in made]
        return Bindings(reduce(DataFrame.unionByName, frames), {n: made[0].kinds[n] for n in common})

    def match_not(self, p: ir.Not, b: Bindings) -> Bindings:
        return self.tested(p.inner, b, "left_anti")

    def match_exists(self, p: ir.Exists, b: Bindings) -> Bindings:
        return self.tested(p.inner, b, "left_semi")

    def match_implies(self, p: ir.Implies, b: Bindings) -> Bindings:
        return self.match_not(ir.Not(ir.And((p.left, ir.Not(p.right)))), b)

    def match_forall(self, p: ir.Forall, b: Bindings) -> Bindings:
        return self.match_implies(ir.Implies(p.source, p.body), b)

    def match_xor(self, p: ir.Xor, b: Bindings) -> Bindings:
        return self.match(ir.And((ir.Or((p.left, p.right)), ir.Not(ir.And((p.left, p.right))))), b)

    def match_pre(self, p: ir.Pre, b: Bindings) -> Bindings:
        if self.pre is None:
            raise ValueError("nothing stands for the state before")
        before = Compiler(self.spark, self.programme, self.pre, None, self.flag_errors, self.constants)
        before.fresh = self.fresh
        return before.match(p.inner, b)

    def match_compare(self, p: ir.Compare, b: Bindings) -> Bindings:
        b, test = self.compared(p, b)
        return b.with_df(b.df.where(test))

    def compared(self, p: ir.Compare, b: Bindings) -> tuple[Bindings, Column]:
        b, left = self.value(p.left, b)
        b, right = self.value(p.right, b)
        same_kind(left, right, p)
        if p.domain and left.kind != p.domain:
            raise KindError(f"{p.op} here compares {p.domain}, not {left.kind}")
        if p.op not in ("=", "!=") and left.kind in ("Subject", "Bool", "Collection"):
            raise KindError(f"{left.kind} has no order")
        x, y = self.checked(left), self.checked(right)
        return b, {"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[p.op]

    def match_in(self, p: ir.In, b: Bindings) -> Bindings:
        b, source = self.value(p.source, b)
        element = "Timestamp" if isinstance(p.source, ir.Builtin) and p.source.name == "periods" else None
        if isinstance(p.item, ir.Wild):
            raise ValueError("a wildcard can't be in a collection")
        if isinstance(p.item, ir.Var) and p.item.name not in b.kinds and p.item.name not in self.constants:
            df = b.df.select("*", F.explode(self.checked(source)).alias(p.item.name))
            kind = element or kind_of_type(df.schema[p.item.name].dataType)
            return Bindings(df, {**b.kinds, p.item.name: kind})
        b, item = self.value(p.item, b)
        return b.with_df(b.df.where(F.array_contains(self.checked(source), self.checked(item))))

    def match_call(self, p: ir.Call, b: Bindings) -> Bindings:
        d = self.programme.defines[p.name]
        if is_recursive(d):
            return self.recursive(d, p, b)
        if (found := self.in_force(d, p, b)) is not None:
            return found
        body = self.renamed(d)
        params = [self.param(d, i) for i in range(len(d.params))]
        if self.alone(body, params):
            relation = self.relations.get(d.name)
            if relation is None:
                relation = self.relations[d.name] = self.match(body).df.select(*params).distinct()
            return self.pattern(relation, self.param_kinds(body, params, relation), p.args, b)
        # Ground arguments are bound before the body is matched.
        b, ground = self.ground(p.args, b)
        seeds = Bindings(b.df.select(*(F.col(f"`{v}`").alias(params[i]) for i, (v, _) in ground.items())).distinct(), {params[i]: k for i, (_, k) in ground.items()}) if ground else self.one()
        found = self.match(body, seeds)
        if missing := [d.params[i] for i, n in enumerate(params) if n not in found.kinds]:
            raise Unbound(f"{d.name} needs {missing[0]}")
        args = tuple(ir.Var(ground[i][0]) if i in ground else a for i, a in enumerate(p.args))
        return self.pattern(found.df.select(*params).distinct(), [found.kinds[n] for n in params], args, b)

    def in_force(self, d: ir.Define, p: ir.Call, b: Bindings) -> Bindings | None:
        """A call of a version in force whose keys and date are bound and whose other places are open.

        By one shuffle of rows and versions by key; None for other calls.
        """
        of = next((q for q in self.programme.predicates.values() if q.effective and q.name in self.claims and d == in_force(q)), None)
        if of is None or b.unit:
            return None
        claims, names, e = self.claims[of.name], of.names(), of.effective
        asked, open_ = p.args[: len(e.keys) + 1], p.args[len(e.keys) + 1 :]
        new = [a.name for a in open_ if isinstance(a, ir.Var)]
        if len(claims.columns) != len(names) or any(not isinstance(a, ir.Var) or a.name not in b.kinds for a in asked) or any(not isinstance(a, ir.Var | ir.Wild) for a in open_) or any(n in b.kinds or n in self.constants for n in new) or len(set(new)) < len(new) or b.kinds[asked[-1].name] != "Date":
            return None
        column = {n: F.col(f"`{c}`") for n, c in zip(names, claims.columns, strict=True)}
        kinds = dict(zip(names, self.kinds_of(of.name, claims), strict=True))
        rest = [n for n in names if n not in e.keys and n != e.on]
        keys, at, on, versions = [self.name("key") for _ in e.keys], self.name("at"), self.name("on"), self.name("versions")
        if kinds[e.on] != "Date" or any(unit_of(kinds[k]) != unit_of(b.kinds[a.name]) for k, a in zip(e.keys, asked, strict=False)):
            return None
        whole = reduce(Column.__and__, (column[n].isNotNull() for n in (*e.keys, e.on)))
        stand = F.collect_set(F.struct(*(column[n].alias(f"_{i}") for i, n in enumerate(rest)), F.lit(0).alias("_"))).alias(versions)
        held = claims.where(whole).groupBy(*(column[k].alias(n) for k, n in zip(e.keys, keys, strict=True)), column[e.on].alias(on)).agg(stand)
        rows = b.df.withColumns({n: F.col(f"`{a.name}`") for n, a in zip((*keys, at), asked, strict=True)}).where(reduce(Column.__and__, (F.col(n).isNotNull() for n in (*keys, at))))
        one = self.name("version")
        found = versions_in_force(rows, held, keys, at, on).withColumn(one, F.explode(versions))
        bound = {a.name: kinds[n] for a, n in zip(open_, rest, strict=True) if isinstance(a, ir.Var)}
        values = [F.col(f"{one}._{i}").alias(a.name) for i, a in enumerate(open_) if isinstance(a, ir.Var)]
        return Bindings(found.select(*(F.col(f"`{n}`") for n in b.df.columns), *values), {**b.kinds, **bound})

    def ground(self, args: tuple, b: Bindings) -> tuple[Bindings, dict[int, tuple[str, str]]]:
        """Arguments that have a value in ``b``, each as a column of its own or a variable's."""
        out = {}
        for i, a in enumerate(args):
            if isinstance(a, ir.Wild) or isinstance(a, ir.Var) and a.name not in b.kinds and a.name not in self.constants:
                continue
            if isinstance(a, ir.Var) and a.name in b.kinds:
                out[i] = (a.name, b.kinds[a.name])
                continue
            b, value = self.value(a, b)
            hidden = self.name("arg")
            base = b.df if not b.unit else self.spark.range(1).select()
            b = Bindings(base.withColumn(hidden, self.checked(value)), {**b.kinds, hidden: measured(value.kind, value.unit)})
            out[i] = (hidden, value.kind)
        return b, out

    def param(self, d: ir.Define, i: int) -> str:
        return f"__{d.name}_{d.params[i]}"

    def param_kinds(self, body, params: list[str], relation: DataFrame) -> list[str]:
        kinds = self.match(body).kinds
        return [kinds[n] for n in params]

    def renamed(self, d: ir.Define):
        """The body with names of its own, so that no outer variable is caught."""
        return ir.substitute(d.body, {n: ir.Var(f"__{d.name}_{n}") for n in ir.variables(d.body) | set(d.params)})

    def alone(self, body, wanted: list[str]) -> bool:
        """Whether a body can be matched from nothing and binds these names."""
        try:
            return set(wanted) <= bound_by(body, set(self.constants), self.programme)
        except Unbound:
            return False

    def tested(self, body, b: Bindings, how: str) -> Bindings:
        keys = sorted(ir.variables(body) & set(b.kinds))
        if b.unit or not keys:
            some = self.match(body, self.one()).df.select(F.lit(1).alias("__some")).limit(1)
            base = b.df if not b.unit else self.spark.range(1).select()
            found = base.withColumn("__one", F.lit(1)).join(some, F.col("__one") == F.col("__some"), how).drop("__one")
            return Bindings(found, b.kinds)
        if tells_by_itself(body):
            wide, holds = self.holds(body, b)
            rows = wide.df.where(holds if how == "left_semi" else ~holds)
            return b.with_df(rows.select(*(F.col(f"`{n}`") for n in b.df.columns)))
        inner = self.match(body) if self.alone(body, keys) else self.match(body, self.seeds(b, keys))
        hidden = {k: self.name("t") for k in keys}
        right = inner.df.select(*(F.col(f"`{k}`").alias(h) for k, h in hidden.items()))
        on = reduce(Column.__and__, (F.col(f"`{k}`") == F.col(h) for k, h in hidden.items()))
        return b.with_df(b.df.join(right, on, how))

    def holds(self, body, b: Bindings) -> tuple[Bindings, Column]:
        """Whether what only compares holds in a row; a null among what is compared makes it fail, as in a join."""
        tests = []
        for x in body.items if isinstance(body, ir.And) else (body,):
            b, test = self.compared(x, b)
            tests.append(test)
        keys = sorted(ir.variables(body) & set(b.kinds))
        return b, reduce(Column.__and__, (F.col(f"`{k}`").isNotNull() for k in keys)) & F.coalesce(reduce(Column.__and__, tests), F.lit(False))

    def seeds(self, b: Bindings, keys: list[str]) -> Bindings:
        return Bindings(b.df.select(*(F.col(f"`{k}`") for k in keys)).distinct(), {k: b.kinds[k] for k in keys})

    def recursive(self, d: ir.Define, p: ir.Call, b: Bindings) -> Bindings:
        """Least fixpoint: branches without the call give the start, the others a step from new answers.

        Where arguments have values, only the questions that these lead to are answered.
        """
        params = list(d.params)
        start = [x for x in branches(d) if not any(isinstance(c, ir.Call) and c.name == d.name for c in ir.walk(x))]
        steps = [(x.items if isinstance(x, ir.And) else (x,)) for x in branches(d) if x not in start]
        first = self.match(start[0])
        kinds = [first.kinds[n] for n in params]
        b, ground = self.ground(p.args, b)
        args = tuple(ir.Var(ground[i][0]) if i in ground else a for i, a in enumerate(p.args))
        asked = self.questions(d, steps, kinds, b, ground) if ground else None
        if asked is None and d.name in self.relations:
            return self.pattern(self.relations[d.name], kinds, args, b)
        wanted = [params[i] for i in sorted(ground)]
        seeds = Bindings(asked, {params[i]: kinds[i] for i in sorted(ground)}) if asked is not None else None
        seed = reduce(DataFrame.unionByName, (self.match(x, seeds).df.select(*params) for x in start))

        def step(fresh: DataFrame) -> DataFrame:
            made = []
            for items in steps:
                # The new answers come first: they are few, and every item joins on what they bind.
                call = next(x for x in items if isinstance(x, ir.Call) and x.name == d.name)
                out = self.pattern(fresh, kinds, call.args, self.one())
                for item in items:
                    if item is not call:
                        out = self.match(item, out)
                made.append(out.df.select(*params))
            found = reduce(DataFrame.unionByName, made)
            return found if asked is None else found.join(asked, wanted, "left_semi").select(*params)

        relation = least_fixpoint(seed, step)
        if asked is None:
            self.relations[d.name] = relation
        return self.pattern(relation, kinds, args, b)

    def questions(self, d: ir.Define, steps: list, kinds: list[str], b: Bindings, ground: dict[int, tuple[str, str]]) -> DataFrame | None:
        """All values of the ground parameters that are asked for, directly or by a call from a call."""
        places = sorted(ground)
        names = [d.params[i] for i in places]
        first = b.df.select(*(F.col(f"`{ground[i][0]}`").alias(n) for i, n in zip(places, names, strict=True))).distinct()

        def step(fresh: DataFrame) -> DataFrame:
            made = [fresh.limit(0)]
            for items in steps:
                call = next(x for x in items if isinstance(x, ir.Call) and x.name == d.name)
                asked = [call.args[i] for i in places]
                if all(a == ir.Var(n) for a, n in zip(asked, names, strict=True)):
                    continue  # the same question again
                out = Bindings(fresh, {n: kinds[i] for i, n in zip(places, names, strict=True)})
                for item in items:
                    if item is not call:
                        out = self.match(item, out)
                made.append(out.df.select(*((F.col(f"`{a.name}`") if isinstance(a, ir.Var) else literal(a.kind, a.value)).alias(n) for a, n in zip(asked, names, strict=True))))
            return reduce(DataFrame.unionByName, made)

        try:
            return least_fixpoint(first, step)
        except Unbound:  # an item needs what only the call's answers tell: all of them are found
            return None

    # --- values

    def checked(self, v: Value) -> Column:
        """The column, raising the value's error if there is one (unless errors are only flagged)."""
        if v.error is None or self.flag_errors:
            return v.column
        return F.when(v.error.isNotNull(), F.raise_error(v.error)).otherwise(v.column)

    def value(self, e, b: Bindings) -> tuple[Bindings, Value]:
        """The bindings, perhaps with further columns, and the value for each row."""
        return getattr(self, f"value_{type(e).__name__.lower()}")(e, b)

    def value_var(self, e: ir.Var, b: Bindings) -> tuple[Bindings, Value]:
        if e.name in b.kinds:
            return b, Value(F.col(f"`{e.name}`"), b.kinds[e.name], unit=unit_of(b.kinds[e.name]))
        if e.name in self.constants:
            return b, self.constants[e.name]
        raise Unbound(f"{e.name} is bound by nothing before it")

    def value_lit(self, e: ir.Lit, b: Bindings) -> tuple[Bindings, Value]:
        if e.kind == "Span":
            return b, Value(F.lit(None), "Span")
        return b, Value(literal(e.kind, e.value), e.kind, unit=e.unit)

    def value_bin(self, e: ir.Bin, b: Bindings) -> tuple[Bindings, Value]:
        b, left = self.value(e.left, b)
        if isinstance(e.right, ir.Lit) and e.right.kind == "Span":
            sign = 1 if e.op == "+" else -1
            if left.kind != "Date" or e.op not in "+-":
                raise KindError("a span is added to a date or taken from it")
            months, days = e.right.value
            return b, Value(scalar.shift_date(left.column, sign * months, sign * days), "Date", left.error)
        b, right = self.value(e.right, b)
        return self.exact(e.op, left, right, b) if e.op in "+-*" and left.kind == right.kind == "Decimal" else (b, arithmetic(e.op, left, right))

    def exact(self, op: str, left: Value, right: Value, b: Bindings) -> tuple[Bindings, Value]:
        """Sum, difference or product of decimals: exact, or an error."""

        def keep(v: Column) -> Column:
            nonlocal b
            if b.unit:
                return v
            hidden = self.name("x")
            b = b.with_df(b.df.withColumn(hidden, v))
            return F.col(hidden)

        plain = arithmetic(op, left, right)
        rows = self.spark.range(1) if b.unit else b.df
        types = [f.dataType for f in rows.select(left.column.alias("l"), right.column.alias("r")).schema]
        if not any(isinstance(t, T.DecimalType) for t in types):
            return b, plain  # whole numbers: exact, or Spark's own overflow error
        of_left, of_right = map(as_decimal_type, types)
        column = plain.column
        if op == "*":
            column, lossy = scalar.exact_product(left.column.cast(of_left), right.column.cast(of_right), of_left, of_right, keep)
        else:
            lossy = scalar.exact_sum(left.column, right.column, of_left, of_right)
        if lossy is None:
            return b, plain
        return b, Value(column, "Decimal", either(plain.error, F.when(lossy, F.lit(DECIMAL_INEXACT))), plain.unit)

    def value_builtin(self, e: ir.Builtin, b: Bindings) -> tuple[Bindings, Value]:
        if e.name in ("period_index", "period_start_of"):
            b, anchor = self.value(e.args[0], b)
            b, last = self.value(e.args[2], b)
            make = scalar.period_index if e.name == "period_index" else scalar.period_start_of
            error = either(anchor.error, last.error)
            return b, Value(make(anchor.column, e.args[1].value, last.column), "Decimal" if e.name == "period_index" else "Date", error)
        args = []
        for a in e.args:
            b, v = self.value(a, b)
            args.append(v)
        columns, error = [a.column for a in args], reduce(either, (a.error for a in args))
        if e.name in ("min", "max"):
            for a in args[1:]:
                same_kind(args[0], a, e)
            return b, Value((F.least if e.name == "min" else F.greatest)(*columns), args[0].kind, error)
        if e.name == "abs":
            return b, Value(F.abs(columns[0]), args[0].kind, error)
        if e.name == "round":
            bad = F.when(columns[1] <= 0, F.lit("round_step"))
            return b, Value(scalar.round_to(*columns), "Decimal", either(error, bad) if not isinstance(e.args[1], ir.Lit) else error)
        if e.name == "digest":
            return b, Value(scalar.digest([a.kind for a in args], columns), "Subject", error)
        if e.name == "periods":
            step = e.args[2]
            if not isinstance(step, ir.Lit):
                raise KindError("the width of periods is written out")
            return b, Value(scalar.periods(columns[0], columns[1], int(step.value)), "Collection", error)
        raise KindError(f"unknown function {e.name}")

    def value_figure(self, e: ir.Figure, b: Bindings) -> tuple[Bindings, Value]:
        d = self.programme.defines[e.name]
        tag = next(self.fresh)
        by: dict = {n: ir.Var(f"__{d.name}{tag}_{n}") for n in ir.variables(d.body)}
        for param, arg in zip(d.params, e.args, strict=True):
            if isinstance(arg, ir.Var | ir.Lit):
                by[param] = arg
            else:
                b, v = self.value(arg, b)
                hidden = self.name("arg")
                b = Bindings(b.df.withColumn(hidden, self.checked(v)), {**b.kinds, hidden: measured(v.kind, v.unit)})
                by[param] = ir.Var(hidden)
        return self.value(ir.substitute(d.body, by), b)

    def grouped(self, body, targets: list, b: Bindings) -> tuple[Bindings, list[str], list[Value]]:
        """The body's bindings, the outer variables to group by, and the targets in it."""
        used = ir.variables(body) | set().union(*(ir.variables(t) for t in targets))
        keys = sorted(used & set(b.kinds))
        inner = self.match(body) if b.unit or self.alone(body, keys) else self.match(body, self.seeds(b, keys))
        values = []
        for t in targets:
            inner, v = self.value(t, inner)
            values.append(v)
        return inner, keys, values

    def joined(self, b: Bindings, inner: DataFrame, keys: list[str], hidden: dict[str, str]) -> Bindings:
        """Bring an aggregate back to the rows that it belongs to."""
        if not keys:
            base = b.df if not b.unit else self.spark.range(1).select()
            return b.with_df(base.crossJoin(F.broadcast(inner)))  # one row
        on = reduce(Column.__and__, (F.col(f"`{k}`") == F.col(h) for k, h in hidden.items()))
        return b.with_df(b.df.join(inner, on, "left").drop(*hidden.values()))

    def aggregated(self, body, targets: list, b: Bindings, make) -> tuple[Bindings, list[str], list[Value]]:
        inner, keys, values = self.grouped(body, targets, b)
        hidden = {k: self.name("g") for k in keys}
        columns = make(values)
        names = [self.name("a") for _ in columns]
        grouped = inner.df.groupBy(*(F.col(f"`{k}`").alias(h) for k, h in hidden.items())).agg(*(c.alias(n) for c, n in zip(columns, names, strict=True)))
        return self.joined(b, grouped, keys, hidden), names, values

    def value_sum(self, e: ir.Sum, b: Bindings) -> tuple[Bindings, Value]:
        b, (total, bad), (target,) = self.aggregated(e.body, [e.target], b, lambda v: [F.sum(v[0].column), F.max(v[0].error) if v[0].error is not None else F.max(F.lit(None).cast("string"))])
        if target.kind not in ("Decimal", "Duration"):
            raise KindError(f"{target.kind} can't be summed")
        zero = F.lit(0)
        return b, Value(F.coalesce(F.col(total), zero.cast("decimal(1,0)") if target.kind == "Decimal" else zero), target.kind, F.col(bad) if target.error is not None else None, target.unit)

    def value_extremum(self, e: ir.Extremum, b: Bindings) -> tuple[Bindings, Value]:
        pick = F.max if e.which == "max" else F.min
        b, (found,), (target,) = self.aggregated(e.body, [e.target], b, lambda v: [pick(v[0].column)])
        if target.kind not in ("Decimal", "Date", "Timestamp", "Duration"):
            raise KindError(f"{target.kind} has no order")
        return b, Value(F.col(found), target.kind, F.when(F.col(found).isNull(), F.lit(EMPTY_EXTREMUM)), target.unit)

    def value_valueof(self, e: ir.ValueOf, b: Bindings) -> tuple[Bindings, Value]:
        wanted = next(i for i, a in enumerate(e.claim.args) if isinstance(a, ir.Wanted))
        hidden = self.name("w")
        claim = ir.Claim(e.claim.predicate, tuple(ir.Var(hidden) if i == wanted else a for i, a in enumerate(e.claim.args)))
        b, (n, found), (target,) = self.aggregated(claim, [ir.Var(hidden)], b, lambda v: [F.count(F.lit(1)), F.first(v[0].column)])
        times, column = F.coalesce(F.col(n), F.lit(0)), F.col(found)
        error = F.when(times > 1, F.lit(VALUE_AMBIGUOUS))
        if e.default is None:
            error = error.when(times == 0, F.lit(VALUE_MISSING))
        else:
            b, default = self.value(e.default, b)
            column = F.when(times == 0, default.column).otherwise(column)
            if default.error is not None:
                error = error.when(times == 0, default.error)
        return b, Value(column, target.kind, error, target.unit)

    def value_ifvalue(self, e: ir.IfValue, b: Bindings) -> tuple[Bindings, Value]:
        keys = sorted(ir.variables(e.test) & set(b.kinds))
        flag = self.name("if")
        if b.unit or not keys:
            some = self.match(e.test, self.one()).df.select(F.lit(True).alias(flag)).limit(1)
            base = b.df if not b.unit else self.spark.range(1).select()
            b = b.with_df(base.join(some, F.lit(True), "left"))
        else:
            inner = self.match(e.test) if self.alone(e.test, keys) else self.match(e.test, self.seeds(b, keys))
            hidden = {k: self.name("f") for k in keys}
            some = inner.df.select(*(F.col(f"`{k}`").alias(h) for k, h in hidden.items())).distinct().withColumn(flag, F.lit(True))
            b = self.joined(b, some, keys, hidden)
        b, then = self.value(e.then, b)
        b, other = self.value(e.other, b)
        same_kind(then, other, e)
        test = F.coalesce(F.col(flag), F.lit(False))
        error = None
        if then.error is not None or other.error is not None:
            none = F.lit(None).cast("string")
            error = F.when(test, none if then.error is None else then.error).otherwise(none if other.error is None else other.error)
        return b, Value(F.when(test, then.column).otherwise(other.column), then.kind, error, then.unit)


def bound_by(prop, bound: set[str], programme: ir.Programme) -> set[str]:
    """Names bound after a proposition; raises Unbound if it uses one before something binds it."""

    def used(e, inside: set[str]) -> None:
        if isinstance(e, ir.Var):
            if e.name not in inside:
                raise Unbound(e.name)
        elif isinstance(e, ir.Sum | ir.Extremum):
            used(e.target, bound_by(e.body, inside, programme))
        elif isinstance(e, ir.ValueOf):
            bound_by(e.claim, inside, programme)
            if any(isinstance(a, ir.Var) and a.name not in inside for a in e.claim.args):
                raise Unbound(e.claim.predicate)
            used(e.default, inside)
        elif isinstance(e, ir.IfValue):
            bound_by(e.test, inside, programme)
            used((e.then, e.other), inside)
        else:
            for child in ir.children(e):
                used(child, inside)

    if isinstance(prop, ir.Claim):
        for a in prop.args:
            if not isinstance(a, ir.Var | ir.Wild | ir.Lit | ir.Wanted):
                used(a, bound)
        return bound | {a.name for a in prop.args if isinstance(a, ir.Var)}
    if isinstance(prop, ir.And):
        return reduce(lambda out, item: bound_by(item, out, programme), prop.items, bound)
    if isinstance(prop, ir.Or):
        return set.intersection(*(bound_by(item, bound, programme) for item in prop.items))
    if isinstance(prop, ir.Not | ir.Exists | ir.Pre):
        inner = bound_by(prop.inner, bound, programme)
        return inner if isinstance(prop, ir.Pre) else bound
    if isinstance(prop, ir.Implies | ir.Forall):
        left, right = (prop.left, prop.right) if isinstance(prop, ir.Implies) else (prop.source, prop.body)
        bound_by(right, bound_by(left, bound, programme), programme)
        return bound
    if isinstance(prop, ir.Xor):
        bound_by(prop.left, bound, programme)
        bound_by(prop.right, bound, programme)
        return bound
    if isinstance(prop, ir.Compare):
        used((prop.left, prop.right), bound)
        return bound
    if isinstance(prop, ir.In):
        used(prop.source, bound)
        if isinstance(prop.item, ir.Var):
            return bound | {prop.item.name}
        used(prop.item, bound)
        return bound
    if isinstance(prop, ir.Call):
        d = programme.defines[prop.name]
        given = {p for p, a in zip(d.params, prop.args, strict=True) if isinstance(a, ir.Lit) or isinstance(a, ir.Var) and a.name in bound or not isinstance(a, ir.Var | ir.Lit | ir.Wild)}
        if not is_recursive(d) and set(d.params) - bound_by(d.body, given, programme):
            raise Unbound(prop.name)
        return bound | {a.name for a in prop.args if isinstance(a, ir.Var)}
    raise KindError(f"not a proposition: {prop}")


def either(a: Column | None, b: Column | None) -> Column | None:
    if a is None or b is None:
        return b if a is None else a
    return F.coalesce(a, b)


def same_kind(a: Value, b: Value, where) -> None:
    if a.kind != b.kind:
        raise KindError(f"{a.kind} and {b.kind} don't go together")
    if a.unit and b.unit and a.unit != b.unit:
        raise KindError(f"{a.unit} and {b.unit} don't go together")


def as_decimal_type(t: T.DataType) -> T.DecimalType:
    """The decimal that Spark takes a number for in arithmetic with decimals."""
    if isinstance(t, T.DecimalType):
        return t
    return T.DecimalType({"tinyint": 3, "smallint": 5, "int": 10, "bigint": 20}.get(t.simpleString(), 20), 0)


def arithmetic(op: str, a: Value, b: Value) -> Value:
    error, kinds = either(a.error, b.error), (a.kind, b.kind)
    x, y = a.column, b.column
    if kinds == ("Decimal", "Decimal"):
        if op in "+-":
            same_kind(a, b, op)
            return Value(x + y if op == "+" else x - y, "Decimal", error, a.unit or b.unit)
        if op == "*":
            if a.unit and b.unit:
                raise KindError("two quantities can't be multiplied")
            return Value(x * y, "Decimal", error, a.unit or b.unit)
        if b.unit and a.unit != b.unit:
            raise KindError(f"{a.unit or 'a number'} by {b.unit}")
        zero = F.when(y == 0, F.lit(ZERO_DIVISOR))
        return Value(x / F.nullif(y, F.lit(0)) if op == "/" else scalar.remainder(x, y), "Decimal", either(error, zero), None if b.unit or op == "%" else a.unit)
    if kinds == ("Timestamp", "Duration") and op in "+-":
        return Value(scalar.add_duration(x, y if op == "+" else -y), "Timestamp", error)
    if kinds == ("Timestamp", "Timestamp") and op == "-":
        return Value(scalar.micros(x) - scalar.micros(y), "Duration", error)
    if kinds == ("Date", "Date") and op == "-":
        return Value(F.datediff(x, y).cast("decimal(10,0)"), "Decimal", error)
    if kinds == ("Duration", "Duration"):
        if op in "+-":
            return Value(x + y if op == "+" else x - y, "Duration", error)
        if op == "/":
            return Value(x.cast("decimal(20,0)") / F.nullif(y.cast("decimal(20,0)"), F.lit(0)), "Decimal", either(error, F.when(y == 0, F.lit(ZERO_DIVISOR))))
    raise KindError(f"{a.kind} {op} {b.kind}")
