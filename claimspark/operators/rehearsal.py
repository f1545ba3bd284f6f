"""Recorded acts decided again, whole, under a candidate programme.

What was recorded stays the history whatever the candidate says, so each act is decided in the
recorded state before its own position, and all of them at once: statements, the effective delta
and the rules read claims with their validity. The state after an act is never built; a pattern
in a rule matches claims of the state before that the act doesn't take away, or those it adds.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..kinds import literal
from ..lang import ir
from ..lang.lower import require_valid
from ..plans import rules
from ..plans.compiler import Bindings, Compiler
from .act import PID, Body, union
from .history import AT, FOREVER, at_version, declared_kind, intervals, over_spans
from .recursion import written


class PastBody(Body):
    """Statements run over acts of many positions, each in the state before its own."""

    def __init__(self, c: Compiler, t: ir.Transformation):
        # One supply of names for the whole body: what a statement binds, later ones see.
        self.fresh = count()
        super().__init__(c, replace(t, body=self.before(t.body)))

    def before(self, body: tuple) -> tuple:
        """The statements with what they read asked for in the state before; their own patterns are ``found``."""
        out = []
        for s in body:
            if isinstance(s, ir.ForClaim):
                s = replace(s, body=self.before(s.body))
            elif isinstance(s, ir.For):
                s = replace(s, source=at_version(s.source, True, self.fresh), body=self.before(s.body))
            elif isinstance(s, ir.Choose):
                s = replace(s, test=at_version(s.test, True, self.fresh), then=self.before(s.then), other=self.before(s.other))
            elif not isinstance(s, ir.Retract):
                s = at_version(s, True, self.fresh)
            out.append(s)
        return tuple(out)

    def fields(self, predicate: str) -> list:
        return super().fields(predicate)[:-2]

    def found(self, claim: ir.Claim, b: Bindings) -> Bindings:
        return self.c.match(at_version(claim, True, self.fresh), b)


def after_act(node, changed: set[str], fresh):
    """A proposition read in the state after the act at ``AT``."""
    if isinstance(node, ir.Claim):
        if node.predicate not in changed:
            return at_version(node, True, fresh)
        terms = tuple(ir.Var(f"__any{next(fresh)}") if isinstance(a, ir.Wild) else a for a in node.args)
        stays = ir.And((at_version(replace(node, args=terms), True, fresh), ir.Not(ir.Claim(f"{node.predicate} gone", (ir.Var(AT), *terms)))))
        return ir.Or((stays, ir.Claim(f"{node.predicate} made", (ir.Var(AT), *terms))))
    if isinstance(node, tuple):
        return tuple(after_act(x, changed, fresh) for x in node)
    if hasattr(node, "__dataclass_fields__") and not isinstance(node, ir.Lit | ir.Var):
        return replace(node, **{n: after_act(v, changed, fresh) for n in node.__dataclass_fields__ if isinstance(v := getattr(node, n), tuple) or hasattr(v, "__dataclass_fields__")})
    return node


def rehearse_acts(c: Compiler, name: str, acts: DataFrame, kinds: dict[str, str], logs: dict[str, DataFrame]) -> DataFrame:
    """Each recorded act of a transformation under the candidate ``c``: ord, verdict, kind, rule.

    ``acts``: ord, actor, decided_at, the parameters, and ``accepted`` as recorded. ``logs``: all
    operations of every predicate that the candidate reads or writes. Verdicts: ``same``,
    ``different_delta`` (accepted both times, but the claims added and taken away differ),
    ``would_reject``, ``would_accept``, ``would_error`` (a binding is ambiguous) and
    ``unreplayable`` (the candidate has no such transformation, or a parameter wasn't recorded).

    Rules that can't be judged by cases, bodies that mint subjects, and calls of definitions are
    refused before anything runs, with a ValueError.
    """
    t = c.programme.transformations.get(name)
    if t is None:
        return acts.select("ord", F.lit("unreplayable").alias("verdict"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("rule"))
    require_valid(c.programme)
    told = {r.name: rules.impact(c.programme, r) for r in c.programme.invariants}
    asked = [t.body, *(r.body for r in c.programme.invariants)]
    if any(isinstance(x, ir.New | ir.Call | ir.Figure) for x in ir.walk(tuple(asked))):
        raise ValueError(f"{name} or a rule mints subjects or calls a definition")
    if wide := [f"{n}: {i.widened}" for n, i in told.items() if i.widened]:
        raise ValueError(f"rules that can't be judged by cases: {', '.join(wide)}")

    columns = {p: c.programme.predicates[p].names() for p in logs}
    spans = {p: written(intervals(log, columns[p]), "spans") for p, log in logs.items()}
    v = over_spans(c, spans)
    whole = reduce(Column.__and__, (F.col(f"`{n}`").isNotNull() for n in kinds), F.lit(True))
    rows = acts.where(whole).drop("accepted").withColumnRenamed("ord", PID).withColumn(AT, F.col(PID))
    staged = PastBody(v, t).run(rows, {AT: "Decimal", **kinds})

    none = c.spark.sql(f"SELECT 0L AS {PID}, array(0L) AS at, '' AS kind, '' AS rule WHERE false")
    first = F.min_by(F.struct("kind", "rule"), "at").alias("why")
    gated = written(union([none, *staged.refusals]).groupBy(PID).agg(first).select(PID, "why.kind", "why.rule"), "gated")
    delta = {p: written(effective(spans[p], columns[p], *(union(x[p]).join(gated, PID, "left_anti").distinct() if p in x else None for x in (staged.adds, staged.removes))), "delta") for p in sorted({*staged.adds, *staged.removes})}

    broken = [broken_by(c, v, rule, told[rule.name], delta).select(PID, F.lit(i).alias("place"), F.lit(rule.name).alias("rule")) for i, rule in enumerate(c.programme.invariants) if any(o.predicate in delta and o.names for o in told[rule.name].occurrences)]
    refused = gated
    if broken:
        least = union(broken).groupBy(PID).agg(F.min_by("rule", "place").alias("rule"))
        refused = gated.unionByName(least.select(PID, F.lit("invariant").alias("kind"), "rule"))
    other = union([unlike(recorded(spans[p], columns[p]), delta.get(p)) for p in logs]).distinct().withColumn("other", F.lit(True))
    judged = acts.select("ord", "accepted", whole.alias("whole")).join(refused.withColumnRenamed(PID, "ord"), "ord", "left").join(other.withColumnRenamed(PID, "ord"), "ord", "left")
    no = F.col("kind").isNotNull()
    verdict = (
        F.when(~F.col("whole"), "unreplayable").when(no & (F.col("kind") == "error"), "would_error").when(no & F.col("accepted"), "would_reject").when(no, "same")
        .when(~F.col("accepted"), "would_accept").when(F.col("other"), "different_delta").otherwise("same")
    )
    return judged.select("ord", verdict.alias("verdict"), "kind", "rule")


def held(rows: DataFrame, spans: DataFrame, columns: list[str], how: str) -> DataFrame:
    """The rows (pid and a claim) whose claim held, or with an anti join didn't, before their position."""
    s = spans.select(*(F.col(f"`{n}`").alias(f"__{i}") for i, n in enumerate(columns)), "valid_from", "valid_to")
    on = reduce(Column.__and__, (F.col(f"`{n}`") == F.col(f"__{i}") for i, n in enumerate(columns)))
    return rows.join(s, on & (F.col("valid_from") < F.col(PID)) & (F.col(PID) <= F.col("valid_to")), how)


def effective(spans: DataFrame, columns: list[str], adds: DataFrame | None, removes: DataFrame | None) -> DataFrame:
    """pid, the claim and op: what acts really change in the state before each."""
    made = []
    if adds is not None:
        made.append(held(adds, spans, columns, "left_anti").withColumn("op", F.lit("ins")))
    if removes is not None:
        gone = removes if adds is None else removes.join(adds, [PID, *columns], "left_anti")
        made.append(held(gone, spans, columns, "left_semi").withColumn("op", F.lit("del")))
    return union(made)


def recorded(spans: DataFrame, columns: list[str]) -> DataFrame:
    """The same of what was recorded. A claim that ends and begins at one position didn't change there."""
    ends = F.array(F.struct(F.col("valid_from").alias(PID), F.lit("ins").alias("op")), F.struct(F.col("valid_to").alias(PID), F.lit("del").alias("op")))
    rows = spans.select(*columns, F.explode(ends).alias("__end")).select("__end.pid", *columns, "__end.op").where(F.col(PID) < FOREVER)
    return rows.groupBy(PID, *columns).agg(F.min("op").alias("op"), F.count("*").alias("__n")).where("__n = 1").drop("__n")


def unlike(was: DataFrame, now: DataFrame | None) -> DataFrame:
    """Positions at which two deltas differ."""
    if now is None:
        return was.select(PID).distinct()
    return was.unionByName(now).groupBy(*was.columns).count().where("count = 1").select(PID)


def broken_by(c: Compiler, v: Compiler, rule: ir.Invariant, told: rules.Impact, delta: dict[str, DataFrame]) -> DataFrame:
    """The acts after which a case that they touch breaks a rule."""
    frames: dict[tuple, list[DataFrame]] = {}
    for o in told.occurrences:
        if o.predicate in delta and o.names:
            names = c.programme.predicates[o.predicate].names()
            at = {n: names[i] for i, n in o.names.items()}
            guards = [F.col(f"`{names[i]}`") == literal(g.kind, g.value) for i, g in o.guards.items() if g.kind in ("Subject", "Bool", "Decimal")]
            touched = delta[o.predicate].where(reduce(Column.__and__, guards, F.lit(True)))
            frames.setdefault(tuple(sorted(at)), []).append(touched.select(F.col(PID).alias(AT), *(F.col(f"`{at[n]}`").alias(n) for n in sorted(at))))
    declared, claims = {}, dict(v.claims)
    for p, d in delta.items():
        fields = (ir.Field("at", "Decimal"), *c.programme.predicates[p].fields)
        for word, op in (("made", "ins"), ("gone", "del")):
            declared[f"{p} {word}"] = ir.Predicate(f"{p} {word}", fields)
            claims[f"{p} {word}"] = d.where(F.col("op") == op).drop("op")
    after = Compiler(v.spark, replace(v.programme, predicates={**v.programme.predicates, **declared}), claims, constants=c.constants)
    left, right = rules.split(rule.body)
    made = []
    for names, parts in frames.items():
        b = Bindings(union(parts).distinct(), {AT: "Decimal", **{n: declared_kind(c, rule, n) for n in names}})
        fresh = count()
        b = after.match(after_act(left, set(delta), fresh), b)
        b = after.match(ir.Not(after_act(right, set(delta), fresh)), b) if right is not None else b
        made.append(b.df.select(F.col(AT).alias(PID)))
    return union(made).distinct()
