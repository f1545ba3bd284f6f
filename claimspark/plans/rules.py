"""Rules as violation queries, whole or only for the cases that a change touches."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..kinds import literal
from ..lang import ir
from ..lang.lower import is_recursive, unique_rule
from .compiler import Bindings, Compiler, tells_by_itself


def split(body) -> tuple[object, object] | None:
    """What a rule speaks of and what it asks of that: violations are the first without the second."""
    if isinstance(body, ir.Implies):
        return body.left, body.right
    if isinstance(body, ir.Forall):
        return body.source, body.body
    if isinstance(body, ir.Not):
        return body.inner, None
    return None


def violations(c: Compiler, rule: ir.Invariant, cases: list[DataFrame] | None = None) -> DataFrame:
    """Bindings of what the rule speaks of that break it; empty if it holds.

    With ``cases``, frames of values of case variables, only these are checked. A rule that isn't
    conditional breaks once, as a row without columns, if it has no binding at all.
    """
    parts = split(rule.body)
    if parts is None:
        found = c.match(rule.body).df.select(F.lit(1).alias("__found")).limit(1)
        one = c.spark.range(1).select(F.lit(rule.name).alias("rule"), F.lit(1).alias("__one"))
        return one.join(found, F.col("__one") == F.col("__found"), "left_anti").select("rule")
    left, right = parts
    if cases is None:
        return broken(c, c.match(left), right).df
    made = []
    for case in cases:
        # The touched cases are few: they start the match, so that every join is keyed by them.
        seeds = Bindings(case.distinct(), {n: case_kind(c, rule, n) for n in case.columns})
        made.append(broken(c, c.match(left, seeds), right).df)
    names = sorted(set.intersection(*(set(d.columns) for d in made)))
    return reduce(DataFrame.unionByName, (d.select(*names) for d in made)).distinct()


def broken(c: Compiler, b: Bindings, right) -> Bindings:
    return b if right is None else c.match(ir.Not(right), b)


def case_kind(c: Compiler, rule: ir.Invariant, name: str) -> str:
    for node in ir.walk(rule.body):
        if isinstance(node, ir.Claim):
            for i, a in enumerate(node.args):
                if isinstance(a, ir.Var) and a.name == name:
                    return c.kinds_of(node.predicate, c.claims[node.predicate])[i]
    return "Subject"


@dataclass
class Occurrence:
    """A claim pattern somewhere in a rule: its literals, and the case variables at its positions."""

    predicate: str
    guards: dict[int, ir.Lit] = field(default_factory=dict)
    names: dict[int, str] = field(default_factory=dict)


@dataclass
class Impact:
    """What a change has to do with a rule."""

    variables: set[str]
    occurrences: list[Occurrence]
    widened: str | None  # why any touching change rechecks the whole, if it does

    def touched(self, delta: dict[str, DataFrame]) -> str | list[DataFrame]:
        """"untouched", "unbounded", or the touched cases, a frame for each set of variables."""
        mine = [o for o in self.occurrences if o.predicate in delta]
        if not mine:
            return "untouched"
        if self.widened or any(not o.names for o in mine):
            return "unbounded"
        frames: dict[tuple, list[DataFrame]] = {}
        for o in mine:
            df = delta[o.predicate]
            tests, first = [], {}
            for i, guard in o.guards.items():
                if guard.kind in ("Subject", "Bool", "Decimal"):
                    tests.append(F.col(f"`{df.columns[i]}`") == literal(guard.kind, guard.value))
            for i, name in o.names.items():
                if name in first:
                    tests.append(F.col(f"`{df.columns[i]}`") == F.col(f"`{df.columns[first[name]]}`"))
                else:
                    first[name] = i
            if tests:
                df = df.where(reduce(Column.__and__, tests))
            frames.setdefault(tuple(sorted(first)), []).append(df.select(*(F.col(f"`{df.columns[first[n]]}`").alias(n) for n in sorted(first))))
        return [reduce(DataFrame.unionByName, x).distinct() for x in frames.values()]


def positive(prop) -> list[ir.Claim]:
    """Claim patterns that a proposition reaches through ``and`` only."""
    if isinstance(prop, ir.Claim):
        return [prop]
    return [p for item in prop.items for p in positive(item)] if isinstance(prop, ir.And) else []


WIDENING = (ir.Pre, ir.Xor, ir.ValueOf, ir.IfValue)


def impact(programme: ir.Programme, rule: ir.Invariant) -> Impact:
    parts = split(rule.body)
    cases = {a.name for p in positive(parts[0]) for a in p.args if isinstance(a, ir.Var)} if parts else set()
    found: list[Occurrence] = []
    why: list[str] = []

    def visit(node, names: dict[str, str], depth: int) -> None:
        """``names``: the case variable that a variable stands for."""
        if isinstance(node, WIDENING):
            why.append(type(node).__name__.lower())
        if isinstance(node, ir.In) and not (isinstance(node.source, ir.Builtin) and node.source.name == "periods"):
            why.append("in")
        if isinstance(node, ir.Sum | ir.Extremum) and not isinstance(node.target, ir.Var | ir.Lit):
            why.append("a sum of an expression")
        if isinstance(node, ir.Claim):
            o = Occurrence(node.predicate)
            for i, a in enumerate(node.args):
                if isinstance(a, ir.Lit):
                    o.guards[i] = a
                elif isinstance(a, ir.Var) and a.name in names:
                    o.names[i] = names[a.name]
            found.append(o)
        if isinstance(node, ir.Call | ir.Figure):
            d = programme.defines[node.name]
            if is_recursive(d):
                why.append("a recursive call")
            if depth > 32:
                why.append("a deep call")
            elif not is_recursive(d):
                inner = {p: names[a.name] for p, a in zip(d.params, node.args, strict=True) if isinstance(a, ir.Var) and a.name in names}
                visit(d.body, inner, depth + 1)
            else:
                visit(tuple(x for x in ir.walk(d.body) if isinstance(x, ir.Claim)), {}, depth + 1)
        for child in ir.children(node):
            visit(child, names, depth)

    visit(rule.body, {n: n for n in cases}, 0)
    if parts and any(isinstance(x, ir.Or) for x in ir.walk(parts[0])):
        why.append("or in what it speaks of")
    return Impact(cases, found, why[0] if why else ("no cases" if not cases else None))


def checked(c: Compiler, rule: ir.Invariant, delta: dict[str, DataFrame]) -> DataFrame | None:
    """Violations that a change to the claims of ``delta`` may have made; None if it can't have made any."""
    told = impact(c.programme, rule).touched(delta)
    if told == "untouched":
        return None
    return violations(c, rule, None if told == "unbounded" else told)


def local(programme: ir.Programme, rule: ir.Invariant, constants) -> tuple[ir.Claim, object] | None:
    """The one claim that a rule speaks of and what it asks of that, if each claim tells by itself whether it breaks the rule."""
    parts = split(rule.body)
    if parts is None or not isinstance(parts[0], ir.Claim):
        return None
    names = [a.name for a in parts[0].args if isinstance(a, ir.Var)]
    if not names or len(set(names)) < len(names) or set(names) & set(constants) or any(not isinstance(a, ir.Var | ir.Lit) for a in parts[0].args):
        return None
    if parts[1] is not None and not (tells_by_itself(parts[1]) and ir.variables(parts[1]) and ir.variables(parts[1]) <= set(names)):
        return None
    return parts


def unique_keys(programme: ir.Programme, rule: ir.Invariant) -> tuple[str, list[int]] | None:
    """The predicate and the places of the keys, if a rule is that these are unique."""
    for p in programme.predicates.values():
        for keys in (*p.unique, *([p.pointer] if p.pointer else []), *([(*p.effective.keys, p.effective.on)] if p.effective else [])):
            if keys and set(keys) < set(p.names()) and rule.body == unique_rule(p, keys).body:
                return p.name, [p.names().index(k) for k in keys]
    return None


def first_violation(found: DataFrame) -> DataFrame:
    """The least violation in the order of its columns: the witness."""
    return found.orderBy(*found.columns).limit(1)


def compared(c: Compiler, rule: ir.Invariant, found: DataFrame) -> DataFrame:
    """Violations with the two sides of the comparison that failed, where the rule asks for one."""
    parts = split(rule.body)
    if not parts or not isinstance(parts[1], ir.Compare):
        return found
    kinds = {n: case_kind(c, rule, n) for n in found.columns}
    b, left = c.value(parts[1].left, Bindings(found, kinds))
    b, right = c.value(parts[1].right, b)
    return b.df.select(*found.columns, F.lit(parts[1].op).alias("op"), left.column.alias("left"), right.column.alias("right"))
