"""Derived claims: the distinct keys of a domain and a value for each."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..kinds import KindError, literal
from ..lang import ir
from .compiler import Bindings, Compiler


def derived(c: Compiler, d: ir.Derived, ordered: bool = False) -> DataFrame:
    """One row for each distinct key tuple that the domain binds; errors are raised when it is read."""
    b, values = fused(c, keys_of(c, d), d.values)
    columns = []
    for field, e in values:
        b, v = c.value(e, b)
        columns.append(c.checked(v).alias(field))
    out = b.df.select(*(F.col(f"`{k}`") for k in d.keys), *columns)
    return out.orderBy(*d.keys) if ordered else out


def live(c: Compiler, d: ir.Derived) -> DataFrame:
    """As ``derived``, but a row whose values have an error shows nulls and its name in ``_error``."""
    flagged = Compiler(c.spark, c.programme, c.claims, c.pre, True, c.constants)
    (b, values), made = fused(flagged, keys_of(flagged, d), d.values), []
    for field, e in values:
        b, v = flagged.value(e, b)
        made.append((field, v))
    errors = [v.error for _, v in made if v.error is not None]
    error: Column = F.coalesce(*errors) if errors else F.lit(None).cast("string")
    return b.df.select(*(F.col(f"`{k}`") for k in d.keys), *(F.when(error.isNull(), v.column).alias(field) for field, v in made), error.alias("_error"))


def keys_of(c: Compiler, d: ir.Derived) -> Bindings:
    b = c.match(d.over)
    if missing := set(d.keys) - set(b.kinds):
        raise KindError(f"{d.name}: {sorted(missing)[0]} is bound by nothing in its domain")
    keys = Bindings(b.df.select(*(F.col(f"`{k}`") for k in d.keys)).distinct(), {k: b.kinds[k] for k in d.keys})
    return replace(keys, unit=False)


def inlined(p: ir.Programme, e):
    """An expression with figures whose arguments are terms written out."""
    if isinstance(e, ir.Figure) and all(isinstance(a, ir.Var | ir.Lit) for a in e.args):
        d = p.defines[e.name]
        own = {n: ir.Var(f"__{d.name}_{n}") for n in ir.variables(d.body)}
        return inlined(p, ir.substitute(d.body, {**own, **dict(zip(d.params, e.args, strict=True))}))
    if isinstance(e, ir.Bin):
        return replace(e, left=inlined(p, e.left), right=inlined(p, e.right))
    if isinstance(e, ir.Builtin):
        return replace(e, args=tuple(inlined(p, a) for a in e.args))
    return e


def rewritten(e, by: dict):
    if e in by:
        return by[e]
    if isinstance(e, ir.Bin):
        return replace(e, left=rewritten(e.left, by), right=rewritten(e.right, by))
    if isinstance(e, ir.Builtin):
        return replace(e, args=tuple(rewritten(a, by) for a in e.args))
    return e


def sums_in(e) -> list[ir.Sum]:
    if isinstance(e, ir.Sum):
        return [e]
    return [s for child in ((e.left, e.right) if isinstance(e, ir.Bin) else e.args if isinstance(e, ir.Builtin) else ()) for s in sums_in(child)]


def fused(c: Compiler, b: Bindings, values: tuple) -> tuple[Bindings, tuple]:
    """Sums over one pattern each, of the same predicate and by the same keys, in one scan and shuffle.

    Their literals become conditions of the summands. Sums with other bodies stay as they are.
    """
    values = tuple((field, inlined(c.programme, e)) for field, e in values)
    groups: dict[tuple, list[ir.Sum]] = {}
    for _, e in values:
        for s in sums_in(e):
            p = s.body
            if not isinstance(p, ir.Claim) or p.predicate not in c.claims:
                continue
            names = [a.name for a in p.args if isinstance(a, ir.Var)]
            keys = tuple((i, a.name) for i, a in enumerate(p.args) if isinstance(a, ir.Var) and a.name in b.kinds)
            plain = len(names) == len(set(names)) and all(isinstance(a, ir.Var | ir.Wild | ir.Lit) for a in p.args)
            inside = isinstance(s.target, ir.Lit) or isinstance(s.target, ir.Var) and s.target.name in names
            if plain and inside and keys and not any(n in c.constants for n in names):
                groups.setdefault((p.predicate, keys), []).append(s)
    by = {}
    for (predicate, keys), sums in groups.items():
        sums = list(dict.fromkeys(sums))
        if len(sums) < 2:
            continue
        df = c.claims[predicate]
        kinds = c.kinds_of(predicate, df)
        made, kinds_out = [], {}
        for s in sums:
            test = F.lit(True)
            for i, a in enumerate(s.body.args):
                if isinstance(a, ir.Lit):
                    test = test & (F.col(f"`{df.columns[i]}`") == literal(a.kind, a.value))
            at = None if isinstance(s.target, ir.Lit) else s.body.args.index(s.target)
            kind = s.target.kind if at is None else kinds[at]
            if kind not in ("Decimal", "Duration"):
                raise KindError(f"{kind} can't be summed")
            target = literal(s.target.kind, s.target.value) if at is None else F.col(f"`{df.columns[at]}`")
            name = c.name("s")
            made.append(F.sum(F.when(test, target)).alias(name))
            kinds_out[name] = kind
            by[s] = ir.Var(name)
        hidden = {n: c.name("g") for _, n in keys}
        grouped = df.groupBy(*(F.col(f"`{df.columns[i]}`").alias(hidden[n]) for i, n in keys)).agg(*made)
        b = c.joined(b, grouped, [n for _, n in keys], hidden)
        b = Bindings(b.df.withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in kinds_out}), {**b.kinds, **kinds_out})
    return b, tuple((field, rewritten(e, by)) for field, e in values)


def figure(c: Compiler, e, over=None, **columns: str) -> DataFrame:
    """Values of expressions over bindings, for reading: ``figure(c, {"x": expr}, over=prop)``."""
    b = c.match(over) if over is not None else c.one()
    names = list(b.kinds)
    made = []
    for field, expression in e.items():
        b, v = c.value(expression, b)
        made.append(c.checked(v).alias(field))
    return b.df.select(*(F.col(f"`{n}`") for n in names), *made)
