"""Disciplines as rules and definitions, and the checks that a programme makes sense."""

from __future__ import annotations

import re
from dataclasses import replace

from . import ir


def snake(name: str) -> str:
    return re.sub(r"(?<!^)(?=[A-Z])", "_", name).lower()


def unique_rule(p: ir.Predicate, keys: tuple) -> ir.Invariant:
    """Two claims with the same keys are the same claim."""
    if set(keys) - set(p.names()) or not keys or set(keys) == set(p.names()):
        raise ValueError(f"{p.name}: unique by needs some of its fields, not all")
    one = ir.Claim(p.name, tuple(ir.Var(n if n in keys else f"{n}_1") for n in p.names()))
    two = ir.Claim(p.name, tuple(ir.Var(n if n in keys else f"{n}_2") for n in p.names()))
    same = tuple(ir.Compare("=", ir.Var(f"{n}_1"), ir.Var(f"{n}_2")) for n in p.names() if n not in keys)
    return ir.Invariant(f"{snake(p.name)}_unique_by_{'_'.join(keys)}", ir.Implies(ir.And((one, two)), same[0] if len(same) == 1 else ir.And(same)), generated=True)


def in_force(p: ir.Predicate) -> ir.Define:
    """The version of each key in force on a date: the latest that isn't later."""
    e = p.effective
    rest = [n for n in p.names() if n not in e.keys and n != e.on]
    version = ir.Claim(p.name, tuple(ir.Var(n) for n in p.names()))
    later = ir.Claim(p.name, tuple(ir.Var(n) if n in e.keys else ir.Var("later") if n == e.on else ir.Wild() for n in p.names()))
    body = ir.And((
        version, ir.Compare("<=", ir.Var(e.on), ir.Var("as_of"), "Date"),
        ir.Not(ir.And((later, ir.Compare("<=", ir.Var("later"), ir.Var("as_of"), "Date"), ir.Compare(">", ir.Var("later"), ir.Var(e.on), "Date")))),
    ))
    return ir.Define(f"{snake(p.name)}_in_force_on", (*e.keys, "as_of", *rest), body)


def lower(p: ir.Programme) -> ir.Programme:
    defines, rules, predicates = dict(p.defines), [], dict(p.predicates)
    for q in list(predicates.values()):
        if q.superseded_via:
            link = predicates[q.superseded_via]
            prior = link.names()[1]
            predicates[link.name] = replace(link, append_only=True, unique=tuple(dict.fromkeys((*link.unique, (prior,)))))
    for q in predicates.values():
        for keys in dict.fromkeys((*q.unique, *([q.pointer] if q.pointer else []), *([(*q.effective.keys, q.effective.on)] if q.effective else []))):
            if set(keys) != set(q.names()):
                rules.append(unique_rule(q, keys))
        if q.effective:
            defines[f"{snake(q.name)}_in_force_on"] = in_force(q)
    known = {r.name for r in p.invariants}
    return replace(p, predicates=predicates, defines=defines, invariants=(*(r for r in rules if r.name not in known), *p.invariants))


class Invalid(ValueError):
    pass


def check(p: ir.Programme) -> list[str]:
    """Faults of a programme, in words; none means that it can be compiled."""
    faults = []

    def bodies():
        for d in p.defines.values():
            yield f"define {d.name}", d.body
        for i in p.invariants:
            yield f"invariant {i.name}", i.body
        for t in p.transformations.values():
            yield f"transformation {t.name}", t.body
        for d in p.derived.values():
            yield f"derived {d.name}", (d.over, *(e for _, e in d.values))

    for where, body in bodies():
        for node in ir.walk(body):
            if isinstance(node, ir.Claim | ir.Admit):
                q = p.predicates.get(node.predicate)
                if q is None:
                    faults.append(f"{where}: no predicate {node.predicate}")
                elif len(node.args) != len(q.fields):
                    faults.append(f"{where}: {node.predicate} has {len(q.fields)} fields, not {len(node.args)}")
            if isinstance(node, ir.Call | ir.Figure):
                d = p.defines.get(node.name)
                if d is None or d.figure != isinstance(node, ir.Figure):
                    faults.append(f"{where}: no {'figure' if isinstance(node, ir.Figure) else 'condition'} {node.name}")
                elif len(node.args) != len(d.params):
                    faults.append(f"{where}: {node.name} takes {len(d.params)} arguments, not {len(node.args)}")
            if isinstance(node, ir.Retract) and p.predicates.get(node.claim.predicate) and p.predicates[node.claim.predicate].append_only:
                faults.append(f"{where}: {node.claim.predicate} is append only and can't be retracted")
            if isinstance(node, ir.Emit) and node.intent not in p.intents:
                faults.append(f"{where}: no intent {node.intent}")
            if isinstance(node, ir.Pre) and any(isinstance(x, ir.Pre) for x in ir.walk(node.inner)):
                faults.append(f"{where}: pre inside pre")
        if where.startswith("define") and any(isinstance(x, ir.Pre) or x in (ir.ACTOR, ir.DECIDED_AT) for x in ir.walk(body)):
            faults.append(f"{where}: a definition reads neither actor, decided_at nor pre")
        if not where.startswith("transformation") and any(isinstance(x, ir.Claim) and x.predicate in p.derived for x in ir.walk(body)):
            faults.append(f"{where}: a rule can't read a derived claim")
    for d in p.defines.values():
        faults += recursion_faults(d, p)
    return faults


def called(node, p: ir.Programme) -> set[str]:
    return {x.name for x in ir.walk(node) if isinstance(x, ir.Call | ir.Figure)}


def is_recursive(d: ir.Define) -> bool:
    return any(isinstance(x, ir.Call) and x.name == d.name for x in ir.walk(d.body))


def branches(d: ir.Define) -> list:
    return list(d.body.items) if isinstance(d.body, ir.Or) else [d.body]


def recursion_faults(d: ir.Define, p: ir.Programme) -> list[str]:
    faults, seen, todo = [], set(), [n for n in called(d.body, p) if n != d.name]
    while todo:
        n = todo.pop()
        if n == d.name:
            return [f"define {d.name}: two definitions call each other"]
        if n not in seen and n in p.defines:
            seen.add(n)
            todo += called(p.defines[n].body, p)
    if not is_recursive(d):
        return faults
    for branch in branches(d):
        items = branch.items if isinstance(branch, ir.And) else (branch,)
        own = [x for x in items if isinstance(x, ir.Call) and x.name == d.name]
        every = [x for x in ir.walk(branch) if isinstance(x, ir.Call) and x.name == d.name]
        if len(own) != len(every):
            faults.append(f"define {d.name}: it calls itself only as a condition that an and joins")
        if len(own) > 1:
            faults.append(f"define {d.name}: it calls itself once in a branch")
        bound: set[str] = set()
        for x in items:
            if isinstance(x, ir.Claim):
                bound |= ir.variables(x)
            if x in own:
                for a in x.args:
                    if isinstance(a, ir.Var) and a.name not in bound and a.name not in d.params:
                        faults.append(f"define {d.name}: {a.name} is bound by no earlier pattern")
                bound |= {a.name for a in x.args if isinstance(a, ir.Var)}
        if missing := set(d.params) - bound:
            faults.append(f"define {d.name}: {sorted(missing)[0]} comes from no claim pattern")
    return faults


def require_valid(p: ir.Programme) -> ir.Programme:
    if faults := check(p):
        raise Invalid("; ".join(faults))
    return p
