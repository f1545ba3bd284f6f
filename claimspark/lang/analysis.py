"""What can be said of a programme without running it: reads, guarantees, controls and lints."""

from __future__ import annotations

from dataclasses import dataclass

from . import ir
from .lower import is_recursive


def statements(body: tuple):
    for s in body:
        yield s
        for part in ("body", "then", "other"):
            yield from statements(getattr(s, part, ()))


def reads(node, p: ir.Programme, seen: frozenset = frozenset()) -> set[str]:
    """Predicates that a node reads, through the definitions that it calls."""
    out = ir.predicates(node)
    for x in ir.walk(node):
        if isinstance(x, ir.Call | ir.Figure) and x.name not in seen and x.name in p.defines:
            out |= reads(p.defines[x.name].body, p, seen | {x.name})
    return out


def writes(t: ir.Transformation) -> set[str]:
    return {s.predicate for s in statements(t.body) if isinstance(s, ir.Admit)} | {s.claim.predicate for s in statements(t.body) if isinstance(s, ir.Retract)}


def suppliers(p: ir.Programme, predicate: str) -> list[str]:
    """Acts that admit claims of a predicate."""
    return [t.name for t in p.transformations.values() if any(isinstance(s, ir.Admit) and s.predicate == predicate for s in statements(t.body))]


def guarantees(p: ir.Programme) -> dict[str, list[str]]:
    """For each predicate, the rules that speak of it."""
    return {q: [i.name for i in p.invariants if q in reads(i.body, p)] for q in p.predicates}


def sides(rule: ir.Invariant):
    if isinstance(rule.body, ir.Implies):
        return rule.body.left, rule.body.right
    if isinstance(rule.body, ir.Forall):
        return rule.body.source, rule.body.body
    return None


def controls(p: ir.Programme) -> dict[tuple[str, str], str]:
    """(act, rule) -> front_loaded if a gate of the act asks beforehand what the rule asks, backstop if
    only the rule would refuse it; rules that no act can touch are dormant under the act ''."""
    out: dict[tuple[str, str], str] = {}
    for rule in p.invariants:
        parts = sides(rule)
        if parts is None:
            continue
        asked, touched = reads(parts[1], p), reads(parts[0], p)
        hit = False
        for t in p.transformations.values():
            admits = {s.predicate for s in statements(t.body) if isinstance(s, ir.Admit)}
            if not admits & touched:
                continue
            hit = True
            gates = set().union(*(reads(s.prop, p) for s in t.body if isinstance(s, ir.Require | ir.Bind)), set())
            out[t.name, rule.name] = "front_loaded" if gates & asked else "backstop"
        if not hit:
            out["", rule.name] = "dormant"
    return out


@dataclass(frozen=True)
class Lint:
    kind: str
    where: str
    what: str


def lints(p: ir.Programme) -> list[Lint]:
    """Traps that a programme that is otherwise right may hold."""
    out: list[Lint] = []
    bodies = [(f"invariant {i.name}", i.body) for i in p.invariants if not i.generated]
    bodies += [(f"define {d.name}", d.body) for d in p.defines.values()]
    bodies += [(f"transformation {t.name}", t.body) for t in p.transformations.values()]
    bodies += [(f"derived {d.name}", (d.over, *(e for _, e in d.values))) for d in p.derived.values()]
    for where, body in bodies:
        for node in ir.walk(body):
            if isinstance(node, ir.Sum):
                used = ir.variables(node.target)
                for x in ir.walk(node.body):
                    if isinstance(x, ir.Call) and any(isinstance(a, ir.Wild) for a in x.args) and used & ir.variables(x):
                        out.append(Lint("wildcarded_call_under_sum", where, x.name))
                    if isinstance(x, ir.Or) and not one_of(x):
                        out.append(Lint("overlapping_or_under_sum", where, "or"))
            if isinstance(node, ir.Builtin) and node.name == "periods" and all(isinstance(a, ir.Lit) for a in node.args):
                from datetime import datetime

                start, end = (datetime.fromisoformat(a.value) for a in node.args[:2])
                if (end - start).total_seconds() * 1e6 / node.args[2].value > 10_000:
                    out.append(Lint("large_grid", where, "periods"))
    for rule in p.invariants:
        parts = sides(rule)
        if parts is None or rule.generated:
            continue
        for q in sorted(ir.predicates(parts[0])):
            if not suppliers(p, q) and p.transformations:
                out.append(Lint("unsupplied_antecedent", f"invariant {rule.name}", q))
        from ..plans.rules import impact

        if (why := impact(p, rule).widened) and writes_any(p, reads(rule.body, p)):
            out.append(Lint("change_rechecks_history", f"invariant {rule.name}", why))
    for t in p.transformations.values():
        for s in t.body:
            if isinstance(s, ir.Require) and isinstance(s.prop, ir.Claim):
                later = [x for x in t.body[t.body.index(s) + 1 :] if isinstance(x, ir.Bind) and isinstance(x.prop, ir.Claim) and x.prop.predicate == s.prop.predicate]
                if later:
                    out.append(Lint("require_rematch", f"transformation {t.name}", s.prop.predicate))
            if isinstance(s, ir.Bind) and isinstance(s.prop, ir.Claim):
                rest = t.body[t.body.index(s) + 1 :]
                fresh = ir.variables(s.prop) - {n for n, _ in t.params}
                used = [x for x in rest if fresh & ir.variables(x)]
                if used and all(isinstance(x, ir.Retract) for x in used):
                    out.append(Lint("bind_only_to_retract", f"transformation {t.name}", s.prop.predicate))
    vouched = {i.total_over for i in p.invariants if i.total_over}
    for q in p.predicates.values():
        if q.effective and not q.effective.partial and q.name not in vouched:
            out.append(Lint("effective_without_declared_totality", f"predicate {q.name}", "total over"))
    for d in p.defines.values():
        if is_recursive(d) and not any(isinstance(x, ir.Call) and x.name == d.name for i in p.invariants for x in ir.walk(i.body)) and not any(isinstance(x, ir.Call) and x.name == d.name for t in p.transformations.values() for x in ir.walk(t.body)):
            out.append(Lint("unused_recursion", f"define {d.name}", d.name))
    return out


def one_of(x: ir.Or) -> bool:
    """One variable against different literals: no two branches hold together."""
    left = {c.left for c in x.items if isinstance(c, ir.Compare) and c.op == "=" and isinstance(c.right, ir.Lit)}
    values = [c.right for c in x.items if isinstance(c, ir.Compare) and isinstance(c.right, ir.Lit)]
    return len(left) == 1 and len(values) == len(x.items) == len(set(values))


def writes_any(p: ir.Programme, predicates: set[str]) -> bool:
    return any(writes(t) & predicates for t in p.transformations.values())
