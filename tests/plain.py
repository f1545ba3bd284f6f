"""The language read plainly: one binding at a time, over Python lists. Only tests use it."""

from decimal import Decimal

from claimspark.lang import ir
from claimspark.lang.lower import is_recursive


class Fault(Exception):
    pass


class Plain:
    def __init__(self, programme, claims, pre=None):
        self.programme, self.claims, self.pre = programme, claims, pre

    def match(self, p, b):
        """All bindings (dicts) that extend ``b``; a bag."""
        if isinstance(p, ir.Claim):
            return self.rows(self.claims[p.predicate], p.args, b)
        if isinstance(p, ir.And):
            out = [b]
            for item in p.items:
                out = [y for x in out for y in self.match(item, x)]
            return out
        if isinstance(p, ir.Or):
            made = [self.match(item, b) for item in p.items]
            common = set.intersection(*(self.names(item, set(b)) for item in p.items))
            return [{k: x[k] for k in common} for m in made for x in m]
        if isinstance(p, ir.Not):
            return [] if self.match(p.inner, b) else [b]
        if isinstance(p, ir.Exists):
            return [b] if self.match(p.inner, b) else []
        if isinstance(p, ir.Implies):
            return [b] if all(self.match(p.right, x) for x in self.match(p.left, b)) else []
        if isinstance(p, ir.Forall):
            return [b] if all(self.match(p.body, x) for x in self.match(p.source, b)) else []
        if isinstance(p, ir.Xor):
            return [b] if bool(self.match(p.left, b)) != bool(self.match(p.right, b)) else []
        if isinstance(p, ir.Pre):
            return Plain(self.programme, self.pre).match(p.inner, b)
        if isinstance(p, ir.Compare):
            x, y = self.value(p.left, b), self.value(p.right, b)
            ok = {"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y} if type(x) is type(y) and not isinstance(x, str) else {"=": x == y, "!=": x != y}
            return [b] if ok[p.op] else []
        if isinstance(p, ir.In):
            values = self.value(p.source, b)
            if isinstance(p.item, ir.Var) and p.item.name not in b:
                return [{**b, p.item.name: v} for v in values]
            return [b] if self.value(p.item, b) in values else []
        if isinstance(p, ir.Call):
            d = self.programme.defines[p.name]
            found = self.fixpoint(d) if is_recursive(d) else None
            if found is None:
                given = {q: self.value(a, b) for q, a in zip(d.params, p.args, strict=True) if isinstance(a, ir.Lit) or isinstance(a, ir.Var) and a.name in b}
                found = {tuple(x[q] for q in d.params) for x in self.match(d.body, given)}
            return self.rows(sorted(found, key=repr), p.args, b)
        raise Fault(p)

    def fixpoint(self, d):
        known, size = set(), -1
        while len(known) != size:
            size = len(known)

            def body(p, b):
                if isinstance(p, ir.Call) and p.name == d.name:
                    return self.rows(sorted(known, key=repr), p.args, b)
                if isinstance(p, ir.And):
                    out = [b]
                    for item in p.items:
                        out = [y for x in out for y in body(item, x)]
                    return out
                if isinstance(p, ir.Or):
                    return [x for item in p.items for x in body(item, b)]
                return self.match(p, b)

            known |= {tuple(x[q] for q in d.params) for x in body(d.body, {})}
        return known

    def names(self, p, b):
        from claimspark.plans.compiler import bound_by

        return bound_by(p, b, self.programme)

    def rows(self, rows, args, b):
        out = []
        for row in rows:
            x = dict(b)
            for a, v in zip(args, row, strict=True):
                if isinstance(a, ir.Wild):
                    continue
                if isinstance(a, ir.Lit):
                    if a.value != v:
                        break
                elif x.setdefault(a.name, v) != v:
                    break
            else:
                out.append(x)
        return out

    def value(self, e, b):
        if isinstance(e, ir.Lit):
            return e.value
        if isinstance(e, ir.Var):
            return b[e.name]
        if isinstance(e, ir.Bin):
            x, y = self.value(e.left, b), self.value(e.right, b)
            return {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y}[e.op]()
        if isinstance(e, ir.Sum):
            return sum((self.value(e.target, x) for x in self.match(e.body, b)), Decimal(0))
        if isinstance(e, ir.Extremum):
            values = [self.value(e.target, x) for x in self.match(e.body, b)]
            if not values:
                raise Fault("empty_extremum")
            return (max if e.which == "max" else min)(values)
        if isinstance(e, ir.ValueOf):
            wanted = next(i for i, a in enumerate(e.claim.args) if isinstance(a, ir.Wanted))
            args = tuple(ir.Var("?") if i == wanted else a for i, a in enumerate(e.claim.args))
            found = self.rows(self.claims[e.claim.predicate], args, b)
            if len(found) > 1:
                raise Fault("value_ambiguous")
            if not found and e.default is None:
                raise Fault("value_missing")
            return found[0]["?"] if found else self.value(e.default, b)
        if isinstance(e, ir.IfValue):
            return self.value(e.then if self.match(e.test, b) else e.other, b)
        if isinstance(e, ir.Builtin) and e.name in ("min", "max", "abs"):
            return {"min": min, "max": max, "abs": abs}[e.name](*(self.value(a, b) for a in e.args))
        if isinstance(e, ir.Figure):
            d = self.programme.defines[e.name]
            return self.value(d.body, {q: self.value(a, b) for q, a in zip(d.params, e.args, strict=True)})
        raise Fault(e)
