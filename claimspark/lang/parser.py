"""Text to tree: a tokenizer with layout by indentation, and a recursive-descent parser."""

from __future__ import annotations

import re
from dataclasses import replace
from decimal import Decimal

from . import ir

TOKEN = re.compile(
    r"""(?P<space>[ \t]+|--[^\n]*)|(?P<newline>\n)
    |(?P<instant>@\d{4}-\d\d-\d\dT[\d:.]+(?:Z|[+-]\d\d:\d\d))|(?P<date>@-?\d{4,}-\d\d-\d\d)
    |(?P<subject>\#[A-Za-z0-9_][A-Za-z0-9_.:/-]*)|(?P<number>\d+(?:\.\d+)?)|(?P<name>[A-Za-z_][A-Za-z0-9_]*)
    |(?P<op><=|>=|!=|\.\.|[=<>()\[\],:|+\-*/%])""",
    re.X,
)
#: Comparators that ask for a kind: operator and kind.
WORDED = {
    "on_or_before": ("<=", "Date"), "before": ("<", "Date"), "on_or_after": (">=", "Date"), "after": (">", "Date"),
    "at_or_before": ("<=", "Timestamp"), "strictly_before": ("<", "Timestamp"), "at_or_after": (">=", "Timestamp"), "strictly_after": (">", "Timestamp"),
    "no_longer_than": ("<=", "Duration"), "shorter_than": ("<", "Duration"), "no_shorter_than": (">=", "Duration"), "longer_than": (">", "Duration"),
}
BUILTINS = {"abs", "round", "digest", "period_index", "period_start_of", "periods"}
KINDS = {"Subject", "Decimal", "Bool", "Date", "Timestamp", "Duration", "Collection", "Any"}


class SyntaxFault(ValueError):
    def __init__(self, message: str, line: int):
        super().__init__(f"line {line}: {message}")
        self.line = line


def tokens(text: str) -> list[tuple[str, str, int]]:
    """(type, text, line); indentation becomes ``indent`` and ``dedent``, parentheses switch it off."""
    out: list[tuple[str, str, int]] = []
    at, line, depth, stack, fresh, width = 0, 1, 0, [0], True, 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise SyntaxFault(f"unexpected {text[at]!r}", line)
        at, kind, value = m.end(), m.lastgroup, m.group()
        if kind == "newline":
            if not depth:
                if not fresh:
                    out.append(("newline", value, line))
                fresh, width = True, 0
            line += 1
        elif kind == "space":
            if fresh and not value.startswith("--"):
                width = len(value)
        else:
            if fresh and not depth:
                if width > stack[-1]:
                    stack.append(width)
                    out.append(("indent", "", line))
                while width < stack[-1]:
                    stack.pop()
                    out.append(("dedent", "", line))
                if width != stack[-1]:
                    raise SyntaxFault("indentation matches no block", line)
                fresh = False
            depth += (value in ("(", "[")) - (value in (")", "]"))
            out.append((kind, value, line))
    if not fresh:
        out.append(("newline", "", line))
    out += [("dedent", "", line)] * (len(stack) - 1)
    return [*out, ("end", "", line)]


def duration_micros(text: str) -> int:
    m = re.fullmatch(r"(-)?P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?", text)
    if not m or text.rstrip("T") in ("P", "-P"):
        raise ValueError(f"not a duration: {text}")
    d, h, mi, s = (Decimal(x or 0) for x in m.groups()[1:])
    micros = int(((d * 24 + h) * 60 + mi) * 60_000_000 + s * 1_000_000)
    return -micros if m[1] else micros


def span_parts(text: str) -> tuple[int, int]:
    """Months and days of a calendar span."""
    m = re.fullmatch(r"(-)?P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)W)?(?:(\d+)D)?", text)
    if not m or not any(m.groups()[1:]):
        raise ValueError(f"not a calendar span: {text}")
    y, mo, w, d = (int(x or 0) for x in m.groups()[1:])
    sign = -1 if m[1] else 1
    return sign * (12 * y + mo), sign * (7 * w + d)


class Parser:
    def __init__(self, text: str, schemas: dict[str, ir.Predicate] | None = None):
        self.toks, self.at = tokens(text), 0
        self.schemas = dict(schemas or {})
        self.consts: dict = {}
        self.minted = 0

    # --- tokens

    def peek(self, k: int = 0) -> tuple[str, str, int]:
        return self.toks[min(self.at + k, len(self.toks) - 1)]

    def fail(self, message: str):
        raise SyntaxFault(f"{message}, found {self.peek()[1]!r}", self.peek()[2])

    def next(self) -> tuple[str, str, int]:
        self.at += 1
        return self.toks[self.at - 1]

    def sees(self, *values: str) -> bool:
        return self.peek()[1] in values and self.peek()[0] in ("op", "name")

    def accept(self, *values: str) -> bool:
        if self.sees(*values):
            self.at += 1
            return True
        return False

    def expect(self, value: str) -> None:
        if not self.accept(value):
            self.fail(f"expected {value!r}")

    def name(self) -> str:
        if self.peek()[0] != "name":
            self.fail("expected a name")
        return self.next()[1]

    def skip(self, kind: str) -> bool:
        if self.peek()[0] == kind:
            self.at += 1
            return True
        return False

    def listed(self, item, close: str = ")") -> list:
        out = []
        while not self.sees(close):
            out.append(item())
            if not self.accept(","):
                break
        self.expect(close)
        return out

    # --- programme

    def programme(self) -> ir.Programme:
        while self.skip("newline"):
            pass
        self.expect("program")
        title = self.name()
        self.skip("newline")
        self.scan_schemas()
        intents, defines, invariants, acts, derived = {}, {}, [], {}, {}
        while self.peek()[0] != "end":
            word = self.name()
            if word == "predicate":
                p = self.predicate()
                self.schemas[p.name] = p
            elif word == "intent":
                name = self.name()
                self.expect("(")
                intents[name] = tuple(self.listed(self.field))
                self.skip("newline")
            elif word == "const":
                name = self.name()
                self.expect("=")
                self.consts[name] = self.value()
                self.skip("newline")
            elif word == "define":
                d = self.define()
                defines[d.name] = d
            elif word == "invariant":
                invariants.append(self.invariant())
            elif word == "transformation":
                t = self.transformation()
                acts[t.name] = t
            elif word == "derived":
                d = self.derived()
                derived[d.name] = d
            else:
                self.fail(f"unknown declaration {word!r}")
        return ir.Programme(title, {n: q for n, q in self.schemas.items() if n not in intents}, intents, defines, tuple(invariants), acts, derived)

    def scan_schemas(self) -> None:
        """Field names of all predicates and intents first, for patterns that name fields."""
        back = self.at
        while self.peek()[0] != "end":
            if self.peek()[1] in ("predicate", "intent") and self.peek(2)[1] == "(":
                self.next()
                name = self.name()
                self.expect("(")
                self.schemas.setdefault(name, ir.Predicate(name, tuple(self.listed(self.field))))
            else:
                self.next()
        self.at = back

    def field(self) -> ir.Field:
        name = self.name()
        if not self.accept(":"):
            return ir.Field(name, "Any")
        return ir.Field(name, *self.kind())

    def kind(self) -> tuple[str, str | None]:
        kind, unit = self.name(), None
        if kind not in KINDS:
            self.fail(f"unknown kind {kind!r}")
        if self.accept("["):
            unit = self.name()
            self.expect("]")
        return kind, unit

    def names(self) -> tuple:
        self.expect("(")
        return tuple(self.listed(self.name))

    def predicate(self) -> ir.Predicate:
        name = self.name()
        self.expect("(")
        p = ir.Predicate(name, tuple(self.listed(self.field)))
        self.skip("newline")
        if self.skip("indent"):
            while not self.skip("dedent"):
                word = self.name()
                if word == "unique":
                    self.expect("by")
                    p = replace(p, unique=(*p.unique, self.names()))
                elif word == "append":
                    self.expect("only")
                    p = replace(p, append_only=True)
                elif word == "current":
                    self.expect("pointer")
                    self.expect("by")
                    p = replace(p, pointer=self.names())
                elif word == "superseded":
                    self.expect("via")
                    p = replace(p, superseded_via=self.name())
                elif word == "effective":
                    self.expect("by")
                    keys = self.names()
                    self.expect("on")
                    (on,) = self.names()
                    p = replace(p, effective=ir.Effective(keys, on, self.accept("partial")))
                else:
                    self.fail(f"unknown discipline {word!r}")
                self.skip("newline")
        return p

    def define(self) -> ir.Define:
        name, params = self.name(), self.names()
        if self.accept("="):
            body, figure = self.value(), True
            self.skip("newline")
        else:
            self.expect(":")
            body, figure = self.block_prop(), False
        return ir.Define(name, params, body, figure)

    def invariant(self) -> ir.Invariant:
        name, total = self.name(), None
        if self.accept("total"):
            self.expect("over")
            total = self.name()
        self.expect(":")
        return ir.Invariant(name, self.block_prop(), total)

    def block_prop(self):
        """A proposition on this line or as an indented block, after any ``let`` lines."""
        self.skip("newline")
        indented, lets = self.skip("indent"), {}
        while indented and self.sees("let") and self.peek(2)[1] == "=":
            self.next()
            name = self.name()
            self.expect("=")
            lets[name] = ir.substitute(self.value(), lets)
            self.skip("newline")
        out = self.prop()
        depth = int(indented)
        # An operator may open the next line of a block, deeper or not.
        while True:
            mark = self.at
            self.skip("newline")
            if self.skip("indent"):
                depth += 1
            if self.sees("implies", "or", "and", "xor"):
                out = self.continued(out)
            else:
                self.at = mark
                break
        self.skip("newline")
        for _ in range(depth):
            if not self.skip("dedent"):
                self.fail("expected the end of the block")
        return ir.substitute(out, lets)

    def continued(self, left):
        if self.accept("implies"):
            return ir.Implies(left, self.prop())
        word = self.next()[1]
        right = self.prop()
        if isinstance(right, ir.Implies):
            return ir.Implies(self.joined(word, left, right.left), right.right)
        return self.joined(word, left, right)

    def joined(self, word: str, left, right):
        if word == "xor":
            return ir.Xor(left, right)
        kind = ir.And if word == "and" else ir.Or
        return kind((*(left.items if isinstance(left, kind) else (left,)), *(right.items if isinstance(right, kind) else (right,))))

    def transformation(self) -> ir.Transformation:
        name = self.name()
        self.expect("(")
        params = self.listed(self.field)
        self.expect(":")
        return ir.Transformation(name, tuple((f.name, None if f.kind == "Any" else f.kind) for f in params), self.block())

    def block(self) -> tuple:
        self.skip("newline")
        if not self.skip("indent"):
            self.fail("expected an indented block")
        out: list = []
        while not self.skip("dedent"):
            out += self.statement()
        return tuple(out)

    def label(self) -> str | None:
        if self.peek()[0] == "name" and self.peek(1)[1] == ":" and self.peek()[1] not in self.schemas:
            name = self.name()
            self.expect(":")
            return name
        return None

    def statement(self) -> list:
        word = self.name()
        if word in ("require", "bind"):
            label = self.label()
            return [(ir.Require if word == "require" else ir.Bind)(self.block_prop(), label)]
        if word == "let":
            name = self.name()
            self.expect("=")
            value = self.value()
            self.skip("newline")
            return [ir.Let(name, value)]
        if word in ("admit", "emit"):
            name = self.name()
            self.expect("(")
            minted: list = []
            args = self.arguments(name, lambda: self.minting(minted), "a value")
            self.skip("newline")
            return [*minted, (ir.Admit if word == "admit" else ir.Emit)(name, args)]
        if word == "retract":
            name = self.name()
            self.expect("(")
            claim = ir.Claim(name, self.arguments(name, self.term))
            self.skip("newline")
            return [ir.Retract(claim)]
        if word == "for":
            if self.peek()[1] in self.schemas and self.peek(1)[1] == "(":
                name = self.name()
                self.expect("(")
                claim = ir.Claim(name, self.arguments(name, self.term))
                self.expect(":")
                return [ir.ForClaim(claim, self.block())]
            name = self.name()
            self.expect("in")
            source = self.value()
            self.expect(":")
            return [ir.For(name, source, self.block())]
        if word == "if":
            test = self.prop()
            self.expect(":")
            then, other = self.block(), ()
            if self.accept("else"):
                self.expect(":")
                other = self.block()
            return [ir.Choose(test, then, other)]
        return self.fail(f"unknown statement {word!r}")

    def minting(self, minted: list):
        if self.sees("new"):
            self.value()
            self.minted += 1
            minted.append(ir.Let(f"minted_{self.minted}", ir.New()))
            return ir.Var(f"minted_{self.minted}")
        return self.value()

    def derived(self) -> ir.Derived:
        name, keys = self.name(), self.names()
        self.expect(":")
        self.skip("newline")
        if not self.skip("indent"):
            self.fail("expected an indented block")
        self.expect("over")
        over, values = self.block_prop(), []
        while not self.skip("dedent"):
            self.expect("value")
            field = self.name()
            self.expect("=")
            values.append((field, self.value()))
            self.skip("newline")
        return ir.Derived(name, keys, over, tuple(values))

    # --- propositions, from loose to tight

    def prop(self):
        left = self.disjunction()
        return ir.Implies(left, self.prop()) if self.accept("implies") else left

    def many(self, word: str, inner, kind):
        items = [inner()]
        while self.accept(word):
            items.append(inner())
        if len(items) == 1:
            return items[0]
        return kind(tuple(y for x in items for y in (x.items if isinstance(x, kind) else (x,))))

    def disjunction(self):
        return self.many("or", self.exclusive, ir.Or)

    def exclusive(self):
        out = self.conjunction()
        while self.accept("xor"):
            out = ir.Xor(out, self.conjunction())
        return out

    def conjunction(self):
        return self.many("and", self.negation, ir.And)

    def negation(self):
        return ir.Not(self.negation()) if self.accept("not") else self.atom()

    def atom(self):
        if self.sees("exists", "forall"):
            word, name = self.next()[1], self.name()
            source = None
            if word == "forall":
                self.expect("in")
                if self.peek()[1] in self.schemas and self.peek(1)[1] == "(":
                    source = self.claim_or_call()
                else:
                    source = ir.In(ir.Var(name), self.value())
            self.expect(":")
            body = self.prop()
            return ir.Forall(source, body) if source else ir.Exists(body)
        if self.sees("pre") and self.peek(1)[1] == "(":
            self.next()
            self.expect("(")
            inner = self.prop()
            self.expect(")")
            return ir.Pre(inner)
        mark = self.at
        if self.peek()[0] == "name" and self.peek(1)[1] == "(" and self.peek()[1] not in BUILTINS | {"sum", "min", "max", "if", "duration", "span"}:
            made = self.claim_or_call()
            if not (self.comparator() or self.sees("in", "+", "-", "*", "/", "%")):
                return made
            self.at = mark
        elif self.sees("("):
            try:
                self.next()
                inner = self.prop()
                self.expect(")")
                if not (self.comparator() or self.sees("in", "+", "-", "*", "/", "%")):
                    return inner
            except SyntaxFault:
                pass
            self.at = mark
        return self.comparison()

    def comparator(self) -> tuple[str, str | None] | None:
        value = self.peek()[1]
        if value in ("=", "!=", "<", "<=", ">", ">="):
            return value, None
        return WORDED.get(value) if self.peek()[0] == "name" else None

    def comparison(self):
        left = self.value()
        if self.accept("in"):
            if self.sees("("):
                self.expect("(")
                return ir.Or(tuple(ir.Compare("=", left, x) for x in self.listed(self.value)))
            return ir.In(left, self.value())
        found = []
        while op := self.comparator():
            self.next()
            right = self.value()
            found.append(ir.Compare(op[0], left, right, op[1]))
            left = right
        if not found:
            self.fail("expected a comparison")
        if len(found) > 1 and len({x.op[0] for x in found}) > 1 or len(found) > 1 and found[0].op in ("=", "!="):
            self.fail("a chain of comparisons points one way")
        return found[0] if len(found) == 1 else ir.And(tuple(found))

    def claim_or_call(self):
        name = self.name()
        self.expect("(")
        args = self.arguments(name, self.term)
        return ir.Claim(name, args) if name in self.schemas else ir.Call(name, args)

    def arguments(self, name: str, item, what: str = "a term") -> tuple:
        """Positional, or named with ``..`` for the rest."""
        if not (self.peek()[0] == "name" and self.peek(1)[1] == ":") and not self.sees(".."):
            return tuple(self.listed(item))
        given, rest = {}, False
        while not self.sees(")"):
            if self.accept(".."):
                rest = True
            else:
                key = self.name()
                self.expect(":")
                given[key] = item()
            if not self.accept(","):
                break
        self.expect(")")
        return ("named", tuple(given.items()), rest) if name not in self.schemas else self.ordered(name, given, rest)

    def ordered(self, name: str, given: dict, rest: bool) -> tuple:
        names = self.schemas[name].names()
        if unknown := set(given) - set(names):
            self.fail(f"{name} has no field {sorted(unknown)[0]!r}")
        if not rest and len(given) < len(names):
            self.fail(f"{name} needs all its fields, or '..'")
        return tuple(given.get(n, ir.Wild()) for n in names)

    def term(self):
        if self.accept("_"):
            return ir.Wild()
        return self.value()

    # --- values

    def value(self):
        out = self.product()
        while self.sees("+", "-"):
            out = ir.Bin(self.next()[1], out, self.product())
        return out

    def product(self):
        out = self.factor()
        while self.sees("*", "/", "%"):
            out = ir.Bin(self.next()[1], out, self.factor())
        return out

    def inner(self, *parts):
        self.expect("(")
        out = []
        for i, part in enumerate(parts):
            if i:
                self.expect(",")
            out.append(part())
        self.expect(")")
        return out

    def factor(self):
        kind, text, _ = self.peek()
        if self.accept("-"):
            return ir.Bin("-", ir.Lit("Decimal", Decimal(0)), self.factor())
        if self.accept("("):
            out = self.value()
            self.expect(")")
            return out
        if kind == "number":
            self.next()
            unit = None
            if self.peek()[0] == "name" and self.peek()[1] not in WORDED and self.peek()[1] not in {"and", "or", "xor", "implies", "in", "default", "else", "partial"}:
                unit = self.name()
            return ir.Lit("Decimal", Decimal(text), unit)
        if kind == "subject":
            return ir.Lit("Subject", self.next()[1][1:])
        if kind == "date":
            return ir.Lit("Date", self.next()[1][1:])
        if kind == "instant":
            return ir.Lit("Timestamp", self.next()[1][1:])
        if kind != "name":
            return self.fail("expected a value")
        if text in ("true", "false"):
            self.next()
            return ir.Lit("Bool", text == "true")
        if text in ("duration", "span") and self.peek(1)[1] == "(":
            self.next()
            self.expect("(")
            sign = "-" if self.accept("-") else ""
            word = sign + self.name()
            while not self.accept(")"):
                word += self.next()[1]
            return ir.Lit("Duration", duration_micros(word)) if text == "duration" else ir.Lit("Span", span_parts(word))
        if text == "new":
            self.next()
            if self.name() != "Subject":
                self.fail("only subjects are new")
            self.inner()
            return ir.New()
        if text == "value" and self.peek(1)[1] in self.schemas:
            self.next()
            name = self.name()
            self.expect("(")
            args = tuple(ir.Wanted() if isinstance(a, ir.Wild) else a for a in self.arguments(name, self.term))
            if sum(isinstance(a, ir.Wanted) for a in args) != 1:
                self.fail("value reads exactly one field")
            return ir.ValueOf(ir.Claim(name, args), self.value() if self.accept("default") else None)
        if text in ("sum", "max", "min") and self.peek(1)[1] == "(":
            self.next()
            self.expect("(")
            first = self.value()
            if self.accept("|"):
                body = self.prop()
                self.expect(")")
                return ir.Sum(first, body) if text == "sum" else ir.Extremum(text, first, body)
            self.expect(",")
            return ir.Builtin(text, (first, *self.listed(self.value)))
        if text == "if" and self.peek(1)[1] == "(":
            self.next()
            return ir.IfValue(*self.inner(self.prop, self.value, self.value))
        self.next()
        if self.accept("("):
            args = tuple(self.listed(self.value))
            return ir.Builtin(text, args) if text in BUILTINS else ir.Figure(text, args)
        return self.consts.get(text, ir.Var(text))


def parse(text: str) -> ir.Programme:
    """A programme from its text, definitions' calls with named arguments put in order."""
    programme = Parser(text).programme()
    return order_calls(programme)


def parse_prop(text: str, programme: ir.Programme | None = None):
    parser = Parser(text, programme.predicates if programme else {})
    out = parser.prop()
    parser.skip("newline")
    if parser.peek()[0] != "end":
        parser.fail("expected the end")
    return order_args(out, programme.defines) if programme else out


def parse_value(text: str, programme: ir.Programme | None = None):
    parser = Parser(text, programme.predicates if programme else {})
    out = parser.value()
    return order_args(out, programme.defines) if programme else out


def order_args(node, defines: dict):
    if isinstance(node, ir.Call) and node.args[:1] == ("named",):
        _, given, rest = node.args
        params = defines[node.name].params
        by = dict(given)
        if set(by) - set(params) or not rest and len(by) < len(params):
            raise ValueError(f"{node.name} takes {', '.join(params)}")
        return ir.Call(node.name, tuple(by.get(p, ir.Wild()) for p in params))
    if isinstance(node, tuple):
        return tuple(order_args(x, defines) for x in node)
    if hasattr(node, "__dataclass_fields__") and not isinstance(node, ir.Lit):
        changed = {}
        for f in ir.fields(node):
            v = getattr(node, f.name)
            if isinstance(v, tuple) or hasattr(v, "__dataclass_fields__"):
                changed[f.name] = order_args(v, defines)
        return replace(node, **changed) if changed else node
    return node


def order_calls(p: ir.Programme) -> ir.Programme:
    from .lower import lower

    lowered = lower(p)
    each = lambda x: order_args(x, lowered.defines)
    return replace(
        lowered,
        defines={k: each(v) for k, v in lowered.defines.items()},
        invariants=tuple(map(each, lowered.invariants)),
        transformations={k: replace(v, body=each(v.body)) for k, v in lowered.transformations.items()},
        derived={k: replace(v, over=each(v.over), values=tuple((n, each(e)) for n, e in v.values)) for k, v in lowered.derived.items()},
    )
