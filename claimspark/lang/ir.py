"""The tree of a programme. Everything is a frozen dataclass; nothing here knows of Spark."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from typing import Any

# --- terms ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Wild:
    pass


@dataclass(frozen=True)
class Lit:
    kind: str
    value: Any
    unit: str | None = None


@dataclass(frozen=True)
class Wanted:
    """The field that ``value P(..)`` reads."""


ACTOR, DECIDED_AT = Var("actor"), Var("decided_at")

# --- values --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Bin:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Sum:
    target: Any
    body: Any


@dataclass(frozen=True)
class Extremum:
    which: str
    target: Any
    body: Any


@dataclass(frozen=True)
class ValueOf:
    claim: Claim
    default: Any = None


@dataclass(frozen=True)
class IfValue:
    test: Any
    then: Any
    other: Any


@dataclass(frozen=True)
class Builtin:
    name: str
    args: tuple


@dataclass(frozen=True)
class Figure:
    name: str
    args: tuple


@dataclass(frozen=True)
class New:
    pass


# --- propositions --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Claim:
    predicate: str
    args: tuple


@dataclass(frozen=True)
class And:
    items: tuple


@dataclass(frozen=True)
class Or:
    items: tuple


@dataclass(frozen=True)
class Not:
    inner: Any


@dataclass(frozen=True)
class Exists:
    inner: Any


@dataclass(frozen=True)
class Implies:
    left: Any
    right: Any


@dataclass(frozen=True)
class Forall:
    source: Any
    body: Any


@dataclass(frozen=True)
class Xor:
    left: Any
    right: Any


@dataclass(frozen=True)
class Pre:
    inner: Any


@dataclass(frozen=True)
class Compare:
    op: str  # = != < <= > >=
    left: Any
    right: Any
    domain: str | None = None  # a kind that the comparator's spelling asks for


@dataclass(frozen=True)
class In:
    item: Any
    source: Any


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


# --- statements ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Require:
    prop: Any
    name: str | None = None


@dataclass(frozen=True)
class Bind:
    prop: Any
    name: str | None = None


@dataclass(frozen=True)
class Let:
    name: str
    value: Any


@dataclass(frozen=True)
class Admit:
    predicate: str
    args: tuple


@dataclass(frozen=True)
class Emit:
    intent: str
    args: tuple


@dataclass(frozen=True)
class Retract:
    claim: Claim


@dataclass(frozen=True)
class For:
    name: str
    source: Any
    body: tuple


@dataclass(frozen=True)
class ForClaim:
    claim: Claim
    body: tuple


@dataclass(frozen=True)
class Choose:
    test: Any
    then: tuple
    other: tuple = ()


# --- declarations --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    unit: str | None = None


@dataclass(frozen=True)
class Effective:
    keys: tuple
    on: str
    partial: bool = False


@dataclass(frozen=True)
class Predicate:
    name: str
    fields: tuple
    unique: tuple = ()  # tuples of field names
    append_only: bool = False
    pointer: tuple | None = None
    superseded_via: str | None = None
    effective: Effective | None = None

    def names(self) -> list[str]:
        return [f.name for f in self.fields]


@dataclass(frozen=True)
class Define:
    name: str
    params: tuple
    body: Any
    figure: bool = False


@dataclass(frozen=True)
class Invariant:
    name: str
    body: Any
    total_over: str | None = None
    generated: bool = False


@dataclass(frozen=True)
class Transformation:
    name: str
    params: tuple  # (name, kind or None)
    body: tuple


@dataclass(frozen=True)
class Derived:
    name: str
    keys: tuple
    over: Any
    values: tuple = ()  # (field, expression)


@dataclass(frozen=True)
class Programme:
    name: str
    predicates: dict = field(default_factory=dict)
    intents: dict = field(default_factory=dict)
    defines: dict = field(default_factory=dict)
    invariants: tuple = ()
    transformations: dict = field(default_factory=dict)
    derived: dict = field(default_factory=dict)


# --- walking -------------------------------------------------------------------------------------


def children(node: Any) -> list:
    """The nodes right under a node."""
    if isinstance(node, tuple):
        return list(node)
    if hasattr(node, "__dataclass_fields__"):
        return [v for f in fields(node) if not isinstance(v := getattr(node, f.name), str | bool | int | type(None) | dict)]
    return []


def walk(node: Any):
    yield node
    for child in children(node):
        yield from walk(child)


def variables(node: Any) -> set[str]:
    """Names of all variables anywhere in a node."""
    return {n.name for n in walk(node) if isinstance(n, Var)}


def predicates(node: Any) -> set[str]:
    return {n.predicate for n in walk(node) if isinstance(n, Claim)}


def substitute(node: Any, by: dict[str, Any]) -> Any:
    """The node with variables replaced by terms."""
    if isinstance(node, Var):
        return by.get(node.name, node)
    if isinstance(node, tuple):
        return tuple(substitute(x, by) for x in node)
    if hasattr(node, "__dataclass_fields__") and not isinstance(node, Lit):
        return replace(node, **{f.name: substitute(getattr(node, f.name), by) for f in fields(node) if isinstance(getattr(node, f.name), tuple) or hasattr(getattr(node, f.name), "__dataclass_fields__")})
    return node
