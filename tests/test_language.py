import pytest

from claimspark.lang import ir
from claimspark.lang.lower import check
from claimspark.lang.parser import SyntaxFault, duration_micros, parse, parse_prop, parse_value, span_parts

BASE = """
program t
predicate A(x: Subject, n: Decimal)
predicate B(x: Subject, on: Date, qty: Decimal[t])
    effective by (x) on (on)
predicate Log(x: Subject)
    append only
intent Told(x: Subject)
const one = (1)
"""


def test_layout_named_patterns_and_statements():
    p = parse(BASE + """
transformation act(x, n: Decimal):
    require held: A(x: x, ..)
    bind A(x, m)
    if m > one and (n >
            2):
        admit A(new Subject(), n)
    else:
        retract A(x: x, ..)
""")
    act = p.transformations["act"]
    assert act.params == (("x", None), ("n", "Decimal"))
    assert act.body[0] == ir.Require(ir.Claim("A", (ir.Var("x"), ir.Wild())), "held")
    assert isinstance(act.body[2], ir.Choose) and isinstance(act.body[2].then[0], ir.Let) and isinstance(act.body[2].other[0], ir.Retract)
    assert check(p) == []


def test_effective_becomes_a_definition_and_a_rule():
    p = parse(BASE)
    assert p.defines["b_in_force_on"].params == ("x", "as_of", "qty")
    assert [i.name for i in p.invariants] == ["b_unique_by_x_on"]


def test_precedence():
    parts = parse_prop("a = 1 or b = 2 and not c = 3 implies d = 4 implies e = 5")
    assert isinstance(parts, ir.Implies) and isinstance(parts.right, ir.Implies)
    assert isinstance(parts.left, ir.Or) and isinstance(parts.left.items[1], ir.And)
    assert parse_value("1 + 2 * 3 - 4") == parse_value("(1 + (2 * 3)) - 4")
    assert isinstance(parse_prop("(a + 1) * 2 <= b"), ir.Compare)
    assert isinstance(parse_prop("1 <= x <= 3"), ir.And)
    assert parse_prop("d on_or_before @2024-01-31") == ir.Compare("<=", ir.Var("d"), ir.Lit("Date", "2024-01-31"), "Date")


def test_durations_and_spans():
    assert duration_micros("PT1H30M") == 5_400_000_000 and duration_micros("-P1DT0.5S") == -86_400_500_000
    assert span_parts("P1Y2M3W4D") == (14, 25) and span_parts("-P1M") == (-1, 0)


@pytest.mark.parametrize("text", ["predicate", "invariant i:\n    A(x", "transformation t():\n  admit A(x, 1)\n bad", "invariant i: 1 < 2 > 1", "invariant i: 3"])
def test_syntax_faults_name_the_line(text):
    with pytest.raises(SyntaxFault, match="line"):
        parse("program p\npredicate A(x: Subject, n: Decimal)\n" + text)


@pytest.mark.parametrize(
    ("text", "fault"),
    [
        ("invariant i: Missing(x)", None),
        ("transformation t(x):\n    retract Log(x)", "append only"),
        ("transformation t(x):\n    emit Unknown(x)", "no intent"),
        ("invariant i: A(x, n) and nope(x)", "no condition"),
        ("define d(x):\n    A(x, _) or d(x) and d(x)", "once in a branch"),
        ("define d(x):\n    A(x, _) or not d(x)", "only as a condition"),
        ("define d(x):\n    A(x, _) and pre(A(x, _))", "neither actor"),
        ("define d(x):\n    A(x, _) and e(x)\ndefine e(x):\n    A(x, _) and d(x)", "call each other"),
    ],
)
def test_faults_of_programmes(text, fault):
    faults = check(parse(BASE + text))
    assert faults if fault is None else any(fault in f for f in faults), faults


def test_controls_and_lints():
    from claimspark.lang.analysis import controls, guarantees, lints, suppliers

    p = parse("""
program c
predicate A(x: Subject, n: Decimal)
predicate B(x: Subject, n: Decimal)
predicate C(x: Subject)
define both(x, n):
    A(x, n) and B(x, _)
transformation front(x):
    require B(x, _)
    admit A(x, 1)
transformation back(x):
    admit A(x, 2)
invariant a_has_b:
    A(x, _) implies (exists n: B(x, n))
invariant c_is_quiet:
    C(x) implies sum(n | both(_, n)) + sum(n | A(x, n) and (n > 0 or n < 9)) > 0
""")
    assert controls(p) == {("front", "a_has_b"): "front_loaded", ("back", "a_has_b"): "backstop", ("", "c_is_quiet"): "dormant"}
    assert suppliers(p, "A") == ["front", "back"] and guarantees(p)["C"] == ["c_is_quiet"]
    kinds = {x.kind for x in lints(p)}
    assert {"wildcarded_call_under_sum", "overlapping_or_under_sum", "unsupplied_antecedent"} <= kinds
