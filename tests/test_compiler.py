"""Compiled plans against the language read plainly, on small states full of coincidences."""

from collections import Counter
from decimal import Decimal

import pytest

from claimspark.kinds import KindError
from claimspark.lang.parser import parse, parse_prop, parse_value
from claimspark.plans import rules
from claimspark.plans.compiler import Compiler, Unbound
from claimspark.plans.derived import derived, figure, live
from plain import Fault, Plain

PROGRAMME = parse("""
program small
predicate P(a: Subject, b: Subject, n: Decimal)
predicate Q(a: Subject, n: Decimal)
    unique by (a)
predicate E(x: Subject, y: Subject)
predicate S(a: Subject, items: Collection)
predicate Row(a: Subject, total: Decimal, top: Decimal)

define linked(x, y):
    E(x, y) or E(y, x)
define above(x, y):
    E(x, y)
    or (E(x, z) and above(z, y))
define within(a, limit):
    P(a, _, n) and n <= limit
define total(a) = (sum(n | P(a, _, n)) + value Q(a, _) default 0)

derived Row(a):
    over P(a, _, _)
    value total = total(a)
    value top = max(n | Q(a, n))

invariant capped:
    Q(a, cap) implies sum(n | P(a, _, n)) <= cap
invariant known:
    P(a, b, _) implies (exists n: Q(b, n))
invariant no_loops:
    E(x, _) implies not above(x, x)
""")

PROPS = [
    "P(a, b, n)", "P(a, a, _)", "P(_, _, n)", "P(#s1, b, 2)", "P(a, b, n) and Q(b, n)", "P(a, b, _) and P(b, a, _)", "P(a, _, n) and Q(b, m) and n < m",
    "P(a, b, n) and not Q(a, _)", "Q(a, n) and not P(a, _, n)", "Q(a, n) and (exists m: P(a, _, m) and m > n)", "Q(a, n) and (forall m in P(a, _, m): m <= n)",
    "Q(a, n) and (P(a, b, m) implies (n < m or b = #s0))", "P(a, b, n) and (a = b xor n > 2)", "P(a, b, n) and (n > 1 or n < 3)", "Q(a, n) and n in (1, 2)",
    "(P(a, _, n) or Q(a, n))", "linked(x, y)", "linked(#s1, y)", "E(x, y) and linked(y, x)", "above(x, y)", "above(x, x)", "E(x, _) and above(#s0, x)", "Q(a, n) and within(a, n)", "P(a, b, _) and within(b, 3)",
    "Q(a, n) and sum(m | P(a, _, m)) > n", "Q(a, n) and sum(1 | P(a, _, m) and m > n) = 0", "Q(a, _) and total(a) >= 3", "P(a, b, n) and sum(m | P(_, b, m) and m < n) + 1 > n", "S(a, items) and x in items", "S(a, items) and a in items",
    "S(a, items) and P(a, b, _) and b in items", "Q(a, n) and not (P(a, b, m) and not Q(b, _))", "not E(#s9, #s9)", "exists a: Q(a, 1)", "Q(a, n) and if(E(a, _), n, 0 - n) < 2", "Q(a, n) and abs(n - 2) <= max(1, n - 3)",
    "P(a, b, n) and pre(Q(a, m)) and m < n", "Q(a, n) and not pre(Q(a, n))", "1 <= 2 and Q(a, n)", "P(a, b, n) and 1 < n <= 3",
]


def state(salt):
    s = lambda k: f"s{k % 4}"
    p = {(s(salt * 7 + k * 3), s(salt + k * k), Decimal((salt + 5 * k) % 4)) for k in range(9)}
    q = {s(k): Decimal((salt * 3 + k) % 5) for k in range(salt % 4)}
    e = {(s(salt + k), s(salt * 2 + k * k + 1)) for k in range(4)}
    return {"P": sorted(p), "Q": sorted(q.items()), "E": sorted(e), "S": [(s(k), [s(k + salt), s(k * salt), s(k + salt)]) for k in range(3)]}


def frames(spark, claims):
    ddl = {"P": "a string, b string, n decimal(10,2)", "Q": "a string, n decimal(10,2)", "E": "x string, y string", "S": "a string, items array<string>"}
    return {k: spark.createDataFrame(v, ddl[k]) for k, v in claims.items()}


def bag(rows, names):
    return Counter(tuple(tuple(v) if isinstance(v := r[n], list) else v for n in names) for r in rows)


@pytest.mark.parametrize("salt", [1, 6])
@pytest.mark.parametrize("text", PROPS)
def test_propositions(spark, text, salt):
    now, before = state(salt), state(salt + 1)
    prop = parse_prop(text, PROGRAMME)
    found = Compiler(spark, PROGRAMME, frames(spark, now), frames(spark, before)).match(prop)
    names = sorted(found.kinds)
    assert bag(found.df.collect(), names) == bag(Plain(PROGRAMME, now, before).match(prop, {}), names)


@pytest.mark.parametrize("salt", [2, 3, 7])
def test_rules_whole_and_by_cases(spark, salt):
    now = state(salt)
    c = Compiler(spark, PROGRAMME, frames(spark, now))
    for rule in PROGRAMME.invariants:
        broken = bool(rules.violations(c, rule).take(1))
        assert broken == (not Plain(PROGRAMME, now).match(rule.body, {})), rule.name
        # Judged by cases, only what a change touches is found, but all of that.
        change = {"P": spark.createDataFrame(now["P"][:2], "a string, b string, n decimal(10,2)")}
        told = rules.checked(c, rule, change)
        whole = rules.violations(c, rule)
        if told is not None and told.columns:
            names = sorted(set(told.columns) & set(whole.columns))
            assert not told.select(names).distinct().exceptAll(whole.select(names).distinct()).take(1)


def test_impact():
    by = {r.name: rules.impact(PROGRAMME, r) for r in PROGRAMME.invariants}
    assert by["capped"].widened is None and by["known"].widened is None
    assert by["no_loops"].widened == "a recursive call"
    assert {o.predicate for o in by["capped"].occurrences} == {"P", "Q"}


def test_derived_and_errors(spark):
    now = state(3)
    c, plain = Compiler(spark, PROGRAMME, frames(spark, now)), Plain(PROGRAMME, now)
    d = PROGRAMME.derived["Row"]
    rows = {r.a: r for r in live(c, d).collect()}
    assert set(rows) == {a for a, _, _ in now["P"]}
    for a, r in rows.items():
        try:
            top = plain.value(d.values[1][1], {"a": a})
        except Fault as fault:
            assert (r.total, r.top, r["_error"]) == (None, None, str(fault))
        else:
            assert (r.top, r["_error"]) == (top, None) and r.total == plain.value(d.values[0][1], {"a": a})
    if any(r["_error"] for r in rows.values()):
        with pytest.raises(Exception, match="empty_extremum"):
            derived(c, d).collect()


def test_value_lookup_errors(spark):
    claims = frames(spark, {"P": [("x", "y", Decimal(1)), ("x", "z", Decimal(1))], "Q": [("x", Decimal(1))], "E": [("x", "y"), ("x", "z")], "S": []})
    c = Compiler(spark, PROGRAMME, claims)
    with pytest.raises(Exception, match="value_ambiguous"):
        figure(c, {"v": parse_value("value E(a, _) default a", PROGRAMME)}, parse_prop("Q(a, _)", PROGRAMME)).collect()
    with pytest.raises(Exception, match="value_missing"):
        figure(c, {"v": parse_value("value E(b, _)", PROGRAMME)}, parse_prop("P(_, b, _)", PROGRAMME)).collect()
    with pytest.raises(Exception, match="division_by_zero"):
        figure(c, {"v": parse_value("n / (n - 1)", PROGRAMME)}, parse_prop("Q(_, n)", PROGRAMME)).collect()


@pytest.mark.parametrize("text", ["Q(a, n) and a < #b", "Q(a, n) and n = #x", "Q(a, n) and n before 3"])
def test_kinds_are_told_before_anything_runs(spark, text):
    with pytest.raises(KindError):
        Compiler(spark, PROGRAMME, frames(spark, state(1))).match(parse_prop(text, PROGRAMME))


def test_names_must_be_bound(spark):
    with pytest.raises(Unbound):
        Compiler(spark, PROGRAMME, frames(spark, state(1))).match(parse_prop("Q(a, n) and m < n", PROGRAMME))


def test_case_local_plan_starts_from_the_cases(spark):
    c = Compiler(spark, PROGRAMME, frames(spark, state(3)))
    rule = next(r for r in PROGRAMME.invariants if r.name == "capped")
    change = {"Q": spark.createDataFrame([("s1", Decimal(2))], "a string, n decimal(10,2)")}
    plan = rules.checked(c, rule, change)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "CartesianProduct" not in plan


def test_wide_decimals_are_exact_or_errors(spark):
    programme = parse("program wide\npredicate W(a: Decimal, b: Decimal)\npredicate Out(a: Decimal, p: Decimal)\nderived Out(a):\n    over W(a, _)\n    value p = a * sum(b | W(a, b))\n")
    rows = [("2.5", "1.25"), ("0.0000000003", "0.0000000003"), ("1000000", "0.000001"), ("900000000000000", "90000000000")]
    df = spark.createDataFrame([(Decimal(a), Decimal(b)) for a, b in rows], "a decimal(28,10), b decimal(28,10)")
    c = Compiler(spark, programme, {"W": df})
    got = {str(r.a.normalize()): (r.p, r._error) for r in live(c, programme.derived["Out"]).collect()}
    assert got == {"2.5": (Decimal("3.125"), None), "3E-10": (None, "decimal_inexact"), "1E+6": (Decimal(1), None), "9E+14": (None, "decimal_inexact")}
    with pytest.raises(Exception, match="decimal_inexact"):
        derived(c, programme.derived["Out"]).collect()
