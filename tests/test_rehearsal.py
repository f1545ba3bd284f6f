import random

import pytest
from pyspark.sql import functions as F

from claimspark.lang.parser import parse
from claimspark.operators import act, history
from claimspark.operators.rehearsal import rehearse_acts
from claimspark.plans.compiler import Compiler

TEXT = """
program shelf
predicate On(item: Decimal, place: Decimal)
predicate Shut(place: Decimal)

transformation move(item, to, k):
    require open: not Shut(to)
    if k = 0:
        bind one: On(item, at)
        retract On(item, at)
    else:
        for On(item, from):
            require steady: from != to + 2
            retract On(item, from)
    admit On(item, to)
    if k > 1:
        admit Shut(to)

invariant few:
    On(_, place) implies sum(1 | On(_, place)) <= 2
invariant low:
    Shut(place) implies place < 4
"""
KINDS = {"item": "Decimal", "to": "Decimal", "k": "Decimal"}


def test_each_act_against_deciding_it_alone(spark):
    dice = random.Random(0)
    logs = {"On": [], "Shut": []}
    acts = []
    for ord in range(1, 12):
        item, to, k = dice.randrange(4), dice.randrange(5), dice.randrange(3)
        acts.append((ord, "ann", item, to, None if ord == 5 else k, dice.random() < 0.7))
        for _ in range(dice.randrange(1, 3)):
            logs["On"].append((ord, dice.choice(["ins", "ins", "del"]), dice.randrange(4), dice.randrange(5)))
        if ord % 3 == 0:
            logs["Shut"].append((ord, "ins", dice.randrange(5)))
    programme = parse(TEXT)
    frames = {p: spark.createDataFrame(rows, ddl).dropDuplicates() for (p, rows), ddl in zip(logs.items(), ("ord long, op string, item long, place long", "ord long, op string, place long"), strict=True)}
    frames = {p: f.cache() for p, f in frames.items()}
    ddl = "ord long, actor string, item long, to long, k long, accepted boolean"
    asked = spark.createDataFrame(acts, ddl).withColumn("decided_at", F.to_timestamp(F.lit("2024-01-01")))
    found = {r.ord: (r.verdict, r.kind, r["rule"]) for r in rehearse_acts(Compiler(spark, programme, {}), "move", asked, KINDS, frames).collect()}

    names = {p: programme.predicates[p].names() for p in frames}
    state = lambda p, ord: {tuple(r) for r in history.as_of(frames[p], names[p], ord).collect()}
    seen = set()
    for ord, _, item, to, k, accepted in acts:
        if k is None:
            assert found[ord] == ("unreplayable", None, None)
            continue
        was = {p: state(p, ord - 1) for p in frames}
        c = Compiler(spark, programme, {"On": spark.createDataFrame(sorted(was["On"]), "item long, place long"), "Shut": spark.createDataFrame(sorted(was["Shut"]), "place long")})
        one = asked.where(F.col("ord") == ord).drop("accepted").withColumnRenamed("ord", "pid")
        out = act.decide(c, "move", one, KINDS)
        why = out.refused.first()
        if why:
            verdict = "would_error" if why.kind == "error" else "would_reject" if accepted else "same"
            assert found[ord] == (verdict, why.kind, why["rule"])
        elif not accepted:
            assert found[ord] == ("would_accept", None, None)
        else:
            mine = {(p, r.op, *(r[n] for n in names[p])) for p, d in out.delta.items() for r in d.collect()}
            theirs = {(p, "ins", *x) for p in frames for x in state(p, ord) - was[p]} | {(p, "del", *x) for p in frames for x in was[p] - state(p, ord)}
            assert found[ord] == ("same" if mine == theirs else "different_delta", None, None)
        seen.add(found[ord][0])
    assert len(seen) > 2


def test_what_cannot_be_rehearsed_is_told_before_anything_runs(spark):
    acts = spark.createDataFrame([(1, "ann", None, 1, True)], "ord long, actor string, decided_at timestamp, item long, accepted boolean")
    c = Compiler(spark, parse(TEXT), {})
    assert [r.verdict for r in rehearse_acts(c, "lost", acts, {"item": "Decimal"}, {}).collect()] == ["unreplayable"]
    mints = parse(TEXT + "\ntransformation mint(item):\n    let s = new Subject()\n    admit On(item, item)\n")
    with pytest.raises(ValueError):
        rehearse_acts(Compiler(spark, mints, {}), "mint", acts, {"item": "Decimal"}, {})
