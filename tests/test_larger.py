"""What showed only on larger tables."""

from datetime import date

from pyspark.sql import functions as F

from claimspark.lang.parser import parse, parse_prop
from claimspark.operators import act
from claimspark.plans.compiler import Compiler

TERMS = parse("""
program terms
predicate Terms(c: Decimal, on: Date, total: Decimal)
    effective by (c) on (on) partial
predicate Asked(k: Decimal, c: Decimal, day: Date)
""")
LISTS = parse("""
program lists
predicate A(o: Decimal)
predicate Put(o: Decimal)

transformation put(orders):
    for o in orders:
        require A(o)
        admit Put(o)
""")


def test_versions_in_force_meet_rows_by_key_alone(spark):
    terms = [(1, date(2024, 1, 1), 5), (1, date(2024, 2, 1), 6), (1, date(2024, 2, 1), 7), (1, date(2024, 3, 1), None), (2, date(2024, 5, 1), 8), (None, date(2024, 1, 1), 9)]
    asked = [(0, 1, date(2023, 1, 1)), (1, 1, date(2024, 1, 31)), (2, 1, date(2024, 2, 1)), (2, 1, date(2024, 2, 1)), (3, 1, date(2024, 9, 1)), (4, 2, date(2024, 4, 30)), (5, None, date(2024, 9, 1)), (6, 2, None)]
    c = Compiler(spark, TERMS, {"Terms": spark.createDataFrame(terms, "c long, on date, total long"), "Asked": spark.createDataFrame(asked, "k long, c long, day date")})
    found = c.bindings(parse_prop("Asked(k, c, day) and terms_in_force_on(c, day, total)", TERMS))
    assert sorted((r.k, str(r.total)) for r in found.collect()) == [(1, "5"), (2, "6"), (2, "6"), (2, "7"), (2, "7"), (3, "None")]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_lists_that_are_gathered_in_another_order_each_time(spark):
    import os

    order = F.udf(lambda n: [int(x) for x in sorted(range(n), key=lambda _: os.urandom(4))], "array<long>").asNondeterministic()
    asks = spark.range(4).select(F.col("id").alias("pid"), order(F.lit(12).cast("int")).alias("orders"), F.lit("c").alias("actor"), F.to_timestamp(F.lit("2024-01-01")).alias("decided_at"))
    c = Compiler(spark, LISTS, {"A": spark.range(12).select(F.col("id").alias("o")), "Put": spark.createDataFrame([], "o long")})
    out = act.stage(c, "put", act.written(asks, "asked"), {"orders": "Collection"})
    assert out[0].count() == 0
    assert act.decide(c, "put", asks.where("pid = 0"), {"orders": "Collection"}).refused.count() == 0


def test_no_frame_of_proposals_is_sent_whole_to_every_node(spark):
    from claimspark.catalog import actions

    out = actions.outcome(spark, "/root/testdata/sf0.001")
    assert "Broadcast" not in out.intents["Receipt"]._jdf.queryExecution().executedPlan().toString()


def decided(spark, monkeypatch):
    """The plans of all tables that a decision of the bench's payments writes, by tag, and its outcome."""
    from claimspark.catalog import actions

    plans, write = {}, act.written
    monkeypatch.setattr(act, "written", lambda df, tag: (plans.setdefault(tag, []).append(df._jdf.queryExecution()), write(df, tag))[1])
    return plans, actions.outcome(spark, "/root/testdata/sf0.001")


def test_a_decision_joins_once_and_shuffles_each_table_once(spark, monkeypatch):
    plans, out = decided(spark, monkeypatch)
    text = {tag: [p.optimizedPlan().toString() for p in of] for tag, of in plans.items()}
    assert {tag: sum(p.count("Join ") for p in of) for tag, of in text.items() if any("Join " in p for p in of)} == {"bound": 1}
    assert len(plans["delta"]) == 1  # only Paid has rules
    assert sum(p.executedPlan().toString().count("Exchange hashpartitioning") for p in plans["delta"]) == 1
    assert not any("SortAggregate" in p.executedPlan().toString() for of in plans.values() for p in of)


ONE = parse("""
program one
predicate Of(o: Decimal, c: Decimal)
predicate Put(o: Decimal, c: Decimal)
    unique by (o)
predicate Seen(o: Decimal, n: Decimal)

transformation put(o, n):
    bind known: Of(o, c)
    if n > 1 and c < 100:
        require small: n < 4
        admit Seen(o, n)
    admit Put(o, c)

invariant bounded:
    Put(o, c) implies c <= 50
invariant not_nine:
    not Put(9, c)
""")


def put(spark, rows):
    of = spark.createDataFrame([(1, 10), (2, 20), (2, 21), (3, 60), (4, 40), (5, None), (6, 30), (6, 30), (7, 7), (8, 8), (9, 9), (None, 5)], "o long, c long")
    c = Compiler(spark, ONE, {"Of": of, "Put": spark.createDataFrame([(4, 40), (8, 1)], "o long, c long"), "Seen": spark.createDataFrame([], "o long, n long")})
    asks = spark.createDataFrame(rows, "pid long, o long, n long").selectExpr("*", "'x' AS actor", "timestamp '2024-01-01' AS decided_at")
    out = act.decide(c, "put", asks, {"o": "Decimal", "n": "Decimal"})
    refused = sorted(((r.pid, r.kind, r.rule) for r in out.refused.collect()), key=repr)
    return refused, {p: sorted(map(tuple, d.collect())) for p, d in out.delta.items()}, {p: sorted(map(tuple, d.collect())) for p, d in out.after.items() if p != "Of"}


def test_a_binding_that_is_counted_in_its_join(spark):
    rows = [(1, 1, 3), (2, 2, 1), (3, 3, 1), (4, 4, 5), (5, 5, 1), (6, 6, 1), (7, 7, 0), (8, 8, 1), (9, 9, 1), (10, 99, 1), (11, None, 1)]
    refused, delta, after = put(spark, rows)
    assert refused == sorted([(2, "error", "known is ambiguous"), (3, "invariant", "bounded"), (4, "require", "small"), (6, "error", "known is ambiguous"), (8, "invariant", "put_unique_by_o"), (9, "invariant", "not_nine"), (10, "bind", "known"), (11, "bind", "known")], key=repr)
    assert delta == {"Put": [(1, 1, 10, "ins"), (7, 7, 7, "ins")], "Seen": [(1, 1, 3, "ins")]}
    assert after == {"Put": [(1, 10), (4, 40), (7, 7), (8, 1)], "Seen": [(1, 3)]}


def test_the_past_is_aggregated_by_hashing(spark):
    from claimspark.operators import history

    log = spark.createDataFrame([(1, "ins", 1), (2, "del", 1), (2, "ins", 1), (1, "ins", 2), (3, "del", 2), (4, "noop", 2), (1, "del", 3), (5, "ins", 4)], "ord long, op string, k long")
    assert sorted(r.k for r in history.as_of(log, ["k"]).collect()) == [1, 4]
    assert sorted(r.k for r in history.as_of(log, ["k"], 2).collect()) == [1, 2]
    assert "SortAggregate" not in history.as_of(log, ["k"])._jdf.queryExecution().executedPlan().toString()
