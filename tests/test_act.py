from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from claimspark.lang.parser import parse
from claimspark.operators import act, evidence, history
from claimspark.operators.recursion import least_fixpoint, written
from claimspark.plans.compiler import Compiler
from claimspark.sources.store import Conflict, Store, mentions, newest, page
from claimspark.streaming import outbox, tail

BANK = parse("""
program bank
predicate Account(a: Subject, owner: Subject, balance: Decimal)
    unique by (a)
predicate Frozen(a: Subject)
predicate Entry(e: Subject, a: Subject, amount: Decimal)
    append only
intent Told(a: Subject)

transformation open(a, owner, deposit):
    require fresh: not Account(a, _, _)
    admit Account(a, owner, deposit)
    emit Told(a)

transformation move(a, amount):
    bind one: Account(a, owner, before)
    require mine: owner = actor
    let after = before + amount
    retract Account(a, owner, before)
    admit Account(a, owner, after)
    admit Entry(new Subject(), a, amount)

transformation freeze_all(owner):
    for Account(a, owner, balance):
        if balance > 10:
            admit Frozen(a)
        else:
            retract Account(a, _, _)

invariant in_credit:
    Account(a, _, balance) implies balance >= 0
invariant frozen_rests:
    Account(a, _, after) and pre(Account(a, _, before)) and Frozen(a) implies after = before
""")
DDL = {"Account": "a string, owner string, balance decimal(12,2)", "Frozen": "a string", "Entry": "e string, a string, amount decimal(12,2)"}
KINDS = {"open": {"a": "Subject", "owner": "Subject", "deposit": "Decimal"}, "move": {"a": "Subject", "amount": "Decimal"}, "freeze_all": {"owner": "Subject"}}


def bank(spark, accounts, frozen=()):
    return Compiler(spark, BANK, {"Account": spark.createDataFrame(accounts, DDL["Account"]), "Frozen": spark.createDataFrame([(f,) for f in frozen], DDL["Frozen"]), "Entry": spark.createDataFrame([], DDL["Entry"])})


def ask(spark, rows, ddl):
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"pid long, actor string, {ddl}")
    return frame.withColumn("decided_at", F.to_timestamp(F.lit("2024-01-01")))


START = [("x", "ann", Decimal(5)), ("y", "ann", Decimal(50)), ("z", "bob", Decimal(7))]


def test_a_frame_of_proposals_is_judged_at_once(spark):
    rows = [("ann", "x", Decimal(3)), ("ann", "z", Decimal(1)), ("bob", "z", Decimal(-9)), ("bob", "q", Decimal(1)), ("ann", "y", Decimal(0))]
    out = act.decide(bank(spark, START, ["y"]), "move", ask(spark, rows, "a string, amount decimal(12,2)"), KINDS["move"])
    assert {r.pid: (r.kind, r.rule) for r in out.refused.collect()} == {1: ("require", "mine"), 2: ("invariant", "in_credit"), 3: ("bind", "one")}
    assert {(r.pid, r.a, r.balance, r.op) for r in out.delta["Account"].collect()} == {(0, "x", Decimal(5), "del"), (0, "x", Decimal(8), "ins")}
    assert sorted(r.balance for r in out.after["Account"].collect()) == [7, 8, 50]
    assert out.delta["Entry"].count() == 2 and out.delta["Entry"].select("e").distinct().count() == 2


def test_rules_that_look_back(spark):
    out = act.decide(bank(spark, START, ["y"]), "move", ask(spark, [("ann", "y", Decimal(1))], "a string, amount decimal(12,2)"), KINDS["move"])
    assert [(r.kind, r.rule) for r in out.refused.collect()] == [("invariant", "frozen_rests")]


def test_unique_keys_are_kept(spark):
    rows = [("c", "n", "ann", Decimal(1)), ("c", "n", "bob", Decimal(1)), ("c", "m", "bob", Decimal(1)), ("c", "x", "bob", Decimal(1))]
    out = act.decide(bank(spark, START), "open", ask(spark, rows, "a string, owner string, deposit decimal(12,2)"), KINDS["open"])
    assert {r.pid: r.rule for r in out.refused.collect()} == {1: "fresh", 3: "fresh"}
    assert sorted(r.a for r in out.intents["Told"].collect()) == ["m", "n"]


SHELF = parse("""
program shelf
predicate Put(k: Decimal, v: Decimal)
    unique by (k)
predicate Cap(most: Decimal)
predicate A(o: Decimal, c: Decimal)
predicate Price(k: Decimal, usd: Decimal[USD])
predicate Cost(k: Decimal, eur: Decimal[EUR])

transformation put(k, v):
    admit Put(k, v)

transformation both(o, orders):
    if o > 0:
        require zzz: o > 5
    require aaa: o > 5
    for x in orders:
        bind one: A(x, c)
        require fits: c < 9
        admit Put(x, c)

invariant bounded:
    Cap(most) implies sum(v | Put(_, v)) <= most
""")


def shelf(spark, put=()):
    of = spark.createDataFrame
    return Compiler(spark, SHELF, {
        "Put": of(list(put), "k long, v long"), "Cap": of([(10,)], "most long"), "A": of([(1, 4), (2, 4), (3, 9), (4, 1), (4, 2)], "o long, c long"),
        "Price": of([(1, Decimal(1))], "k long, usd decimal(9,2)"), "Cost": of([(1, Decimal(1))], "k long, eur decimal(9,2)"),
    })


def test_proposals_that_share_a_case_are_decided_one_after_another(spark):
    rows = [("c", 1, 5), ("c", 1, 6), ("c", 2, 4), ("c", 3, 50), ("c", 4, 1), ("c", 1, 5)]
    out = act.decide(shelf(spark), "put", ask(spark, rows, "k long, v long"), {"k": "Decimal", "v": "Decimal"})
    assert {r.pid: r.rule for r in out.refused.collect()} == {1: "put_unique_by_k", 3: "bounded"}
    assert sorted((r.k, r.v) for r in out.after["Put"].collect()) == [(1, 5), (2, 4), (4, 1)]
    assert sorted((r.pid, r.k) for r in out.delta["Put"].collect()) == [(0, 1), (2, 2), (4, 4)]


def test_the_first_statement_and_pass_that_fails_is_reported(spark):
    rows = [("c", 1, [1]), ("c", 0, [1]), ("c", 6, [1, 1]), ("c", 7, [2, 3, 8]), ("c", 8, [8, 3]), ("c", 9, [2, 4])]
    out = act.decide(shelf(spark), "both", ask(spark, rows, "o long, orders array<long>"), {"o": "Decimal", "orders": "Collection"})
    assert {r.pid: (r.kind, r.rule) for r in out.refused.collect()} == {0: ("require", "zzz"), 1: ("require", "aaa"), 3: ("require", "fits"), 4: ("bind", "one"), 5: ("error", "one is ambiguous")}
    assert [(r.pid, r.k, r.v) for r in out.delta["Put"].collect()] == [(2, 1, 4)]


def test_units_do_not_mix(spark):
    c = shelf(spark)
    from claimspark.kinds import KindError
    from claimspark.lang.parser import parse_prop

    for text in ("Price(k, a) and Cost(k, b) and a <= b", "Price(k, a) and Cost(k, a)", "Price(k, a) and sum(b | Cost(_, b)) = a", "Price(k, a) and Cost(k, b) and a + b > 0"):
        with pytest.raises(KindError):
            c.bindings(parse_prop(text, SHELF))
    assert c.bindings(parse_prop("Price(k, a) and a + a > 1 and Cost(k, b) and b * 2 = 2", SHELF)).count() == 1


def test_at_one_position_a_claim_is_deleted_before_it_is_inserted(spark):
    log = spark.createDataFrame([(1, "ins", "a"), (2, "ins", "a"), (2, "del", "a"), (3, "del", "b"), (3, "ins", "b"), (4, "del", "b")], "ord long, op string, x string")
    for rows in (log, log.orderBy("op"), log.orderBy(F.desc("op"))):
        assert [r.x for r in history.as_of(rows, ["x"]).collect()] == ["a"]
        assert {(r.x, r.valid_from, r.valid_to) for r in history.intervals(rows, ["x"]).collect()} >= {("b", 3, 4), ("a", 2, history.FOREVER)}
        assert [(r.x, r.asserted_at) for r in history.provenance(rows, ["x"]).collect()] == [("a", 2)]


def test_loops_over_claims_and_branches(spark):
    out = act.decide(bank(spark, START), "freeze_all", ask(spark, [("c", "ann")], "owner string"), KINDS["freeze_all"])
    assert [r.a for r in out.delta["Frozen"].collect()] == ["y"]
    assert [(r.a, r.op) for r in out.delta["Account"].collect()] == [("x", "del")]


def test_acts_in_order_and_all_or_none(spark):
    from datetime import datetime

    def one(actor, **args):
        return {"actor": actor, "decided_at": datetime(2024, 1, 1), **args}

    acts = [("open", one("c", a="n", owner="ann", deposit=Decimal("4.00"))), ("move", one("ann", a="n", amount=Decimal("-3.00"))), ("move", one("ann", a="n", amount=Decimal("-3.00")))]
    cut = lambda df, p: written(df, "state")
    receipts, state = act.fold(bank(spark, START), acts, KINDS.__getitem__, cut=cut)
    assert [(r.accepted, r.rule) for r in receipts] == [(True, None), (True, None), (False, "in_credit")]
    assert state["Account"].where("a = 'n'").first().balance == 1
    receipts, state = act.fold(bank(spark, START), acts, KINDS.__getitem__, atomic=True, cut=cut)
    assert len(receipts) == 3 and state["Account"].count() == 3


def test_store_reads_the_past_and_refuses_a_second_writer(spark, tmp_path):
    keep = Store(spark, str(tmp_path / "store"), BANK)
    rows = spark.createDataFrame([("x", "ann", Decimal(5), "ins"), ("y", "bob", Decimal(6), "ins")], DDL["Account"] + ", op string")
    keep.commit({"Account": rows}, "2024-01-01T00:00:00Z", 0)
    keep.commit({"Account": rows.where("a = 'x'").withColumn("op", F.lit("del"))}, "2024-01-02T00:00:00Z", 1)
    assert [r.a for r in keep.claims("Account").collect()] == ["y"]
    assert keep.claims("Account", 1).count() == 2 and keep.claims("Account", where={"owner": "ann"}).count() == 0
    with pytest.raises(Conflict):
        keep.commit({"Account": rows}, "2024-01-03T00:00:00Z", 1)
    with pytest.raises(KeyError):
        keep.claims("Account", where={"nope": 1})
    assert keep.catalogue().count() == 7 and keep.keyed("Account").first().claim_key
    keep.views()
    assert spark.sql("SELECT count(*) AS n FROM Account").first().n == 1
    ops = keep.log("Account")
    assert history.order_at(ops, "committed_at", F.to_timestamp(F.lit("2024-01-01T12:00:00Z"))) == 1
    assert page(ops, 1, 5).count() == 1 and newest(ops, ["ord"], 1).first().ord == 2
    assert mentions(ops.withColumn("s", F.array("a", "owner")), "s", "bob").count() == 1


def test_tail_takes_each_file_once(spark, tmp_path):
    folder = str(tmp_path / "log")
    first = spark.createDataFrame([(1, "2024-01-01 00:10:00"), (2, "2024-01-01 00:50:00")], "ord long, t string").select("ord", F.to_timestamp("t").alias("t"))
    first.write.parquet(folder)
    seen = []
    run = lambda: tail.follow(tail.tail(spark, folder, first.schema), str(tmp_path / "cursor"), lambda b, n: seen.append(b.count())).awaitTermination()
    run()
    first.write.mode("append").parquet(folder)
    run()
    run()
    assert sum(seen) == 4
    table = tail.windowed(tail.tail(spark, folder, first.schema), "t", "1 hour", "1 day", [], "ord")
    table.writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert [(r.n, r.total) for r in spark.sql("SELECT * FROM hours").collect()] == [(4, 6)]


def test_outbox_retries_fails_and_compensates(spark):
    t = "2024-01-01 00:00:00"
    rows = spark.createDataFrame([(1, "i", "k1", "pending", 0, t, None, None), (2, "i", "k2", "pending", 2, t, None, None), (3, "i", "k3", "pending", 0, t, None, None)], "intent_id long, intent string, idempotency_key string, status string, attempts int, enqueued_at string, next_attempt_at string, lease_until string")
    rows = rows.select("intent_id", "intent", "idempotency_key", "status", "attempts", *(F.to_timestamp(c).alias(c) for c in ("enqueued_at", "next_attempt_at", "lease_until")))
    now = F.to_timestamp(F.lit("2024-01-02 00:00:00"))
    told = spark.createDataFrame([(1, None), (2, None), (3, True)], "intent_id long, ok boolean")
    after = {r.intent_id: r for r in outbox.settle(rows, told, now, 3).collect()}
    assert {k: r.status for k, r in after.items()} == {1: "pending", 2: "failed", 3: "delivered"}
    assert after[1].next_attempt_at is not None and after[1].attempts == 1
    assert outbox.compensations(outbox.settle(rows, told, now, 3)).first().idempotency_key == "k2/compensation"


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 8, 33])
def test_merkle_tree_and_proofs(spark, monkeypatch, n):
    import hashlib

    def plain(hashes):
        if not hashes:
            return hashlib.sha256(b"").hexdigest()
        if len(hashes) == 1:
            return hashes[0]
        k = 1
        while 2 * k < len(hashes):
            k *= 2
        return hashlib.sha256(b"\x01" + bytes.fromhex(plain(hashes[:k])) + bytes.fromhex(plain(hashes[k:]))).hexdigest()

    rows = spark.range(n).selectExpr("id * 3 AS ord", "cast(id AS string) AS v")
    bottom = written(evidence.leaves(rows, "ord", ["ord", "v"], width=5), "leaves")
    hashes = [r.hash for r in bottom.orderBy("idx").collect()]
    assert [r.idx for r in bottom.orderBy("idx").collect()] == list(range(n))
    made = evidence.levels
    monkeypatch.setattr(evidence, "levels", lambda b, small=4: made(b, small))
    assert evidence.root(bottom) == plain(hashes)
    if n:
        at = n // 2
        proof = evidence.inclusion(evidence.levels(bottom), at)
        assert evidence.verify(hashes[at], proof, plain(hashes)) and not evidence.verify("00" * 32, proof, plain(hashes))


def test_set_hash_knows_bags_not_order(spark):
    a = spark.createDataFrame([(1,), (2,), (2,)], "x long")
    assert evidence.set_hash(a) == evidence.set_hash(a.orderBy(F.desc("x"))) != evidence.set_hash(a.distinct())


def test_fixpoint_over_a_long_chain(spark):
    edges = spark.range(40).selectExpr("id AS a", "id + 1 AS b")
    step = lambda fresh: fresh.alias("f").join(edges.alias("e"), F.expr("f.b = e.a")).selectExpr("f.a AS a", "e.b AS b")
    assert least_fixpoint(edges.where("a = 0"), step).count() == 40


def test_consistency_proofs_and_frontiers_of_all_sizes():
    hashes = [f"{k:064x}" for k in range(1, 24)]

    def grown(leaves):
        rest = [leaves]
        while len(rest[-1]) > 1:
            rest.append(evidence.above(rest[-1]))
        return [None], rest

    trees = {n: grown(hashes[:n]) for n in range(1, 24)}
    front = []
    for n, tree in trees.items():
        new = evidence.top_of(tree)
        front = evidence.grown(front, hashes[n - 1])
        assert front == evidence.frontier(tree, n) and evidence.root_of_frontier(front) == new
        for before in range(1, n + 1):
            old, proof = evidence.top_of(trees[before]), evidence.consistency(tree, before, n)
            assert evidence.verify_consistency(before, n, old, new, proof)
            if before < n:
                assert not evidence.verify_consistency(before, n, "0" * 64, new, proof)
                assert not evidence.verify_consistency(before, n, old, "0" * 64, proof)
                assert not evidence.verify_consistency(before, n, old, new, proof[:-1])


def test_a_crash_before_the_manifest_has_its_name_changes_nothing(spark, tmp_path, monkeypatch):
    keep = Store(spark, str(tmp_path / "store"), BANK)
    rows = spark.createDataFrame([("x", "ann", Decimal(5), "ins")], DDL["Account"] + ", op string")
    keep.commit({"Account": rows}, "2024-01-01T00:00:00Z", 0)

    def crash(text, name):
        keep.write_aside(text)
        raise RuntimeError("lost")

    monkeypatch.setattr(keep, "named", crash)
    with pytest.raises(RuntimeError):
        keep.commit({"Account": rows}, "2024-01-02T00:00:00Z", 1)
    monkeypatch.undo()
    assert keep.head()["version"] == 1 and keep.claims("Account").count() == 1
    with pytest.raises(Conflict):
        keep.publish({"version": 1, "order": 9, "commits": [{"id": "z", "order": 9, "at": "", "predicates": []}]})
    assert keep.head()["order"] == 1


def test_manifests_name_all_commits_every_so_often(spark, tmp_path, monkeypatch):
    from claimspark.sources import store

    monkeypatch.setattr(store, "WHOLE", 3)
    keep = Store(spark, str(tmp_path / "store"), BANK)
    keep.fs.mkdirs(keep.hadoop(keep.path))
    for version in range(1, 9):
        head = keep.head()
        keep.publish({"version": version, "order": version, "commits": [*head["commits"], {"id": str(version), "order": version, "at": "", "predicates": []}]})
        assert [c["order"] for c in keep.head()["commits"]] == list(range(1, version + 1))
