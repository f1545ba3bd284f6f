"""The log and the past: events are the operations on claims (user, type), errors delete."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lang import ir
from ..lang.parser import Parser, parse
from ..operators import history as H
from ..operators.rehearsal import rehearse_acts
from ..plans.compiler import Compiler

QUERIES, SQL = {}, {}
CLAIM = ["u", "slot"]
LOG = "SELECT event_id AS ord, user_id AS u, event_id % 3 AS slot, CASE WHEN event_type = 'error' THEN 'del' WHEN event_type = 'view' THEN 'noop' ELSE 'ins' END AS op, CAST(value AS DECIMAL(14,2)) AS amount, ts AS t FROM events"
WITH = f"WITH log AS ({LOG})"
STATE = ", st AS (SELECT u, slot, arg_max(op, ord) op FROM log WHERE op <> 'noop' {} GROUP BY 1, 2)"
SPANS = ", ch AS (SELECT *, lag(op) OVER (PARTITION BY u, slot ORDER BY ord) was FROM log WHERE op <> 'noop'), c2 AS (SELECT * FROM ch WHERE was IS NULL AND op = 'ins' OR was <> op), sp AS (SELECT u, slot, op, ord AS f, lead(ord) OVER (PARTITION BY u, slot ORDER BY ord) t2 FROM c2), iv AS (SELECT u, slot, f, coalesce(t2, 9223372036854775807) t FROM sp WHERE op = 'ins')"


def add(name: str, make, sql: str | None) -> None:
    QUERIES[name] = make
    if sql is not None:
        SQL[name] = WITH + sql


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    kind = F.when(F.col("event_type") == "error", "del").when(F.col("event_type") == "view", "noop").otherwise("ins")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("ord"), F.col("user_id").alias("u"), (F.col("event_id") % 3).alias("slot"), kind.alias("op"), F.col("value").cast("decimal(14,2)").alias("amount"), F.col("ts").cast("timestamp").alias("t"))


#: Positions in the middle of the log, by its length.
MID, LATER = ("(SELECT max(event_id) * %d // 100 FROM events)" % share for share in (60, 80))


def position(spark: SparkSession, sf_dir: str, share: int) -> int:
    return log(spark, sf_dir).agg(F.max("ord")).first()[0] * share // 100


add("as_of_state", lambda s, d: H.as_of(log(s, d), CLAIM, position(s, d, 60)), STATE.format(f"AND ord <= {MID}") + " SELECT u, slot FROM st WHERE op = 'ins'")
add("as_of_now", lambda s, d: H.as_of(log(s, d), CLAIM), STATE.format("") + " SELECT u, slot FROM st WHERE op = 'ins'")


def as_of_instant(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = log(spark, sf_dir)
    return H.as_of(ops, CLAIM, H.order_at(ops, "t", F.to_timestamp(F.lit("2024-01-15 00:00:00"))))


add("as_of_instant", as_of_instant, STATE.format("AND ord <= (SELECT max(ord) FROM log WHERE t <= TIMESTAMP '2024-01-15')") + " SELECT u, slot FROM st WHERE op = 'ins'")
add("as_of_scoped", lambda s, d: H.as_of(log(s, d).where("slot = 1"), CLAIM, position(s, d, 60)), STATE.format(f"AND ord <= {MID} AND slot = 1") + " SELECT u, slot FROM st WHERE op = 'ins'")
add("provenance", lambda s, d: H.provenance(log(s, d), CLAIM), ", g AS (SELECT *, coalesce(max(CASE WHEN op = 'del' THEN ord END) OVER (PARTITION BY u, slot), -1) gone FROM log) SELECT u, slot, min(ord) asserted_at FROM g WHERE op = 'ins' AND ord > gone GROUP BY 1, 2")
add("validity_intervals", lambda s, d: H.intervals(log(s, d), CLAIM), SPANS + " SELECT u, slot, f valid_from, t valid_to FROM iv")


def snapshot_plus_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = log(spark, sf_dir)
    return H.from_snapshot(H.snapshot(ops, CLAIM, position(spark, sf_dir, 30)), ops, CLAIM, position(spark, sf_dir, 60))


add("snapshot_plus_tail", snapshot_plus_tail, STATE.format(f"AND ord <= {MID}") + " SELECT u, slot FROM st WHERE op = 'ins'")
add("history_view", lambda s, d: H.history_view(log(s, d).withColumn("amount", F.when(F.col("ord") % 7 == 0, "n/a").otherwise(F.col("amount").cast("string"))), {"u": "bigint", "slot": "bigint", "amount": "decimal(14,2)"}), " SELECT ord, op, u, slot, CASE WHEN ord % 7 = 0 THEN NULL ELSE amount END amount FROM log")


def replay_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold of the log against a table of claims from which some are missing and to which one was added."""
    ops = log(spark, sf_dir)
    state = H.as_of(ops, CLAIM)
    stored = state.where("u % 50 <> 7").unionByName(spark.sql("SELECT -1L AS u, 0L AS slot"))
    return H.differences(state, stored)


add("replay_verify_diff", replay_verify, STATE.format("") + " SELECT u, slot, 'left' side FROM st WHERE op = 'ins' AND u % 50 = 7 UNION ALL SELECT -1, 0, 'right'")


def deltas(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    ops = log(spark, sf_dir)
    middle = position(spark, sf_dir, 60)
    later = ops.where(f"ord > {middle} AND ord <= {position(spark, sf_dir, 80)}")
    return H.as_of(ops, CLAIM, middle), later.where("op = 'ins'").select(*CLAIM), later.where("op = 'del'").select(*CLAIM)


PARTS = STATE.format(f"AND ord <= {MID}") + f", pre AS (SELECT u, slot FROM st WHERE op = 'ins'), asd AS (SELECT DISTINCT u, slot FROM log WHERE op = 'ins' AND ord > {MID} AND ord <= {LATER}), ret AS (SELECT DISTINCT u, slot FROM log WHERE op = 'del' AND ord > {MID} AND ord <= {LATER})"
add("effective_delta", lambda s, d: H.effective_delta(*deltas(s, d)), PARTS + " SELECT u, slot, 'ins' op FROM (SELECT * FROM asd EXCEPT SELECT * FROM pre) UNION ALL SELECT u, slot, 'del' FROM ((SELECT * FROM ret INTERSECT SELECT * FROM pre) EXCEPT SELECT * FROM asd)")
add("candidate_state", lambda s, d: H.candidate(*deltas(s, d)), PARTS + " (SELECT * FROM pre EXCEPT SELECT * FROM ret) UNION SELECT * FROM asd")

PROGRAMME = """
program held
predicate Held(u: Decimal, slot: Decimal)
predicate Noted(u: Decimal)
"""


def compiler(spark: SparkSession) -> Compiler:
    return Compiler(spark, parse(PROGRAMME), {})


def prop(text: str):
    return Parser(text, parse(PROGRAMME).predicates).prop()


#: A rule that history breaks now and then: whoever holds slot 0 holds slot 1.
CANDIDATE = "Held(u, 0) implies Held(u, 1)"
BREACH = SPANS + ", tr AS (SELECT DISTINCT ord, u FROM log WHERE op <> 'noop'), bad AS (SELECT DISTINCT ord FROM tr WHERE EXISTS (SELECT 1 FROM iv WHERE iv.u = tr.u AND slot = 0 AND f <= ord AND ord < t) AND NOT EXISTS (SELECT 1 FROM iv WHERE iv.u = tr.u AND slot = 1 AND f <= ord AND ord < t)), hit AS (SELECT DISTINCT bad.ord FROM bad JOIN log USING (ord) WHERE slot IN (0, 1))"


def would_refuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = log(spark, sf_dir)
    # An occurrence's literals guard it: slot 2 touches no case of this rule.
    return H.evaluate(compiler(spark), ir.Invariant("slot_0_needs_1", prop(CANDIDATE)), {"Held": ops.where("slot IN (0, 1)")})


add("evaluate_would_refuse", would_refuse, BREACH + " SELECT ord FROM hit")
add("evaluate_train_test", lambda s, d: H.split_counts(would_refuse(s, d), position(s, d, 60)), BREACH + f" SELECT CASE WHEN ord <= {MID} THEN 'train' ELSE 'test' END AS slice, count(*) charges FROM hit GROUP BY 1")


def rehearsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases were accepted; would they be if only holders of slot 2 might purchase?"""
    ops = log(spark, sf_dir)
    acts = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type IN ('purchase', 'click')").select(F.col("event_id").alias("ord"), F.col("user_id").alias("who"), (F.col("event_type") == "purchase").alias("accepted"))
    return H.rehearse(compiler(spark), prop("Held(who, 2)"), acts, {"who": "Decimal"}, {"Held": ops})


add("rehearse_classes", lambda s, d: rehearsed(s, d).groupBy("verdict").agg(F.count("*").alias("n")), SPANS + ", a AS (SELECT event_id AS ord, user_id u, event_type = 'purchase' acc FROM events WHERE event_type IN ('purchase', 'click')), p AS (SELECT ord, acc, EXISTS (SELECT 1 FROM iv WHERE iv.u = a.u AND slot = 2 AND f < ord AND ord <= t) ok FROM a) SELECT CASE WHEN ok = acc THEN 'same' WHEN acc THEN 'would_reject' ELSE 'would_accept' END verdict, count(*) n FROM p GROUP BY 1")


#: A stricter way to take and give back slots, with a gate, a side effect and a rule that history lacks.
STRICTER = """
transformation take(who, slot, type):
    if #error = type:
        retract Held(who, slot)
    else:
        require room: not (Held(who, 0) and slot = 1)
        admit Held(who, slot)
        if type = #click and slot = 2:
            admit Held(who, 0)

invariant slot_1_needs_2:
    Held(u, 1) implies Held(u, 2)
"""


def rehearsed_acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event that changed the log, as the act it was, decided again in a stricter way; every 50th lacks its type."""
    ops = log(spark, sf_dir)
    told = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type <> 'view'")
    kind = F.when(F.col("event_id") % 50 != 0, F.col("event_type")).alias("type")
    acts = told.select(F.col("event_id").alias("ord"), F.lit("clerk").alias("actor"), F.col("ts").cast("timestamp").alias("decided_at"), F.col("user_id").alias("who"), (F.col("event_id") % 3).alias("slot"), kind, (F.col("event_id") % 10 != 3).alias("accepted"))
    c = Compiler(spark, parse(PROGRAMME + STRICTER), {})
    return rehearse_acts(c, "take", acts, {"who": "Decimal", "slot": "Decimal", "type": "Subject"}, {"Held": ops})


def before(slot: str) -> str:
    return f"EXISTS (SELECT 1 FROM iv WHERE iv.u = e.user_id AND iv.slot = {slot} AND f < e.event_id AND e.event_id <= t)"


add(
    "rehearse_acts",
    rehearsed_acts,
    SPANS
    + f", a AS (SELECT event_id AS ord, event_id % 3 AS slot, event_type AS type, event_id % 10 <> 3 AS accepted, event_id % 50 <> 0 AS whole, {before('0')} a0, {before('1')} a1, {before('2')} a2 FROM events e WHERE event_type <> 'view')"
    # What the candidate would do, and what the record says was done, unless a gate refuses.
    ", b AS (SELECT *, CASE slot WHEN 0 THEN a0 WHEN 1 THEN a1 ELSE a2 END mine, type <> 'error' AND slot = 1 AND a0 AS gate FROM a)"
    ", d AS (SELECT *, CASE WHEN slot = 1 THEN type <> 'error' ELSE a1 END n1, CASE WHEN slot = 2 THEN type <> 'error' ELSE a2 END n2, mine = (type = 'error') AS changes FROM b)"
    ", w AS (SELECT *, NOT gate AND changes AND slot IN (1, 2) AND n1 AND NOT n2 AS rule_breaks FROM d)"
    " SELECT ord, CASE WHEN NOT whole THEN 'unreplayable' WHEN (gate OR rule_breaks) AND accepted THEN 'would_reject' WHEN gate OR rule_breaks THEN 'same' WHEN NOT accepted THEN 'would_accept' WHEN type = 'click' AND slot = 2 AND NOT a0 THEN 'different_delta' ELSE 'same' END verdict,"
    " CASE WHEN whole AND gate THEN 'require' WHEN whole AND rule_breaks THEN 'invariant' END kind, CASE WHEN whole AND gate THEN 'room' WHEN whole AND rule_breaks THEN 'slot_1_needs_2' END AS rule FROM w",
)

#: Rules as history meets them; nothing follows from the last one.
COVERED = """
invariant r_low:
    Held(7, slot) implies slot < 3
invariant r_high:
    Held(149, slot) implies slot < 3
invariant r_none:
    Held(u, slot) and u < 0 implies slot < 3
invariant r_pair:
    Held(u, 0) and Held(u, 2) and u > 120 implies u < 0
invariant r_lacks:
    Held(u, 0) and not Held(u, 1) and u < 9 implies u < 0
invariant r_twice:
    (Held(7, 0) implies 1 < 2) and (Held(149, 1) implies 1 < 2)
invariant r_plain:
    not Noted(5)
"""


def covered(spark: SparkSession, sf_dir: str, only: list[str]) -> DataFrame:
    refused = spark.sql("SELECT explode(array('r_low', 'r_low', 'r_gone')) AS rule").where(F.col("rule").isin([*only, "r_gone"]))
    c = Compiler(spark, parse(PROGRAMME + COVERED), {})
    return H.coverage(c, {"Held": log(spark, sf_dir)}, refused, only)


def fired(name: str, test: str, refused: int) -> str:
    hits = f"SELECT DISTINCT ord FROM log l WHERE op <> 'noop' AND EXISTS (SELECT 1 FROM iv WHERE {test} AND f <= l.ord AND l.ord < iv.t)"
    verdict = "'constrained'" if refused else "CASE WHEN count(*) > 0 THEN 'fired' ELSE 'never_fired' END"
    return f"SELECT '{name}' rule, count(*) fired, min(ord) AS first, max(ord) AS last, CAST({refused} AS BIGINT) refused, {verdict} verdict FROM ({hits})"


add("coverage_verdicts", lambda s, d: covered(s, d, ["r_low", "r_high", "r_none"]).where("in_programme").drop("in_programme"), SPANS + " " + " UNION ALL ".join([fired("r_low", "iv.u = 7", 2), fired("r_high", "iv.u = 149", 0), fired("r_none", "iv.u < 0", 0)]))
PAIR = "EXISTS (SELECT 1 FROM iv a JOIN iv b ON a.u = b.u WHERE a.slot = 0 AND b.slot = 2 AND a.u > 120 AND a.f <= l.ord AND l.ord < a.t AND b.f <= l.ord AND l.ord < b.t)"
LACKS = "EXISTS (SELECT 1 FROM iv a WHERE a.slot = 0 AND a.u < 9 AND a.f <= l.ord AND l.ord < a.t AND NOT EXISTS (SELECT 1 FROM iv b WHERE b.u = a.u AND b.slot = 1 AND b.f <= l.ord AND l.ord < b.t))"
TWICE = "EXISTS (SELECT 1 FROM iv WHERE (u = 7 AND slot = 0 OR u = 149 AND slot = 1) AND f <= l.ord AND l.ord < iv.t)"
add(
    "coverage_rules",
    lambda s, d: covered(s, d, ["r_none", "r_pair", "r_lacks", "r_twice", "r_plain"]),
    SPANS
    + " "
    + " UNION ALL ".join(f"SELECT '{name}' rule, count(*) fired, min(ord) AS first, max(ord) AS last, 0::BIGINT refused, CASE WHEN count(*) > 0 THEN 'fired' ELSE 'never_fired' END verdict, true in_programme FROM log l WHERE op <> 'noop' AND {test}" for name, test in {"r_none": "ord < 0", "r_pair": PAIR, "r_lacks": LACKS, "r_twice": TWICE}.items())
    + " UNION ALL SELECT 'r_plain', 0, NULL, NULL, 0, 'always_on', true UNION ALL SELECT 'r_gone', 0, NULL, NULL, 1, 'constrained', false",
)
add("running_total", lambda s, d: H.running_total(log(s, d).select("ord", "amount"), "ord", "amount", 700).selectExpr("ord", "cast(total AS decimal(18,2)) AS total"), " SELECT ord, CAST(sum(amount) OVER (ORDER BY ord) AS DECIMAL(18,2)) total FROM log")
