"""Decisions, sources, the outbox, the stream and evidence over the bench tables."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lang.parser import parse
from ..operators import act, disciplines, evidence
from ..operators import history as H
from ..operators.recursion import shared_dir, written
from ..plans.compiler import Compiler
from ..sources import calendar, calls, store
from ..streaming import outbox, tail
from .core import CUS, ORD
from .tables import claims, compiler

QUERIES, SQL = {}, {}
EVE = "SELECT event_id e, ts AS t, user_id AS u, event_type AS type, CAST(value AS DECIMAL(14,2)) AS value FROM events"
WITH = f"WITH ord AS ({ORD}), cus AS ({CUS}), eve AS ({EVE})"


def add(name: str, make, sql: str | None) -> None:
    QUERIES[name] = make
    if sql is not None:
        SQL[name] = WITH + sql


DESK = """
program desk
predicate Order(o: Decimal, c: Decimal, status: Subject, total: Decimal)
    unique by (o)
predicate Paid(o: Decimal, amount: Decimal)
    unique by (o)
predicate Flagged(c: Decimal, o: Decimal)
predicate Note(note: Subject, o: Decimal)
intent Receipt(o: Decimal, amount: Decimal)

transformation pay(o, amount):
    bind known: Order(o, c, status, total)
    require open: status = #O
    require within: amount <= total
    let rest = total - amount
    admit Paid(o, amount)
    if total > 200000 and rest > 0:
        admit Flagged(c, o)
        admit Note(new Subject(), o)
    emit Receipt(o, amount)

transformation clear(c):
    for Order(o, c, #F, _):
        retract Order(o, c, _, _)

transformation pay_all(orders, amount):
    for o in orders:
        require Order(o, _, #O, _)
        admit Paid(o, amount)

transformation audit(o, amount):
    if amount > 0:
        require zealous: amount <= 100000
    require aware: Order(o, _, #O, _)

transformation flag_all(orders):
    for o in orders:
        bind known: Order(o, c, _, _)
        admit Flagged(c, o)

invariant paid_is_bounded:
    Paid(o, amount) implies amount <= 250000
"""


@lru_cache
def desk_programme():
    return parse(DESK)


def desk(spark: SparkSession, sf_dir: str) -> Compiler:
    order = claims(spark, sf_dir)["Order"].select("o", "c", "status", "total")
    none = lambda ddl: spark.createDataFrame([], ddl)
    paid = order.where("total < 20000").select("o", F.lit(1).cast("decimal(14,2)").alias("amount"))
    return Compiler(spark, desk_programme(), {"Order": order, "Paid": paid, "Flagged": none("c long, o long"), "Note": none("note string, o long")})


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments for every order, some too high, and some for orders that don't exist."""
    order = claims(spark, sf_dir)["Order"]
    some = order.select(F.col("o").alias("pid"), "o", (F.col("total") + F.when(F.col("o") % 7 == 0, 1).otherwise(-10000)).cast("decimal(14,2)").alias("amount"))
    strange = spark.range(3).select((-1 - F.col("id")).alias("pid"), (-1 - F.col("id")).alias("o"), F.lit(5).cast("decimal(14,2)").alias("amount"))
    return some.unionByName(strange).withColumns({"actor": F.lit("clerk"), "decided_at": F.to_timestamp(F.lit("2024-01-01"))})


def outcome(spark: SparkSession, sf_dir: str) -> act.Outcome:
    return act.decide(desk(spark, sf_dir), "pay", proposals(spark, sf_dir), {"o": "Decimal", "amount": "Decimal"})


PAY = (
    ", p AS (SELECT o pid, o, total, status, c, CAST(total + CASE WHEN o % 7 = 0 THEN 1 ELSE -10000 END AS DECIMAL(14,2)) amount FROM ord)"
    ", w AS (SELECT *, CASE WHEN status <> 'O' THEN 'require/open' WHEN amount > total THEN 'require/within' WHEN total < 20000 AND amount <> 1 THEN 'invariant/paid_unique_by_o' WHEN amount > 250000 THEN 'invariant/paid_is_bounded' END why FROM p)"
    ", okay AS (SELECT * FROM w WHERE why IS NULL)"
)
add("act_refusals", lambda s, d: outcome(s, d).refused, PAY + " SELECT pid, split_part(why, '/', 1) kind, split_part(why, '/', 2) AS rule FROM w WHERE why IS NOT NULL UNION ALL SELECT -1 - k, 'bind', 'known' FROM range(3) g(k)")
add("act_effective_delta", lambda s, d: outcome(s, d).delta["Paid"].select("pid", "o", "amount", "op"), PAY + " SELECT pid, o, amount, 'ins' op FROM okay")
add("act_conditional_branch", lambda s, d: outcome(s, d).delta["Flagged"].select("pid", "c", "o"), PAY + " SELECT pid, c, o FROM okay WHERE total > 200000")
add("act_minted_subjects", lambda s, d: outcome(s, d).delta["Note"].agg(F.count("*").alias("n"), F.countDistinct("note").alias("subjects")), PAY + " SELECT count(*) n, count(*) subjects FROM okay WHERE total > 200000")
add("act_intents", lambda s, d: outcome(s, d).intents["Receipt"], PAY + " SELECT pid, o, amount FROM okay")
add("act_state_after", lambda s, d: outcome(s, d).after["Paid"].agg(F.count("*").alias("n"), F.sum("amount").cast("decimal(24,2)").alias("total")), PAY + " SELECT count(*) n, CAST(sum(amount) AS DECIMAL(24,2)) total FROM (SELECT o, amount FROM okay UNION SELECT o, 1 FROM ord WHERE total < 20000)")
add("explain_verdicts", lambda s, d: act.explain(desk(s, d), "pay", proposals(s, d), {"o": "Decimal", "amount": "Decimal"}).groupBy("verdict").agg(F.count("*").alias("n")), PAY + " SELECT CASE WHEN why IS NULL THEN 'admissible' ELSE 'rejected' END verdict, count(*) n FROM (SELECT why FROM w UNION ALL SELECT 'x' FROM range(3)) GROUP BY 1")


def cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retraction by pattern, looping over the claims that a pattern matches."""
    asks = claims(spark, sf_dir)["Customer"].select(F.col("c").alias("pid"), "c", F.lit("clerk").alias("actor"), F.to_timestamp(F.lit("2024-01-01")).alias("decided_at"))
    return act.decide(desk(spark, sf_dir), "clear", asks, {"c": "Decimal"}).delta["Order"].select("pid", "o", "op")


add("act_retract_loop", cleared, " SELECT c pid, o, 'del' op FROM ord WHERE status = 'F' AND c IN (SELECT c FROM cus)")


def paid_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A loop over a collection: one closed order refuses the whole act."""
    order = claims(spark, sf_dir)["Order"]
    asks = order.groupBy((F.col("c") * 2 + (F.col("status") == "O").cast("long") * (F.col("o") % 2)).alias("pid")).agg(F.collect_list("o").alias("orders")).select("pid", "orders", F.lit(7).cast("decimal(14,2)").alias("amount"), F.lit("clerk").alias("actor"), F.to_timestamp(F.lit("2024-01-01")).alias("decided_at"))
    return act.decide(desk(spark, sf_dir), "pay_all", asks, {"orders": "Collection", "amount": "Decimal"}).refused


add("act_collection_loop", paid_lists, ", x AS (SELECT CAST(c * 2 + CASE WHEN status = 'O' THEN o % 2 ELSE 0 END AS BIGINT) pid, bool_or(status <> 'O') closed, bool_or(total < 20000 AND total <> 7) paid FROM ord GROUP BY 1) SELECT pid, CASE WHEN closed THEN 'require' ELSE 'invariant' END kind, CASE WHEN closed THEN 'require' ELSE 'paid_unique_by_o' END AS rule FROM x WHERE closed OR paid")
add("act_gate_order", lambda s, d: act.decide(desk(s, d), "audit", proposals(s, d), {"o": "Decimal", "amount": "Decimal"}).refused, PAY + " SELECT pid, 'require' kind, CASE WHEN amount > 100000 THEN 'zealous' ELSE 'aware' END AS rule FROM p WHERE amount > 100000 OR status <> 'O' UNION ALL SELECT -1 - k, 'require', 'aware' FROM range(3) g(k)")


def traced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each statement of an audit made of each proposal."""
    told = act.trace(desk(spark, sf_dir), "audit", proposals(spark, sf_dir), {"o": "Decimal", "amount": "Decimal"})
    return told.withColumn("at", F.concat_ws("/", F.col("at").cast("array<string>"))).withColumn("what", F.coalesce("what", F.lit("")))


add("act_trace", traced, PAY + ", q AS (SELECT pid, amount, status = 'O' AS is_open FROM p UNION ALL SELECT -1 - k, 5, false FROM range(3) g(k)) SELECT pid, '0' AS at, 'choose' AS statement, '' AS what, 1::BIGINT came, 1::BIGINT went_on FROM q UNION ALL SELECT pid, '0/0', 'require', 'zealous', 1, CASE WHEN amount <= 100000 THEN 1 ELSE 0 END FROM q WHERE amount > 0 UNION ALL SELECT pid, '1', 'require', 'aware', 1, CASE WHEN is_open THEN 1 ELSE 0 END FROM q WHERE amount <= 100000")


def used(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of all payments, and of acts of a transformation that is no more."""
    p = proposals(spark, sf_dir)
    done = p.select("pid").join(outcome(spark, sf_dir).refused.hint("merge"), "pid", "left").select(F.lit("pay").alias("transformation"), F.col("kind").isNull().alias("accepted"), "kind", "rule")
    gone = spark.sql("SELECT 'refund' AS transformation, true AS accepted, CAST(NULL AS STRING) AS kind, CAST(NULL AS STRING) AS rule FROM range(2)")
    return H.usage(desk(spark, sf_dir), done.unionByName(gone))


add("act_usage", used, PAY + " SELECT 'pay' AS transformation, why IS NULL accepted, why AS cause, count(*) acts, true in_programme FROM (SELECT why FROM w UNION ALL SELECT 'bind/known' FROM range(3)) GROUP BY why UNION ALL SELECT 'refund', true, NULL, 2, false UNION ALL SELECT unnest(['clear', 'pay_all', 'audit', 'flag_all']), NULL, NULL, 0, true")


def flagged_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A binding in a loop whose collection has equal elements: each is a pass of its own."""
    asks = proposals(spark, sf_dir).select("pid", F.array("o", "o").alias("orders"), "actor", "decided_at")
    out = act.decide(desk(spark, sf_dir), "flag_all", asks, {"orders": "Collection"})
    none = F.lit(-1).cast("long")
    return out.delta["Flagged"].select("pid", "c", "o", F.lit("").alias("rule")).unionByName(out.refused.select("pid", none.alias("c"), none.alias("o"), "rule"))


add("act_bind_in_loop", flagged_twice, " SELECT o pid, c, o, '' AS rule FROM ord UNION ALL SELECT -1 - k, -1, -1, 'known' FROM range(3) g(k)")
add("actor_authority", lambda s, d: disciplines.restricted(proposals(s, d).withColumn("c", F.col("o") % 11).select("pid", "c"), s.range(0, 11, 2).withColumnRenamed("id", "c"), ["c"]), " SELECT pid, pid % 11 AS c FROM (SELECT o pid FROM ord UNION ALL SELECT -1 - k FROM range(3) g(k)) WHERE pid % 11 NOT IN (0, 2, 4, 6, 8, 10)")

# --- disciplines


def in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = claims(spark, sf_dir)
    asked = c["Line"].join(c["Order"].select("o", "c"), "o").select("o", "n", "c", "shipped")
    return disciplines.versions_in_force(asked, c["Terms"], ["c"], "shipped", "on").select("o", "n", "c", "shipped", F.col("on").alias("since"), "total")


add("effective_in_force_one_shuffle", in_force, ", v AS (SELECT c, d, max(total) total FROM ord GROUP BY 1, 2), a AS (SELECT l_orderkey o, l_linenumber n, c, CAST(l_shipdate AS DATE) shipped FROM lineitem JOIN ord ON o = l_orderkey) SELECT a.o, n, a.c, shipped, v.d since, v.total FROM a ASOF JOIN v ON v.c = a.c AND v.d <= a.shipped")
add("total_over_breaches", lambda s, d: disciplines.missing_versions(s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("c")).withColumn("at", F.to_date(F.lit("1995-06-30"))), claims(s, d)["Terms"], ["c"], "at", "on").select("c"), " SELECT c FROM cus WHERE NOT EXISTS (SELECT 1 FROM ord WHERE ord.c = cus.c AND d <= DATE '1995-06-30')")
add("superseded_forks", lambda s, d: disciplines.forks(s.read.parquet(f"{d}/supplier.parquet").selectExpr("s_suppkey AS successor", "s_suppkey div 3 AS prior")), " SELECT s_suppkey // 3 AS prior, count(DISTINCT s_suppkey) successors FROM supplier GROUP BY 1 HAVING count(DISTINCT s_suppkey) > 1")
add("append_only_breaches", lambda s, d: disciplines.retracted_against(claims(s, d)["Event"].select("e", "user"), claims(s, d)["Event"].select("e", (F.col("user") + F.col("e") % 2).alias("user"))), " SELECT e, u AS user FROM eve WHERE e % 2 = 0")
add("current_pointer", lambda s, d: disciplines.duplicated(claims(s, d)["Terms"], ["c"]), " SELECT c FROM ord GROUP BY c HAVING count(DISTINCT d) > 1")

# --- log pages, mentions, rejections, outbox


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("ord"), F.col("ts").cast("timestamp").alias("t"), F.col("user_id").alias("u"), F.col("event_type").alias("type"))


add("audit_page_after", lambda s, d: store.page(events(s, d).select("ord", "u", "type"), 500, 100), " SELECT e AS ord, u, type FROM eve WHERE e > 500 ORDER BY e LIMIT 100")
add("rejections_top_k", lambda s, d: store.newest(events(s, d).where("type = 'error'").select("ord", "u"), ["ord"], 20), " SELECT e AS ord, u FROM eve WHERE type = 'error' ORDER BY e DESC LIMIT 20")
add("mentions", lambda s, d: store.mentions(events(s, d).select("ord", F.array(F.concat(F.lit("user_"), "u"), "type").alias("subjects")), "subjects", "user_42").select("ord"), " SELECT e AS ord FROM eve WHERE u = 42")


def outbox_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    status = F.when(F.col("type") == "purchase", "delivered").when(F.col("type") == "view", "in_progress").otherwise("pending")
    return e.select(F.col("ord").alias("intent_id"), F.col("type").alias("intent"), F.concat_ws("/", "u", "type").alias("idempotency_key"), status.alias("status"), (F.col("ord") % 4).cast("int").alias("attempts"), F.col("t").alias("enqueued_at"), F.when(F.col("ord") % 3 == 0, F.col("t") + F.expr("INTERVAL 20 DAYS")).alias("next_attempt_at"), F.when(F.col("type") == "view", F.col("t") + F.expr("INTERVAL 5 DAYS")).alias("lease_until"))


NOW = "2024-01-20 00:00:00"
DUE = f"((type IN ('signup', 'click', 'error') AND (e % 3 <> 0 OR t + INTERVAL 20 DAY <= TIMESTAMP '{NOW}')) OR (type = 'view' AND t + INTERVAL 5 DAY < TIMESTAMP '{NOW}'))"
now = lambda: F.to_timestamp(F.lit(NOW))
add("outbox_due", lambda s, d: outbox.due(outbox_rows(s, d), now()).select("intent_id"), f" SELECT e intent_id FROM eve WHERE {DUE}")
add("outbox_next_due", lambda s, d: outbox.claim_next(outbox_rows(s, d), now(), 5).select("intent_id"), f" SELECT e intent_id FROM eve WHERE {DUE} ORDER BY t, e LIMIT 5")
add("outbox_idempotent", lambda s, d: outbox.idempotent(outbox_rows(s, d)).select("intent_id", "idempotency_key"), " SELECT e intent_id, u || '/' || type idempotency_key FROM (SELECT *, row_number() OVER (PARTITION BY u, type ORDER BY t, e) k FROM eve) WHERE k = 1")


def settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = outbox.due(outbox_rows(spark, sf_dir), now())
    told = rows.select("intent_id", F.when(F.col("intent_id") % 5 == 0, True).when(F.col("intent_id") % 5 == 1, False).alias("ok"))
    return outbox.settle(rows, told, now(), 3).groupBy("status").agg(F.count("*").alias("n"))


add("outbox_settle", settled, f" SELECT CASE WHEN e % 5 = 0 THEN 'delivered' WHEN e % 5 = 1 OR e % 4 + 1 >= 3 THEN 'failed' ELSE 'pending' END status, count(*) n FROM eve WHERE {DUE} GROUP BY 1")
add("outbox_take", lambda s, d: outbox.take(outbox_rows(s, d), now(), 50, 90).select("intent_id", "status", F.date_format("lease_until", "yyyy-MM-dd HH:mm").alias("lease_until")), f" SELECT eve.e intent_id, CASE WHEN k.e IS NOT NULL OR type = 'view' THEN 'in_progress' WHEN type = 'purchase' THEN 'delivered' ELSE 'pending' END status, strftime(CASE WHEN k.e IS NOT NULL THEN TIMESTAMP '{NOW}' + INTERVAL 90 SECOND WHEN type = 'view' THEN t + INTERVAL 5 DAY END, '%Y-%m-%d %H:%M') lease_until FROM eve LEFT JOIN (SELECT e FROM eve WHERE {DUE} ORDER BY t, e LIMIT 50) k ON k.e = eve.e")


def made_up_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All outbox rows by status, with every failed one's compensation tried where its number isn't divisible by 7."""
    rows = outbox_rows(spark, sf_dir).withColumn("status", F.when(F.col("intent_id") % 3 == 1, "failed").otherwise(F.col("status")))
    told = rows.where("intent_id % 7 <> 0").select("intent_id", (F.col("intent_id") % 2 == 0).alias("ok"))
    once = outbox.compensated(rows, told)
    return outbox.compensated(once, told.withColumn("ok", ~F.col("ok"))).select("intent_id", "status")


add("outbox_compensate", made_up_for, " SELECT e intent_id, CASE WHEN e % 3 = 1 THEN CASE WHEN e % 7 = 0 THEN 'failed' WHEN e % 2 = 0 THEN 'compensation_done' ELSE 'compensation_failed' END WHEN type = 'purchase' THEN 'delivered' WHEN type = 'view' THEN 'in_progress' ELSE 'pending' END status FROM eve")
add("outbox_next_wake", lambda s, d: outbox.next_wake(outbox_rows(s, d)).select(F.date_format("wake_at", "yyyy-MM-dd HH:mm:ss").alias("wake_at")), " SELECT strftime(min(t + INTERVAL 20 DAY), '%Y-%m-%d %H:%M:%S') wake_at FROM eve WHERE e % 3 = 0 AND type IN ('signup', 'click', 'error')")

# --- calendar

HOLIDAYS = ("2024-01-01", "2024-03-29", "2024-04-01", "2024-12-25", "2024-12-26")
add("business_days", lambda s, d: calendar.business_days(s, "2024-01-01", "2024-12-31", s.createDataFrame([(h,) for h in HOLIDAYS], "day string").select(F.to_date("day").alias("day"))), f" SELECT day, row_number() OVER (ORDER BY day) AS number FROM (SELECT CAST(g AS DATE) AS day FROM range(DATE '2024-01-01', DATE '2025-01-01', INTERVAL 1 DAY) r(g)) WHERE isodow(day) < 6 AND day NOT IN ({', '.join(f'DATE {chr(39)}{h}{chr(39)}' for h in HOLIDAYS)})")
add("local_days", lambda s, d: (s.conf.set("spark.sql.session.timeZone", "UTC"), calendar.local_days(s, "2024-03-01", "2024-11-30", "Europe/London").select("day", "hours", F.date_format("starts_at", "yyyy-MM-dd HH:mm").alias("starts_at")))[1], " SELECT day, CASE day WHEN DATE '2024-03-31' THEN 23 WHEN DATE '2024-10-27' THEN 25 ELSE 24 END AS hours, strftime(CAST(day AS TIMESTAMP) - CASE WHEN day > DATE '2024-03-31' AND day <= DATE '2024-10-27' THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END, '%Y-%m-%d %H:%M') starts_at FROM (SELECT CAST(g AS DATE) AS day FROM range(DATE '2024-03-01', DATE '2024-12-01', INTERVAL 1 DAY) r(g))")

# --- stream


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tail of the log through a stream: hourly totals of each type, as the batches leave them."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    parts: dict[int, DataFrame] = {}

    def handle(batch: DataFrame, number: int) -> None:
        hour = F.date_format("ts", "yyyy-MM-dd HH").alias("hour")
        # A batch that is tried again replaces what the first try left.
        parts[number] = written(batch.groupBy(hour, "event_type").agg(F.count("*").alias("n")), "stream")

    import uuid

    root = shared_dir(spark)
    tail.follow(source, f"{root}/cursor-{uuid.uuid4().hex}", handle).awaitTermination()
    return act.union(list(parts.values())).groupBy("hour", "event_type").agg(F.sum("n").alias("n"))


add("stream_tail_totals", streamed, " SELECT strftime(t, '%Y-%m-%d %H') AS hour, type event_type, count(*)::BIGINT n FROM eve GROUP BY 1, 2")

# --- evidence


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    root = shared_dir(spark)
    path, columns = f"{root}/pack-{uuid.uuid4().hex}", ["ord", "u", "type"]
    rows = events(spark, sf_dir)
    told = evidence.pack(rows, "ord", columns, path, rows.agg(F.max("ord")).first()[0])
    stored = spark.read.parquet(path)
    tampered = stored.withColumn("u", F.when(F.col("ord") == 77, F.col("u") + 1).otherwise(F.col("u")))
    return spark.createDataFrame([(told["rows"], evidence.verify_pack(stored, "ord", columns, told), evidence.verify_pack(tampered, "ord", columns, told))], "rows long, whole boolean, tampered boolean")


def merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    bottom = written(evidence.leaves(rows, "ord", ["ord", "u", "type"]), "leaves")
    tree, size = evidence.levels(bottom), bottom.count()
    top = evidence.top_of(tree)
    mine = bottom.where(F.col("idx") == size // 3).first().hash
    proven = evidence.verify(mine, evidence.inclusion(tree, size // 3), top)
    before = 2 * size // 3
    old = evidence.root(bottom.where(F.col("idx") < before))
    grew = evidence.verify_consistency(before, size, old, top, evidence.consistency(tree, before, size))
    return spark.createDataFrame([(top, old, size, proven, grew)], "root string, earlier_root string, leaves long, proven boolean, consistent boolean")


def root_sql(name: str, leaves: str) -> str:
    """CTEs that end in ``name``, one row with the root of the leaves (idx, hash)."""
    node = "sha256(unhex('01') || unhex(hash) || unhex(nxt))"
    return f"{name}_up AS (SELECT idx, hash, count(*) OVER () AS n FROM {leaves} UNION ALL SELECT idx // 2, CASE WHEN nxt IS NULL THEN hash ELSE {node} END, (n + 1) // 2 FROM (SELECT *, lead(hash) OVER (ORDER BY idx) nxt FROM {name}_up WHERE n > 1) WHERE idx % 2 = 0), {name} AS (SELECT hash FROM {name}_up WHERE n = 1 LIMIT 1)"


LEAVES = """leaf AS (SELECT row_number() OVER (ORDER BY e) - 1 idx, sha256(unhex('00') || encode('{"ord":' || e || ',"u":' || u || ',"type":"' || type || '"}')) hash FROM eve), part AS (SELECT * FROM leaf WHERE idx < (SELECT 2 * count(*) // 3 FROM leaf))"""
add("merkle_root", merkle, None)
SQL["merkle_root"] = WITH.replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + f", {LEAVES}, {root_sql('whole', 'leaf')}, {root_sql('earlier', 'part')} SELECT (SELECT hash FROM whole) root, (SELECT hash FROM earlier) earlier_root, (SELECT count(*) FROM leaf) leaves, true proven, true consistent"


def receipt_sql() -> str:
    """The receipt of all nations, hash by hash."""
    rows = """(SELECT sha256('{"n":' || n_nationkey || ',"name":"' || n_name || '","r":' || n_regionkey || '}') h FROM nation)"""
    level = f"(SELECT h p, h || ':' || count(*) h FROM {rows} GROUP BY 1)"
    for n in (12, 8, 4, 0):
        level = f"(SELECT substr(p, 1, {n}) p, sha256(string_agg(h, ',' ORDER BY h)) h FROM {level} GROUP BY 1)"
    return f" SELECT sha256('{evidence.programme_hash(desk_programme())}|0|' || h) receipt FROM {level}"


add("receipt", lambda s, d: s.createDataFrame([(evidence.receipt(claims(s, d)["Nation"], desk_programme(), "0"),)], "receipt string"), receipt_sql())


def sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store written by two commits and read back as of each."""
    import uuid

    root = shared_dir(spark)
    keep = store.Store(spark, f"{root}/store-{uuid.uuid4().hex}", desk_programme())
    out = outcome(spark, sf_dir)
    keep.commit({"Paid": out.delta["Paid"].drop("pid")}, "2024-01-01T00:00:00Z", 0)
    paid = keep.log("Paid", 1).select("o", "amount")  # as committed: not decided again
    keep.commit({"Paid": paid.where("o % 2 = 0").withColumn("op", F.lit("del"))}, "2024-01-02T00:00:00Z", 1)
    count = lambda order: keep.claims("Paid", order).select(F.lit(order).cast("long").alias("ord"), "o")
    return count(1).unionByName(count(2)).groupBy("ord").agg(F.count("*").alias("n"))


add("store_commits", sinks, PAY + " SELECT 1::BIGINT AS ord, count(*) n FROM okay UNION ALL SELECT 2, count(*) FROM okay WHERE o % 2 <> 0")


def refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A derived claim's cache after two refreshes, with the commit between them."""
    import uuid

    programme = parse("program cached\npredicate Order(o: Decimal, c: Decimal, total: Decimal)\npredicate Spent(c: Decimal, total: Decimal)\nderived Spent(c):\n    over Order(_, c, _)\n    value total = sum(t | Order(_, c, t))\n")
    keep = store.Store(spark, f"{shared_dir(spark)}/cache-{uuid.uuid4().hex}", programme)
    rows = claims(spark, sf_dir)["Order"].selectExpr("o", "c", "total", "'ins' AS op")
    keep.commit({"Order": rows.where("o % 3 <> 0")}, "2024-01-01T00:00:00Z", 0)
    keep.refresh("Spent")
    first = keep.cached("Spent")
    keep.commit({"Order": rows.where("o % 3 = 0")}, "2024-01-02T00:00:00Z", 1)
    keep.refresh("Spent")
    shown = lambda df, n: df.select(F.lit(n).cast("long").alias("generation"), F.col("c").cast("long").alias("c"), F.col("total").cast("decimal(18,2)").alias("total"))
    return shown(first, 1).unionByName(shown(keep.cached("Spent"), keep.generation("Spent")["generation"]))


add("derived_refresh", refreshed, " SELECT 1::BIGINT generation, c, CAST(sum(total) AS DECIMAL(18,2)) total FROM ord WHERE o % 3 <> 0 GROUP BY c UNION ALL SELECT 2, c, CAST(sum(total) AS DECIMAL(18,2)) FROM ord GROUP BY c")


def from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals written as JSON lines and read back, decided, with a receipt for each."""
    import uuid

    root = shared_dir(spark)
    path = f"{root}/calls-{uuid.uuid4().hex}"
    p = proposals(spark, sf_dir)
    p.select(F.col("pid").alias("id"), F.lit("pay").alias("transformation"), "actor", F.col("decided_at").cast("string").alias("decided_at"), F.struct(F.col("o").cast("string").alias("o"), F.col("amount").cast("string").alias("amount")).alias("arguments")).write.json(path)
    kinds = {"o": "Decimal", "amount": "Decimal"}
    read = calls.read_calls(spark, path, "pay", kinds).withColumn("o", F.col("o").cast("long"))
    return calls.receipts(read, act.decide(desk(spark, sf_dir), "pay", read, kinds))


add("json_proposals", from_json, PAY + " SELECT pid, why IS NULL accepted, split_part(why, '/', 1) kind, split_part(why, '/', 2) AS rule FROM (SELECT pid, why FROM w UNION ALL SELECT -1 - k, 'bind/known' FROM range(3) g(k))")
add("stored_shape_check", lambda s, d: calls.misfits(events(s, d).select("ord", F.when(F.col("ord") % 9 == 4, F.col("type")).otherwise(F.col("u").cast("string")).alias("u"), "type"), {"u": "bigint"}).select("ord", "misfit"), " SELECT e AS ord, 'u' misfit FROM eve WHERE e % 9 = 4")
add("explain_suppliers", lambda s, d: act.explain(desk(s, d), "pay", proposals(s, d), {"o": "Decimal", "amount": "Decimal"}).where("rule = 'known'").select("pid", F.size("suppliers").cast("bigint").alias("suppliers")), " SELECT -1 - k pid, 0::BIGINT suppliers FROM range(3) g(k)")
add("pack_verified", lambda s, d: packed(s, d), " SELECT count(*) AS rows, true AS whole, false AS tampered FROM eve")
add("keyed_scan", lambda s, d: claims(s, d)["Order"].where("c = 77").select("o", "c", "total"), " SELECT o, c, total FROM ord WHERE c = 77")
add("sql_views", lambda s, d: (compiler(s, d).claims["Order"].createOrReplaceTempView("Order_claims"), s.sql("SELECT status, count(*) AS n FROM Order_claims GROUP BY status"))[1], " SELECT status, count(*) n FROM ord GROUP BY status")
