"""Patterns, joins, aggregates, derived claims, values and rules: the query core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lang.parser import parse
from ..plans import rules
from ..plans.compiler import Compiler
from ..plans.derived import derived, figure, live
from .tables import claims, compiler, programme, prop, value

QUERIES, SQL = {}, {}

ORD = "SELECT o_orderkey o, o_custkey c, o_orderstatus status, CAST(o_totalprice AS DECIMAL(14,2)) total, CAST(o_orderdate AS DATE) d, o_orderpriority priority FROM orders"
LIN = "SELECT l_orderkey o, l_partkey p, l_suppkey s, l_linenumber n, CAST(l_quantity AS DECIMAL(14,2)) qty, CAST(l_extendedprice AS DECIMAL(14,2)) price, CAST(l_discount AS DECIMAL(4,2)) disc, l_returnflag flag, CAST(l_shipdate AS DATE) shipped FROM lineitem"
CUS = "SELECT c_custkey c, c_name AS name, c_nationkey n, CAST(c_acctbal AS DECIMAL(14,2)) balance, c_mktsegment segment FROM customer"
EVE = "SELECT event_id e, ts AS t, user_id AS u, event_type AS type, CAST(value AS DECIMAL(14,2)) AS value FROM events"
WITH = f"WITH ord AS ({ORD}), lin AS ({LIN}), cus AS ({CUS}), eve AS ({EVE}) "


def add(name: str, make, sql: str | None) -> None:
    QUERIES[name] = make
    if sql is not None:
        SQL[name] = WITH + sql if not sql.lstrip().startswith("WITH") else WITH + "," + sql.lstrip()[4:]


def matched(name: str, text: str, columns: list[str], sql: str | None) -> None:
    """A proposition's bindings, projected."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return compiler(spark, sf_dir).match(prop(text)).df.selectExpr(*columns)

    add(name, run, sql)


def computed(name: str, over: str, values: dict[str, str], columns: list[str], sql: str | None) -> None:
    """Values for the bindings of a proposition, projected."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return figure(compiler(spark, sf_dir), {k: value(v) for k, v in values.items()}, prop(over)).selectExpr(*columns)

    add(name, run, sql)


M = "cast({} AS decimal(18,2)) AS {}"
money = lambda e, n=None: M.format(e, n or e)

# --- patterns, joins, logic

matched("claim_pattern", "Order(o, c, #F, total, _, _)", ["o", "c", "total"], "SELECT o, c, total FROM ord WHERE status = 'F'")
matched("claim_pattern_wildcard_bag", "Order(_, _, status, _, _, priority)", ["status", "priority"], "SELECT status, priority FROM ord")
matched("repeated_var_pattern", "Nation(x, name, x)", ["x", "name"], "SELECT n_nationkey x, n_name AS name FROM nation WHERE n_nationkey = n_regionkey")
matched("conjunction_join", "Customer(c, name, n, _, #BUILDING) and Order(o, c, _, total, _, _) and Line(o, p, _, 1, qty, _, _, _, _, _, _)", ["c", "n", "o", "total", "p", "qty"], "SELECT cus.c, cus.n, ord.o, total, p, qty FROM cus JOIN ord USING (c) JOIN lin ON lin.o = ord.o WHERE segment = 'BUILDING' AND lin.n = 1")
matched("theta_window_join", "Order(o, _, _, _, on, _) and Line(o, _, _, n, _, _, _, _, _, _, shipped) and on on_or_before shipped and shipped on_or_before on + span(P30D)", ["o", "cast(n AS bigint) AS n", "shipped"], "SELECT ord.o, CAST(n AS BIGINT) n, shipped FROM ord JOIN lin USING (o) WHERE shipped BETWEEN d AND d + 30")
matched("cross_alternatives", "Nation(n, _, _) and Region(r, name)", ["n", "r", "name"], "SELECT n_nationkey n, r_regionkey r, r_name AS name FROM nation, region")
matched("disjunction_bag", "Order(o, _, status, total, _, _) and (status = #F or total > 300000)", ["o", "status"], "SELECT o, status FROM ord WHERE status = 'F' UNION ALL SELECT o, status FROM ord WHERE total > 300000")
matched("disjunction_common_vars", "(Customer(k, name, _, _, _) or Supplier(k, name, _, _))", ["k", "name"], "SELECT c k, name FROM cus UNION ALL SELECT s_suppkey, s_name FROM supplier")
matched("negation", "Order(o, c, _, _, _, _) and not Line(o, _, _, _, _, _, _, _, _, _, _)", ["o", "c"], "SELECT o, c FROM ord WHERE NOT EXISTS (SELECT 1 FROM lin WHERE lin.o = ord.o)")
matched("exists_semi", "Part(p, name, _, _, _, _) and (exists o: Line(o, p, _, _, _, _, _, _, #R, _, _))", ["p", "name"], "SELECT p_partkey p, p_name AS name FROM part WHERE EXISTS (SELECT 1 FROM lin WHERE p = p_partkey AND flag = 'R')")
matched("exists_correlated_theta", "Customer(c, _, _, balance, _) and (exists o: Order(o, c, _, total, _, _) and total < balance)", ["c"], "SELECT c FROM cus WHERE EXISTS (SELECT 1 FROM ord WHERE ord.c = cus.c AND total < balance)")
matched("implies_vacuous", "Customer(c, _, _, _, _) and (Order(o, c, #F, total, _, _) implies total > 50000)", ["c"], "SELECT c FROM cus WHERE NOT EXISTS (SELECT 1 FROM ord WHERE ord.c = cus.c AND status = 'F' AND NOT total > 50000)")
matched("forall_holds", "Order(o, _, _, _, on, _) and (forall s in Line(o, _, _, _, _, _, _, _, _, _, s): on before s)", ["o"], "SELECT o FROM ord WHERE NOT EXISTS (SELECT 1 FROM lin WHERE lin.o = ord.o AND NOT d < shipped)")
matched("xor_holds", "Order(o, _, status, total, _, _) and (status = #F xor total > 200000)", ["o"], "SELECT o FROM ord WHERE (status = 'F') <> (total > 200000)")
matched("in_list", "Order(o, _, status, _, _, _) and status in (#F, #P)", ["o", "status"], "SELECT o, status FROM ord WHERE status IN ('F', 'P')")
matched("range_chain", "Line(o, _, _, n, qty, _, _, _, _, _, _) and 10 <= qty <= 12", ["o", "cast(n AS bigint) AS n", "qty"], "SELECT o, CAST(n AS BIGINT) n, qty FROM lin WHERE qty BETWEEN 10 AND 12")
matched("compare_dates", "Order(o, _, _, _, on, _) and @2001-01-01 on_or_before on", ["o", "on AS d"], "SELECT o, d FROM ord WHERE d >= DATE '2001-01-01'")
matched("compare_instants", "Event(e, at, _, _, _) and at at_or_after @2024-01-10T00:00:00Z and at strictly_before @2024-01-10T12:00:00Z", ["e"], "SELECT e FROM eve WHERE t >= TIMESTAMP '2024-01-10' AND t < TIMESTAMP '2024-01-10 12:00:00'")
matched("condition_call_distinct", "Customer(c, _, _, _, _) and Order(o, c, _, _, _, _) and has_lines(o)", ["c", "o"], "SELECT c, o FROM ord WHERE EXISTS (SELECT 1 FROM lin WHERE lin.o = ord.o)")
matched("effective_in_force", "Line(o, _, _, n, _, _, _, _, _, _, shipped) and Order(o, c, _, _, _, _) and terms_in_force_on(c, shipped, total)", ["o", "n", "c", "shipped", "total"], "WITH t AS (SELECT c, d, max(total) total FROM ord GROUP BY 1, 2), l AS (SELECT lin.o, n, c, shipped FROM lin JOIN ord USING (o)) SELECT l.o, l.n, l.c, shipped, t.total FROM l JOIN t ON t.c = l.c AND t.d = (SELECT max(u.d) FROM t u WHERE u.c = l.c AND u.d <= l.shipped)")
matched("recursive_descends", "descends_from(p, ancestor)", ["p", "ancestor"], "SELECT p_partkey p, CAST(p_partkey >> k AS BIGINT) ancestor FROM part, range(1, 64) g(k) WHERE p_partkey > 0 AND (p_partkey >> (k - 1)) > 0")
matched("recursive_bound_question", "descends_from(77, ancestor)", ["ancestor"], "SELECT CAST(77 >> k AS BIGINT) ancestor FROM range(1, 8) g(k) WHERE (77 >> (k - 1)) > 0 AND EXISTS (SELECT 1 FROM part WHERE p_partkey = 77)")
CYCLE = "link AS (SELECT DISTINCT x.u a, y.u b FROM eve x JOIN eve y ON y.e = x.e + 1)"
add("recursive_cycle_closure", lambda spark, d: compiler(spark, d).bindings(prop("reaches(0, b)")), None)
SQL["recursive_cycle_closure"] = WITH.replace("WITH", "WITH RECURSIVE", 1) + f", {CYCLE}, r AS (SELECT a, b FROM link WHERE a = 0 UNION SELECT r.a, link.b FROM r JOIN link ON link.a = r.b) SELECT b FROM r"

# --- collections


def with_collections(spark: SparkSession, sf_dir: str):
    from dataclasses import replace

    from ..lang import ir

    c = compiler(spark, sf_dir)
    c.claims["Basket"] = c.claims["Line"].groupBy("o").agg(F.sort_array(F.collect_set("p")).alias("parts"))
    c.programme = replace(c.programme, predicates={**c.programme.predicates, "Basket": ir.Predicate("Basket", (ir.Field("o", "Decimal"), ir.Field("parts", "Collection")))})
    return c


def over_collections(name: str, text: str, columns: list[str], sql: str) -> None:
    from ..lang.parser import Parser

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = with_collections(spark, sf_dir)
        return c.match(Parser(text, c.programme.predicates).prop()).df.selectExpr(*columns)

    add(name, run, sql)


over_collections("in_collection", "Basket(o, parts) and 7 in parts", ["o"], "SELECT DISTINCT o FROM lin WHERE p = 7")
over_collections("collection_generator", "Basket(o, parts) and p in parts", ["o", "p"], "SELECT DISTINCT o, p FROM lin")
over_collections("forall_in_collection", "Basket(o, parts) and (forall p in parts: p > 100)", ["o"], "SELECT o FROM lin GROUP BY o HAVING min(p) > 100")

# --- aggregates

computed("sum_by_key", "Customer(c, _, _, _, _)", {"total": "sum(t | Order(_, c, _, t, _, _))"}, ["c", money("total")], "SELECT c, CAST(coalesce((SELECT sum(total) FROM ord WHERE ord.c = cus.c), 0) AS DECIMAL(18,2)) total FROM cus")
computed("sum_empty_zero", "Order(o, _, _, _, _, _)", {"qty": "sum(q | Line(o, _, _, _, q, _, _, _, _, _, _))"}, ["o", money("qty")], "SELECT o, CAST(coalesce((SELECT sum(qty) FROM lin WHERE lin.o = ord.o), 0) AS DECIMAL(18,2)) qty FROM ord")
computed("sum_whole", "Region(r, _)", {"total": "sum(b | Customer(_, _, _, b, _))"}, ["r", money("total")], "SELECT r_regionkey r, CAST((SELECT sum(balance) FROM cus) AS DECIMAL(18,2)) total FROM region")
computed("sum_expr", "Order(o, _, _, _, _, _)", {"net": "sum(price * (1 - disc) | Line(o, _, _, _, _, price, disc, _, _, _, _))"}, ["o", "cast(net AS decimal(20,4)) AS net"], "SELECT o, CAST(coalesce((SELECT sum(price * (1 - disc)) FROM lin WHERE lin.o = ord.o), 0) AS DECIMAL(20,4)) net FROM ord")
computed("sum_correlated_bound", "Customer(c, _, _, balance, _)", {"n": "sum(1 | Order(_, c, _, t, _, _) and t > balance * 10)"}, ["c", "cast(n AS bigint) AS n"], "SELECT c, (SELECT count(*) FROM ord WHERE ord.c = cus.c AND total > balance * 10) n FROM cus")
computed("count_bindings", "Nation(n, _, _)", {"customers": "sum(1 | Customer(_, _, n, _, _))"}, ["n", "cast(customers AS bigint) AS customers"], "SELECT n_nationkey n, (SELECT count(*) FROM cus WHERE cus.n = n_nationkey) customers FROM nation")
computed("sum_distinct_call", "Region(0, _)", {"n": "sum(1 | has_lines(o))"}, ["cast(n AS bigint) AS n"], "SELECT count(DISTINCT o) n FROM lin")
computed("sum_duration", "Region(0, _)", {"total": "sum(@2024-02-01T00:00:00Z - at | Event(_, at, _, #error, _))"}, ["cast(total AS bigint) AS total"], "SELECT CAST(sum(epoch_us(TIMESTAMP '2024-02-01') - epoch_us(t)) AS BIGINT) total FROM eve WHERE type = 'error'")
computed("extremum_max", "Customer(c, _, _, _, _) and (exists o: Order(o, c, _, _, _, _))", {"top": "max(t | Order(_, c, _, t, _, _))"}, ["c", money("top")], "SELECT c, CAST(max(total) AS DECIMAL(18,2)) top FROM ord WHERE c IN (SELECT c FROM cus) GROUP BY c")
computed("extremum_min", "Customer(c, _, _, _, _) and (exists o: Order(o, c, _, _, _, _))", {"first": "min(d | Order(_, c, _, _, d, _))"}, ["c", "first"], "SELECT c, min(d) AS first FROM ord WHERE c IN (SELECT c FROM cus) GROUP BY c")
computed("nested_aggregate", "Nation(n, _, _)", {"big": "sum(1 | Customer(c, _, n, b, _) and spent(c) > 3000000)"}, ["n", "cast(big AS bigint) AS big"], "SELECT n_nationkey n, (SELECT count(*) FROM cus WHERE cus.n = n_nationkey AND (SELECT coalesce(sum(total), 0) FROM ord WHERE ord.c = cus.c) > 3000000) big FROM nation")
computed("figure_balance", "Customer(c, _, _, _, _)", {"owed": "owes(c)"}, ["c", money("owed")], "SELECT c, CAST(coalesce((SELECT sum(CASE status WHEN 'O' THEN total WHEN 'F' THEN -total END) FROM ord WHERE ord.c = cus.c), 0) AS DECIMAL(18,2)) owed FROM cus")

# --- derived claims

DERIVED = {d: (lambda spark, sf, d=d: derived(compiler(spark, sf), programme().derived[d])) for d in ("TrialBalance", "ActiveNation")}
add("derived_trial_balance", lambda spark, sf: DERIVED["TrialBalance"](spark, sf).selectExpr("c", money("balance"), "cast(orders AS bigint) AS orders"), "SELECT c, CAST(coalesce(sum(CASE status WHEN 'O' THEN total WHEN 'F' THEN -total END), 0) AS DECIMAL(18,2)) balance, count(*) orders FROM ord GROUP BY c")
add("derived_keys_only", DERIVED["ActiveNation"], "SELECT DISTINCT n FROM cus WHERE balance > 9000")
add("derived_live_error", lambda spark, sf: live(compiler(spark, sf), programme().derived["Largest"]).selectExpr("c", money("total"), "since", "_error AS error"), "SELECT c, CAST(max(total) FILTER (status = 'P') AS DECIMAL(18,2)) total, min(d) FILTER (status = 'P') since, CASE WHEN count(*) FILTER (status = 'P') = 0 THEN 'empty_extremum' END error FROM cus LEFT JOIN ord USING (c) GROUP BY c")

# --- values

computed("value_lookup", "Part(p, _, _, _, _, _) and p > 0", {"up": "value Parent(p, _)"}, ["p", "up"], "SELECT p_partkey p, p_partkey // 2 up FROM part WHERE p_partkey > 0")
computed("value_lookup_default", "Order(o, _, _, _, on, _)", {"total": "value Terms(o, on, _) default 0"}, ["o", money("total")], "WITH t AS (SELECT c, d, max(total) total FROM ord GROUP BY 1, 2) SELECT ord.o, CAST(coalesce(t.total, 0) AS DECIMAL(18,2)) total FROM ord LEFT JOIN t ON t.c = ord.o AND t.d = ord.d")


def flagged_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a lookup has as error: several matches, or none."""
    c = compiler(spark, sf_dir)
    c = Compiler(spark, c.programme, c.claims, flag_errors=True)
    b, v = c.value(value("value Parent(p, _)"), c.match(prop("Part(p, _, _, _, _, _)")))
    b, w = c.value(value("value Parent(_, p)"), b)
    return b.df.select("p", v.error.alias("up"), w.error.alias("down"))


add("value_lookup_errors", flagged_value, "WITH k AS (SELECT p_partkey // 2 AS of_, count(*) n FROM part WHERE p_partkey > 0 GROUP BY 1) SELECT p_partkey p, CASE WHEN p_partkey = 0 THEN 'value_missing' END up, CASE WHEN n IS NULL THEN 'value_missing' WHEN n > 1 THEN 'value_ambiguous' END down FROM part LEFT JOIN k ON of_ = p_partkey")
computed("conditional_value", "Customer(c, _, _, balance, _)", {"v": "if(Order(_, c, #P, _, _, _), balance, 0 - balance)"}, ["c", money("v")], "SELECT c, CAST(CASE WHEN EXISTS (SELECT 1 FROM ord WHERE ord.c = cus.c AND status = 'P') THEN balance ELSE -balance END AS DECIMAL(18,2)) v FROM cus")
computed("min_max_abs", "Customer(c, _, _, b, _)", {"low": "min(b, 100)", "high": "max(-100, b)", "size": "abs(b)"}, ["c", money("low"), money("high"), money("size")], "SELECT c, CAST(least(balance, 100) AS DECIMAL(18,2)) low, CAST(greatest(-100, balance) AS DECIMAL(18,2)) high, CAST(abs(balance) AS DECIMAL(18,2)) size FROM cus")
computed("round_half_away", "Customer(c, _, _, b, _)", {"tens": "round(b, 0.05)", "half": "round(b / 100, 0.01)"}, ["c", money("tens"), money("half")], "SELECT c, CAST(sign(balance) * floor(abs(balance) / 0.05 + 0.5) * 0.05 AS DECIMAL(18,2)) tens, CAST(sign(balance) * floor(abs(balance) + 0.5) / 100 AS DECIMAL(18,2)) half FROM cus")
computed("decimal_mod", "Customer(c, _, _, b, _)", {"rest": "b % 7"}, ["c", money("rest")], "SELECT c, CAST(balance % 7 AS DECIMAL(18,2)) rest FROM cus")


def wide_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of decimals as wide as a schema's own: exact, or flagged."""
    programme = parse("program wide\npredicate W(o: Decimal, n: Decimal, a: Decimal, b: Decimal)\npredicate Out(o: Decimal, n: Decimal, a: Decimal, b: Decimal, p: Decimal)\nderived Out(o, n, a, b):\n    over W(o, n, a, b)\n    value p = a * b\n")
    w = claims(spark, sf_dir)["Line"].select("o", "n", F.expr("cast(if(n = 3, price / 100, price) AS decimal(28,10))").alias("a"), F.expr("cast(if(n = 3, disc / 100000000, disc) AS decimal(28,10))").alias("b"))
    return live(Compiler(spark, programme, {"W": w}), programme.derived["Out"]).selectExpr("o", "n", "cast(p AS decimal(28,12)) AS p", "_error AS error")


add("decimal_exact_or_error", wide_products, "SELECT o, n, CASE WHEN n <> 3 THEN CAST(price * disc AS DECIMAL(28,12)) WHEN k % 100 = 0 THEN CAST(k // 100 AS DECIMAL(15,0)) * CAST('0.000000000001' AS DECIMAL(13,12)) END p, CASE WHEN n = 3 AND k % 100 <> 0 THEN 'decimal_inexact' END error FROM (SELECT *, CAST(price * disc * 10000 AS BIGINT) k FROM lin)")
computed("safe_div", "Line(o, _, _, n, qty, price, _, _, _, _, _)", {"unit": "round(price / qty, 1)"}, ["o", "n", money("unit")], "SELECT o, n, CAST((2 * CAST(price * 100 AS BIGINT) + CAST(qty * 100 AS BIGINT)) // (2 * CAST(qty * 100 AS BIGINT)) AS DECIMAL(18,2)) unit FROM lin")
computed("date_plus_span", "Order(o, _, _, _, on, _)", {"due": "on + span(P1M)", "back": "on - span(P1Y2D)"}, ["o", "due", "back"], "SELECT o, CAST(d + INTERVAL 1 MONTH AS DATE) due, CAST(d - INTERVAL 12 MONTH - INTERVAL 2 DAY AS DATE) back FROM ord")
computed("date_diff_days", "Order(o, _, _, _, on, _) and Line(o, _, _, n, _, _, _, _, _, _, shipped)", {"gap": "shipped - on"}, ["o", "n", "cast(gap AS bigint) AS gap"], "SELECT ord.o, n, date_diff('day', d, shipped) gap FROM ord JOIN lin USING (o)")
computed("period_index_month", "Order(o, _, _, _, on, _)", {"i": "period_index(@1995-01-31, span(P1M), on)"}, ["o", "i"], "SELECT o, m - CASE WHEN CAST(DATE '1995-01-31' + to_months(CAST(m AS INTEGER)) AS DATE) > d THEN 1 ELSE 0 END i FROM (SELECT o, d, date_diff('month', DATE '1995-01-31', d) m FROM ord)")
computed("period_index_days", "Order(o, _, _, _, on, _)", {"i": "period_index(@1996-01-01, span(P14D), on)"}, ["o", "i"], "SELECT o, CAST(floor(date_diff('day', DATE '1996-01-01', d) / 14) AS BIGINT) i FROM ord")
computed("period_index_mixed", "Order(o, _, _, _, on, _)", {"i": "period_index(@1996-01-31, span(P1M3D), on)"}, ["o", "i"], "SELECT o, (SELECT max(k) FROM range(-20, 90) g(k) WHERE CAST(DATE '1996-01-31' + to_months(CAST(k AS INTEGER)) + to_days(CAST(3 * k AS INTEGER)) AS DATE) <= d) i FROM ord")
computed("period_start_of", "Order(o, _, _, _, on, _)", {"start": "period_start_of(@1995-01-31, span(P3M), period_index(@1995-01-31, span(P3M), on))"}, ["o", "start"], "SELECT o, CAST(DATE '1995-01-31' + to_months(CAST(3 * (q - CASE WHEN CAST(DATE '1995-01-31' + to_months(CAST(3 * q AS INTEGER)) AS DATE) > d THEN 1 ELSE 0 END) AS INTEGER)) AS DATE) AS start FROM (SELECT o, d, CAST(floor(date_diff('month', DATE '1995-01-31', d) / 3) AS BIGINT) q FROM ord)")
matched("periods_hourly", "Event(e, at, _, _, _) and h in periods(at, at + duration(PT3H), duration(PT1H))", ["e", "date_format(h, 'yyyy-MM-dd HH') AS h"], "SELECT e, strftime(to_timestamp(k * 3600) AT TIME ZONE 'UTC', '%Y-%m-%d %H') h FROM (SELECT e, unnest(range(epoch_us(t) // 3600000000, (epoch_us(t) + 3 * 3600000000 - 1) // 3600000000 + 1)) k FROM eve)")
computed("duration_arithmetic", "Event(e, at, _, _, _)", {"rest": "@2024-02-01T00:00:00Z - at", "share": "(@2024-02-01T00:00:00Z - at) / duration(PT24H)"}, ["e", "rest", "cast(round(share, 4) AS decimal(18,4)) AS share"], "SELECT e, epoch_us(TIMESTAMP '2024-02-01') - epoch_us(t) AS rest, CAST(round(CAST(epoch_us(TIMESTAMP '2024-02-01') - epoch_us(t) AS DECIMAL(20,0)) / 86400000000, 4) AS DECIMAL(18,4)) share FROM eve")
computed("digest_commitment", "Order(o, c, _, total, on, _)", {"sealed": "digest(#bid, o, total, on)"}, ["o", "sealed"], """SELECT o, 'sha256:' || sha256('[["subject", "bid"], ["decimal", "' || o || '"], ["decimal", "' || rtrim(rtrim(CAST(total AS VARCHAR), '0'), '.') || '"], ["date", "' || d || '"]]') sealed FROM ord""")

# --- rules


def broken(name: str, rule: str, columns: list[str], sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = compiler(spark, sf_dir)
        return rules.violations(c, next(r for r in c.programme.invariants if r.name == rule)).selectExpr(*columns)

    add(name, run, sql)


broken("implies_violations", "orders_match_their_lines", ["o", "total"], "SELECT o, total FROM ord JOIN (SELECT o, sum(price) price FROM lin GROUP BY o) USING (o) WHERE total <> price")
broken("forall_violations", "shipped_after_order", ["o"], "SELECT o FROM ord WHERE EXISTS (SELECT 1 FROM lin WHERE lin.o = ord.o AND NOT d < shipped)")


def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.disciplines import duplicated

    c = compiler(spark, sf_dir)
    return duplicated(c.claims["Line"], ["o", "n"]).selectExpr("o", "cast(n AS bigint) AS n")


add("unique_by_violations", duplicate_keys, "SELECT o, CAST(n AS BIGINT) n FROM (SELECT DISTINCT l_orderkey o, l_linenumber n, * EXCLUDE (l_orderkey, l_linenumber) FROM lineitem) GROUP BY o, n HAVING count(*) > 1")


def changed(spark: SparkSession, sf_dir: str):
    """Lines whose price a change raises by one: the delta, and the state after it."""
    c = compiler(spark, sf_dir)
    line = c.claims["Line"]
    hit = line.where("o % 1000 = 3")
    raised = hit.withColumn("price", (F.col("price") + 1).cast("decimal(14,2)"))
    c.claims["Line"] = line.where("o % 1000 <> 3").unionByName(raised)
    return c, {"Line": hit.unionByName(raised)}


def case_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, delta = changed(spark, sf_dir)
    return rules.checked(c, next(r for r in c.programme.invariants if r.name == "orders_match_their_lines"), delta).selectExpr("o", "total")


add("case_local_check", case_local, "SELECT o, total FROM ord JOIN (SELECT o, sum(price + CASE WHEN o % 1000 = 3 THEN 1 ELSE 0 END) price FROM lin GROUP BY o) USING (o) WHERE total <> price AND o % 1000 = 3")


def witness(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, delta = changed(spark, sf_dir)
    rule = next(r for r in c.programme.invariants if r.name == "orders_match_their_lines")
    return rules.compared(c, rule, rules.first_violation(rules.checked(c, rule, delta).select("o", "total"))).selectExpr("o", "total", "op", money("`left`", "a"), money("`right`", "b"))


add("first_violation_witness", witness, "SELECT o, total, '=' op, CAST(total AS DECIMAL(18,2)) a, CAST(price AS DECIMAL(18,2)) b FROM ord JOIN (SELECT o, sum(price + CASE WHEN o % 1000 = 3 THEN 1 ELSE 0 END) price FROM lin GROUP BY o) USING (o) WHERE total <> price AND o % 1000 = 3 ORDER BY o LIMIT 1")


def pre_post(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances may only rise: customers whose balance a change lowers."""
    from ..lang import ir

    c = compiler(spark, sf_dir)
    c.pre = dict(c.claims)
    c.claims["Customer"] = c.claims["Customer"].withColumn("balance", F.expr("cast(balance + (c % 5) - 2 AS decimal(14,2))"))
    rule = ir.Invariant("balances_rise", prop("Customer(c, _, _, after, _) and pre(Customer(c, _, _, before, _)) implies before <= after"))
    return rules.violations(c, rule).selectExpr("c", "before", "after")


add("pre_post_transition_rule", pre_post, "SELECT c, balance before, CAST(balance + c % 5 - 2 AS DECIMAL(14,2)) AS after FROM cus WHERE c % 5 < 2")


def impact_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each rule answers a change of lines."""
    p = programme()
    rows = [(r.name, (i := rules.impact(p, r)).widened or "bounded", any(o.predicate == "Line" for o in i.occurrences)) for r in p.invariants]
    return spark.createDataFrame(rows, "rule string, reach string, reads_lines boolean")


add("impact_classification", impact_table, "SELECT * FROM (VALUES ('customer_unique_by_c', 'bounded', false), ('order_unique_by_o', 'bounded', false), ('line_unique_by_o_n', 'bounded', true), ('parent_unique_by_p', 'bounded', false), ('terms_unique_by_c_on', 'bounded', false), ('orders_match_their_lines', 'bounded', true), ('shipped_after_order', 'bounded', true)) t(rule, reach, reads_lines)")
