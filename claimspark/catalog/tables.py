"""The bench tables as predicates."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lang import ir
from ..lang.parser import parse, parse_prop, parse_value
from ..plans.compiler import Compiler

TEXT = """
program trade
predicate Region(r: Decimal, name: Subject)
predicate Nation(n: Decimal, name: Subject, r: Decimal)
predicate Customer(c: Decimal, name: Subject, n: Decimal, balance: Decimal, segment: Subject)
    unique by (c)
predicate Supplier(s: Decimal, name: Subject, n: Decimal, balance: Decimal)
predicate Part(p: Decimal, name: Subject, brand: Subject, type: Subject, size: Decimal, price: Decimal)
predicate Order(o: Decimal, c: Decimal, status: Subject, total: Decimal, on: Date, priority: Subject)
    unique by (o)
predicate Line(o: Decimal, p: Decimal, s: Decimal, n: Decimal, qty: Decimal, price: Decimal, disc: Decimal, tax: Decimal, flag: Subject, status: Subject, shipped: Date)
    unique by (o, n)
predicate Event(e: Decimal, at: Timestamp, user: Decimal, type: Subject, value: Decimal)
    append only
predicate Parent(p: Decimal, of: Decimal)
    unique by (p)
predicate Link(a: Decimal, b: Decimal)
predicate TrialBalance(c: Decimal, balance: Decimal, orders: Decimal)
predicate ActiveNation(n: Decimal)
predicate Largest(c: Decimal, total: Decimal, since: Date)
predicate Terms(c: Decimal, on: Date, total: Decimal)
    effective by (c) on (on) partial

define has_lines(o):
    Line(o, _, _, _, _, _, _, _, _, _, _)
define spent(c) = (sum(total | Order(_, c, _, total, _, _)))
define owes(c) = (sum(total | Order(_, c, #O, total, _, _)) - sum(total | Order(_, c, #F, total, _, _)))
define descends_from(p, ancestor):
    Parent(p, ancestor)
    or (Parent(p, between) and descends_from(between, ancestor))
define reaches(a, b):
    Link(a, b)
    or (reaches(a, between) and Link(between, b))

derived TrialBalance(c):
    over Order(_, c, _, _, _, _)
    value balance = owes(c)
    value orders = sum(1 | Order(_, c, _, _, _, _))
derived ActiveNation(n):
    over Customer(c, _, n, balance, _) and balance > 9000
derived Largest(c):
    over Customer(c, _, _, _, _)
    value total = max(total | Order(_, c, #P, total, _, _))
    value since = min(on | Order(_, c, #P, _, on, _))

invariant orders_match_their_lines:
    Order(o, _, _, total, _, _) and has_lines(o) implies total = sum(price | Line(o, _, _, _, _, price, _, _, _, _, _))
invariant shipped_after_order:
    Order(o, _, _, _, on, _) implies (forall s in Line(o, _, _, _, _, _, _, _, _, _, s): on before s)
"""

MONEY, RATE = "decimal(14,2)", "decimal(4,2)"


@lru_cache
def programme() -> ir.Programme:
    return parse(TEXT)


def claims(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    spark.conf.set("spark.sql.session.timeZone", "UTC")

    def of(table: str, **columns: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*(f"{e} AS `{n}`" for n, e in columns.items()))

    out = {
        "Region": of("region", r="r_regionkey", name="r_name"),
        "Nation": of("nation", n="n_nationkey", name="n_name", r="n_regionkey"),
        "Customer": of("customer", c="c_custkey", name="c_name", n="c_nationkey", balance=f"cast(c_acctbal AS {MONEY})", segment="c_mktsegment"),
        "Supplier": of("supplier", s="s_suppkey", name="s_name", n="s_nationkey", balance=f"cast(s_acctbal AS {MONEY})"),
        "Part": of("part", p="p_partkey", name="p_name", brand="p_brand", type="p_type", size="p_size", price=f"cast(p_retailprice AS {MONEY})"),
        "Order": of("orders", o="o_orderkey", c="o_custkey", status="o_orderstatus", total=f"cast(o_totalprice AS {MONEY})", on="cast(o_orderdate AS date)", priority="o_orderpriority"),
        "Line": of("lineitem", o="l_orderkey", p="l_partkey", s="l_suppkey", n="l_linenumber", qty=f"cast(l_quantity AS {MONEY})", price=f"cast(l_extendedprice AS {MONEY})", disc=f"cast(l_discount AS {RATE})", tax=f"cast(l_tax AS {RATE})", flag="l_returnflag", status="l_linestatus", shipped="cast(l_shipdate AS date)"),
        "Event": of("events", e="event_id", at="cast(ts AS timestamp)", user="user_id", type="event_type", value=f"cast(value AS {MONEY})"),
    }
    out["Parent"] = out["Part"].where("p > 0").selectExpr("p", "p div 2 AS of")
    e = out["Event"]
    # Who acted next after whom: a graph with cycles.
    out["Link"] = e.alias("x").join(e.alias("y"), F.expr("y.e = x.e + 1")).selectExpr("x.user AS a", "y.user AS b").distinct()
    out["Terms"] = out["Order"].groupBy("c", "on").agg(F.max("total").alias("total"))
    return out


def compiler(spark: SparkSession, sf_dir: str, pre: dict[str, DataFrame] | None = None) -> Compiler:
    return Compiler(spark, programme(), claims(spark, sf_dir), pre)


def prop(text: str):
    return parse_prop(text, programme())


def value(text: str):
    return parse_value(text, programme())
