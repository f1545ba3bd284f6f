"""The past of a set of claims, from the log of operations.

A log is a DataFrame of operations: ``ord`` (the position in the log), ``op`` (ins, del or noop) and
the columns of the claim. At one position a claim is deleted before it is inserted. Any past state is a fold of the log, done as one aggregation
by claim; validity intervals make each analysis a join instead of a replay.
"""

from __future__ import annotations

from dataclasses import fields, replace
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..kinds import literal
from ..lang import ir
from ..plans import rules
from ..plans.compiler import Bindings, Compiler
from .recursion import written

FOREVER = (1 << 63) - 1


def as_of(log: DataFrame, claim: list[str], order: int | None = None) -> DataFrame:
    """The claims that hold after the operation at ``order``."""
    upto = log.where("op <> 'noop'") if order is None else log.where((F.col("op") != "noop") & (F.col("ord") <= order))
    # Numbers and flags only, which are aggregated by hashing: no sort of the log.
    came, added, gone = F.max(F.col("op") == "ins"), F.max(F.when(F.col("op") == "ins", F.col("ord"))), F.max(F.when(F.col("op") != "ins", F.col("ord")))
    held = upto.groupBy(*claim).agg(came.alias("__came"), added.alias("__added"), gone.alias("__gone"))
    return held.where("__came AND (__gone IS NULL OR __added >= __gone)").select(*claim)


def order_at(log: DataFrame, at: str, instant: Column) -> int | None:
    """The last position not later than an instant."""
    return log.where(F.col(at) <= instant).agg(F.max("ord")).first()[0]


def provenance(log: DataFrame, claim: list[str]) -> DataFrame:
    """Claims that hold, each with the position that admitted it: its first insertion after its last deletion."""
    last = F.max(F.when(F.col("op") == "del", F.col("ord"))).over(W.partitionBy(*claim))
    alive = log.withColumn("__gone", F.coalesce(last, F.lit(-1))).where("op = 'ins' AND ord >= __gone")
    return alive.groupBy(*claim).agg(F.min("ord").alias("asserted_at"))


def intervals(log: DataFrame, claim: list[str]) -> DataFrame:
    """When each claim held: from (inclusive) and to (exclusive, FOREVER if it still does)."""
    w = W.partitionBy(*claim).orderBy("ord", "op")
    changes = log.where("op <> 'noop'").withColumn("__was", F.lag("op").over(w)).where("__was IS NULL AND op = 'ins' OR __was <> op")
    spans = changes.withColumn("__to", F.lead("ord").over(w)).where("op = 'ins'")
    return spans.select(*claim, F.col("ord").alias("valid_from"), F.coalesce("__to", F.lit(FOREVER)).alias("valid_to"))


def snapshot(log: DataFrame, claim: list[str], order: int) -> DataFrame:
    """A state to start from later: the claims at ``order``, with it."""
    return as_of(log, claim, order).withColumn("ord", F.lit(order).cast("long"))


def from_snapshot(snap: DataFrame, log: DataFrame, claim: list[str], order: int) -> DataFrame:
    """The state at ``order`` from an earlier snapshot and the operations since."""
    start = snap.select(*claim, F.lit("ins").alias("op"), "ord")
    since = log.where(F.col("ord") <= order).join(F.broadcast(snap.agg(F.max("ord").alias("__base"))), F.col("ord") > F.col("__base")).select(*claim, "op", "ord")
    return as_of(start.unionByName(since), claim)


def history_view(log: DataFrame, columns: dict[str, str]) -> DataFrame:
    """A row for each operation, with typed columns that are null where what was stored isn't of that type."""
    return log.select("ord", "op", *(F.expr(f"try_cast(`{n}` AS {t})").alias(n) for n, t in columns.items()))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of only one side, named by it; empty if the two sets are equal."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def effective_delta(pre: DataFrame, asserted: DataFrame, retracted: DataFrame) -> DataFrame:
    """What an act really changes: added if it wasn't there, removed if it was and isn't asserted again."""
    keys = pre.columns
    added = asserted.distinct().join(pre, keys, "left_anti").withColumn("op", F.lit("ins"))
    removed = retracted.distinct().join(pre, keys, "left_semi").join(asserted, keys, "left_anti").withColumn("op", F.lit("del"))
    return added.unionByName(removed)


def candidate(pre: DataFrame, asserted: DataFrame, retracted: DataFrame) -> DataFrame:
    """The state that an act proposes."""
    return pre.join(retracted, pre.columns, "left_anti").unionByName(asserted).distinct()


def running_total(df: DataFrame, order: str, amount: str, width: int = 1 << 16) -> DataFrame:
    """``df`` with the sum of ``amount`` up to each row in order, without one task holding all rows.

    Orders are cut to ranges of ``width``; only the ranges' totals are summed in one place.
    """
    cut = df.withColumn("__range", F.floor(F.col(order) / width))
    totals = cut.groupBy("__range").agg(F.sum(amount).alias("__sum"))
    before = totals.select("__range", F.coalesce(F.sum("__sum").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    within = F.sum(amount).over(W.partitionBy("__range").orderBy(order).rangeBetween(W.unboundedPreceding, 0))
    return cut.withColumn("__within", within).join(before, "__range").withColumn("total", F.col("__before") + F.col("__within")).drop("__range", "__within", "__before")


# --- rules over versions -------------------------------------------------------------------------

AT = "__at"


def at_version(node, before: bool, fresh=None):
    """A proposition read at the version ``AT``: each pattern also asks that its claim held then."""
    fresh = fresh or count()
    if isinstance(node, ir.Pre):
        return at_version(node.inner, True, fresh)
    if isinstance(node, ir.Claim):
        start, end = ir.Var(f"__from{(n := next(fresh))}"), ir.Var(f"__to{n}")
        low, high = ("<", "<=") if before else ("<=", "<")
        return ir.And((ir.Claim(node.predicate, (*node.args, start, end)), ir.Compare(low, start, ir.Var(AT)), ir.Compare(high, ir.Var(AT), end)))
    if isinstance(node, tuple):
        return tuple(at_version(x, before, fresh) for x in node)
    if hasattr(node, "__dataclass_fields__") and not isinstance(node, ir.Lit | ir.Var):
        return replace(node, **{f.name: at_version(v, before, fresh) for f in fields(node) if isinstance(v := getattr(node, f.name), tuple) or hasattr(v, "__dataclass_fields__")})
    return node


def versioned(c: Compiler, logs: dict[str, DataFrame]) -> Compiler:
    """A compiler over claims with their validity as two further columns."""
    return over_spans(c, {name: intervals(log, c.programme.predicates[name].names()) for name, log in logs.items()})


def over_spans(c: Compiler, spans: dict[str, DataFrame]) -> Compiler:
    declared = {}
    for name in spans:
        p = c.programme.predicates[name]
        declared[name] = replace(p, fields=(*p.fields, ir.Field("valid_from", "Decimal"), ir.Field("valid_to", "Decimal")))
    return Compiler(c.spark, replace(c.programme, predicates={**c.programme.predicates, **declared}), spans)


def evaluate(c: Compiler, rule: ir.Invariant, logs: dict[str, DataFrame]) -> DataFrame:
    """Positions at which a candidate rule would have refused a commit: ``ord``.

    Only cases that a position's operations touch count, judged in the state after it, so that an
    old breach is charged to the position that made it and not to later ones.
    """
    told = rules.impact(c.programme, rule)
    if told.widened:
        raise ValueError(f"{rule.name} can't be judged by cases: {told.widened}")
    left, right = rules.split(rule.body)
    v = versioned(c, logs)
    made = []
    frames: dict[tuple, list[DataFrame]] = {}
    for o in told.occurrences:
        if o.predicate in logs and o.names:
            log = logs[o.predicate]
            names = c.programme.predicates[o.predicate].names()
            at = {n: names[i] for i, n in o.names.items()}
            guards = [F.col(names[i]) == literal(g.kind, g.value) for i, g in o.guards.items() if g.kind in ("Subject", "Bool", "Decimal")]
            log = log.where(reduce(Column.__and__, guards, F.lit(True)))
            frames.setdefault(tuple(sorted(at)), []).append(log.where("op <> 'noop'").select(F.col("ord").alias(AT), *(F.col(at[n]).alias(n) for n in sorted(at))))
    for names, parts in frames.items():
        cases = reduce(DataFrame.unionByName, parts).distinct()
        seeds = Bindings(cases, {AT: "Decimal", **{n: declared_kind(c, rule, n) for n in names}})
        fresh = count()
        b = v.match(at_version(left, False, fresh), seeds)
        b = v.match(ir.Not(at_version(right, False, fresh)), b) if right is not None else b
        made.append(b.df.select(F.col(AT).alias("ord")))
    return reduce(DataFrame.union, made).distinct()


def declared_kind(c: Compiler, rule: ir.Invariant, name: str) -> str:
    for node in ir.walk(rule.body):
        if isinstance(node, ir.Claim) and ir.Var(name) in node.args:
            return c.programme.predicates[node.predicate].fields[node.args.index(ir.Var(name))].kind
    return "Subject"


def split_counts(charged: DataFrame, boundary: int) -> DataFrame:
    """How many charges fall in each slice of the history."""
    return charged.groupBy(F.when(F.col("ord") <= boundary, "train").otherwise("test").alias("slice")).agg(F.count("*").alias("charges"))


def rehearse(c: Compiler, gate, proposals: DataFrame, kinds: dict[str, str], logs: dict[str, DataFrame]) -> DataFrame:
    """Every recorded proposal decided again under a candidate gate, each in the state before it.

    ``proposals``: ord, the parameters, and ``accepted`` as recorded. What was recorded stays the
    history whatever the candidate says, so the proposals are independent of each other.
    """
    v = versioned(c, logs)
    b = Bindings(proposals.withColumnRenamed("ord", AT), {AT: "Decimal", **kinds})
    passes = v.match(ir.Exists(at_version(gate, before=True)), b).df.select(F.col(AT).alias("ord"), F.lit(True).alias("passes"))
    decided = proposals.join(passes, "ord", "left").withColumn("passes", F.coalesce("passes", F.lit(False)))
    verdict = F.when(F.col("passes") == F.col("accepted"), "same").when(F.col("accepted"), "would_reject").otherwise("would_accept")
    return decided.select("ord", verdict.alias("verdict"))


# --- coverage --------------------------------------------------------------------------------------


def antecedents(node) -> list:
    """What the implications of a rule's body speak of, where the body asserts them."""
    if isinstance(node, ir.Implies):
        return [node.left, *antecedents(node.right)]
    if isinstance(node, ir.Forall):
        return [node.source, *antecedents(node.body)]
    return [x for item in node.items for x in antecedents(item)] if isinstance(node, ir.And) else []


def spans_of(v: Compiler, prop) -> DataFrame | None:
    """valid_from and valid_to of each match of claims and comparisons; None if the proposition says more."""
    parts = prop.items if isinstance(prop, ir.And) else (prop,)
    if not all(isinstance(x, ir.Claim | ir.Compare) for x in parts) or any(isinstance(x, ir.Sum | ir.Extremum | ir.Figure | ir.ValueOf) for x in ir.walk(prop)):
        return None
    claims = [x for x in parts if isinstance(x, ir.Claim)]
    if not claims:
        return None
    ends = [(ir.Var(f"__from{i}"), ir.Var(f"__to{i}")) for i in range(len(claims))]
    timed = iter(ir.Claim(x.predicate, (*x.args, *e)) for x, e in zip(claims, ends, strict=True))
    df = v.match(ir.And(tuple(next(timed) if isinstance(x, ir.Claim) else x for x in parts))).df
    begin, end = ([F.col(f"`{e[i].name}`") for e in ends] for i in (0, 1))
    both = df.select((F.greatest(*begin) if len(ends) > 1 else begin[0]).alias("valid_from"), (F.least(*end) if len(ends) > 1 else end[0]).alias("valid_to"))
    return both.where("valid_from < valid_to")


def fired_at(lines: DataFrame, width: int = 1 << 16) -> DataFrame:
    """(rule, ord) where the sum of ``step`` up to a position that is ``touched`` is above 0, by one shuffle.

    Lines are (rule, ord, step, touched). They are dealt by rule and range of positions; only the
    ranges' totals of a rule come together.
    """
    dealt = lines.withColumn("__range", F.floor(F.col("ord") / width)).repartition("rule", "__range")
    line = dealt.groupBy("rule", "__range", "ord").agg(F.sum("step").alias("step"), F.max("touched").alias("touched"))
    totals = line.groupBy("rule", "__range").agg(F.sum("step").alias("__sum"))
    earlier = W.partitionBy("rule").orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select("rule", "__range", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"))
    within = F.sum("step").over(W.partitionBy("rule", "__range").orderBy("ord"))
    return line.withColumn("__within", within).join(before, ["rule", "__range"]).where("touched AND __before + __within > 0").select("rule", "ord")


def coverage(c: Compiler, logs: dict[str, DataFrame], refused: DataFrame | None = None, only: list[str] | None = None) -> DataFrame:
    """For each rule: rule, fired, first, last, refused, verdict, in_programme.

    A position fires a rule if its operations touch a predicate that the antecedent of an
    implication in it speaks of and that antecedent has a match, old or new, in the state after it;
    an antecedent that looks back may be fired by any position. ``refused`` has a row (rule) for
    each refusal; rules that only it names are told with ``in_programme`` false. The verdict is
    ``constrained`` if the rule refused anything, else ``always_on`` if it has no implication, else
    ``fired`` or ``never_fired``. Calls aren't looked into: an antecedent that is one is matched at
    each touched position like all that is not a conjunction of claims and comparisons.
    """
    spans = {p: written(intervals(log, c.programme.predicates[p].names()), "spans") for p, log in logs.items()}
    v = over_spans(c, spans)
    touched = {p: log.where("op <> 'noop'").select("ord") for p, log in logs.items()}
    lines: list[DataFrame] = []
    matched: list[DataFrame] = []
    listed: dict[str, bool] = {}
    by_predicate: dict[str, list[str]] = {}
    several = False
    for rule in c.programme.invariants:
        if only is not None and rule.name not in only:
            continue
        parts = antecedents(rule.body)
        listed[rule.name] = not parts
        several = several or len(parts) > 1
        for i, left in enumerate(parts):
            name = f"{i} {rule.name}"
            reads = sorted(set(logs) if any(isinstance(x, ir.Pre) for x in ir.walk(left)) else ir.predicates(left) & set(logs))
            held = spans_of(v, left)
            if held is not None:
                ends = F.array(*(F.struct(F.col(at).alias("ord"), F.lit(by).alias("step")) for at, by in (("valid_from", 1), ("valid_to", -1))))
                lines.append(held.select(F.explode(ends).alias("end")).select(F.lit(name).alias("rule"), "end.ord", "end.step", F.lit(False).alias("touched")).where(F.col("ord") < FOREVER))
                for p in reads:
                    by_predicate.setdefault(p, []).append(name)
            elif reads:
                at = reduce(DataFrame.unionByName, (touched[p] for p in reads)).distinct().withColumnRenamed("ord", AT)
                found = v.match(ir.Exists(at_version(left, False)), Bindings(at, {AT: "Decimal"}))
                matched.append(found.df.select(F.lit(name).alias("rule"), F.col(AT).alias("ord")))
    for p, names in by_predicate.items():
        lines.append(touched[p].select(F.explode(F.array(*map(F.lit, names))).alias("rule"), "ord", F.lit(0).alias("step"), F.lit(True).alias("touched")))
    if lines:
        matched.append(fired_at(reduce(DataFrame.unionByName, lines)))
    every = c.spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(x).alias("plain")) for n, x in listed.items()))).alias("r")).select("r.*") if listed else c.spark.sql("SELECT '' AS rule, true AS plain WHERE false")
    counts = every.withColumns({"fired": F.lit(0).cast("long"), "first": F.lit(None).cast("long"), "last": F.lit(None).cast("long"), "refused": F.lit(0).cast("long")})
    if matched:
        fired = reduce(DataFrame.unionByName, matched).select(F.substring_index("rule", " ", -1).alias("rule"), "ord")
        if several:  # a position counts once for a rule with several antecedents
            fired = fired.distinct()
        seen = fired.groupBy("rule").agg(F.count("*").alias("fired"), F.min("ord").alias("first"), F.max("ord").alias("last"))
        counts = counts.unionByName(seen, allowMissingColumns=True)
    if refused is not None:
        counts = counts.unionByName(refused.groupBy("rule").agg(F.count("*").alias("refused")), allowMissingColumns=True)
    counts = counts.groupBy("rule").agg(F.max("plain").alias("plain"), F.sum("fired").alias("fired"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("refused").alias("refused"))
    refusals, hits = (F.coalesce(n, F.lit(0)).cast("long") for n in ("refused", "fired"))
    verdict = F.when(refusals > 0, "constrained").when(F.col("plain"), "always_on").when(hits > 0, "fired").otherwise("never_fired")
    return counts.select("rule", hits.alias("fired"), "first", "last", refusals.alias("refused"), verdict.alias("verdict"), F.col("plain").isNotNull().alias("in_programme"))


def usage(c: Compiler, acts: DataFrame) -> DataFrame:
    """How often each transformation was accepted or refused, and of the refusals how many had which cause.

    ``acts``: transformation, accepted, kind and rule (of refusals). A row for each transformation
    and cause (null for the acts accepted), one with 0 acts for those that were never asked for;
    names that the programme doesn't have are told with ``in_programme`` false.
    """
    cause = F.when(~F.col("accepted"), F.concat_ws("/", "kind", "rule")).alias("cause")
    counts = acts.groupBy(F.col("transformation").alias("__t"), "accepted", cause).agg(F.count("*").alias("n"))
    names = c.spark.createDataFrame([(t,) for t in c.programme.transformations], "transformation string")
    both = names.join(counts, F.col("transformation") == F.col("__t"), "full")
    return both.select(F.coalesce("transformation", "__t").alias("transformation"), "accepted", "cause", F.coalesce("n", F.lit(0)).cast("long").alias("acts"), F.col("transformation").isNotNull().alias("in_programme"))
