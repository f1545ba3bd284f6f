"""Deciding actions, a whole frame of proposals at a time.

Each proposal is a row: ``pid``, ``actor``, ``decided_at`` and the parameters. The statements of a
transformation are run over all rows at once against the state before: gates split off refusals,
bindings are joins, loops explode. Nothing in a body sees what the body writes. The staged claims
become an effective delta; the rules that the delta touches are checked for the cases it touches.

A refusal keeps its place: the number of its statement, within a branch or loop after that of the
branch or loop and the number of the pass. The first in this order is the one reported.

``decide`` gives each proposal the answer it would get if they were decided and committed one after
another by ``pid``. Those before the first one that depends on an earlier one are decided at once, the
rest in further rounds: a proposal depends on an earlier one that writes the same claim, a claim that
one of its patterns may read, or a claim in the same case of a rule. ``fold`` runs acts of several
transformations one after another.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import takewhile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..kinds import kind_of_type, literal, measured
from ..lang import ir
from ..lang.analysis import suppliers
from ..lang.lower import require_valid
from ..plans import rules
from ..plans.compiler import Bindings, Compiler, tells_by_itself
from .history import candidate
from .recursion import written

PID = "pid"
#: Of each row, the loops and branches it is in: numbers of statements and passes.
PATH = "__path"


class Ambiguous(ValueError):
    """A ``bind`` matched several claims."""


def without(rows: DataFrame, those: DataFrame) -> DataFrame:
    """Rows but of those proposals, which are as many as there may be: never sent whole to every node."""
    return rows.join(those.select(PID).hint("merge"), PID, "left_anti")


@dataclass
class Staged:
    """What proposals would do, if the rules let them."""

    adds: dict[str, list[DataFrame]] = field(default_factory=dict)
    removes: dict[str, list[DataFrame]] = field(default_factory=dict)
    intents: dict[str, list[DataFrame]] = field(default_factory=dict)
    refusals: list[DataFrame] = field(default_factory=list)
    #: How many gates the rows of each frame have passed, by the frame's id, and how many there are.
    passed: dict[int, int] = field(default_factory=dict)
    gates: int = 0
    #: Whether no proposal is in two of the refusals.
    once: bool = True

    def accepted(self, rows: DataFrame, gated: DataFrame) -> DataFrame:
        """Rows of proposals that no gate refuses; those behind all gates are."""
        return rows if self.passed[id(rows)] == self.gates else without(rows, gated)


@dataclass
class Outcome:
    """Refusals (pid, kind, rule) and, of the rest, the effective delta and the intents."""

    refused: DataFrame
    delta: dict[str, DataFrame]  # claims with pid and op
    intents: dict[str, DataFrame]
    after: dict[str, DataFrame]


class Body:
    """Runs the statements of one transformation over the rows of ``proposals``."""

    def __init__(self, c: Compiler, t: ir.Transformation, traced: bool = False, single: bool = False):
        self.c, self.t, self.staged = c, t, Staged()
        self.minted = self.here = 0
        #: Gates so far; those that all rows here have passed, once each proposal is known to be one row.
        self.gates = self.passed = 0
        self.single, self.looping = single, False
        #: Numbers of the branches that all rows here are in.
        self.place: tuple[int, ...] = ()
        #: Of gates judged before their turn, by place and number, the rows that fail.
        self.failed: dict[tuple[int, ...], DataFrame] = {}
        self.steps: list[DataFrame] | None = [] if traced else None

    def fields(self, predicate: str) -> list:
        """Names and types of a predicate's columns."""
        return self.c.claims[predicate].schema.fields

    def found(self, claim: ir.Claim, b: Bindings) -> Bindings:
        """The claims that a pattern matches in the state before."""
        return self.c.match(claim, b)

    def run(self, proposals: DataFrame, kinds: dict[str, str]) -> Staged:
        rows = proposals.withColumn(PATH, F.array().cast("array<long>"))
        self.block(self.t.body, Bindings(rows, {PID: "Decimal", "actor": "Subject", "decided_at": "Timestamp", PATH: "Collection", **kinds}))
        self.staged.gates = self.gates
        return self.staged

    def block(self, body: tuple, b: Bindings) -> None:
        for self.here, s in enumerate(body):
            here, before, self.body = self.here, b, body
            b = getattr(self, f"on_{type(s).__name__.lower()}")(s, b)
            if self.steps is not None:
                self.steps.append(step(here, s, before, b))

    def inside(self, b: Bindings, number: Column | None = None) -> Bindings:
        """The rows of a branch or, by the number of the pass, of a loop."""
        step = F.array(*(x.cast("long") for x in (F.lit(self.here), *([number] if number is not None else []))))
        return Bindings(b.df.withColumn(PATH, F.concat(PATH, step)), b.kinds)

    def nested(self, body: tuple, b: Bindings, looping: bool = False) -> None:
        """The block of a branch or loop: its gates say nothing of the rows that go on after it."""
        before = self.passed, self.single, self.looping, self.place
        self.looping, self.place = self.looping or looping, (*self.place, self.here)
        self.block(body, b)
        self.passed, self.single, self.looping, self.place = before

    def gate(self) -> None:
        self.gates += 1
        self.passed += self.single and not self.looping

    def stage(self, where: dict[str, list[DataFrame]], name: str, rows: DataFrame) -> None:
        where.setdefault(name, []).append(rows)
        self.staged.passed[id(rows)] = self.passed

    def refuse(self, kind: str, name: str, rows: DataFrame) -> None:
        at = F.concat(PATH, F.array(F.lit(self.here).cast("long")))
        # Outside of branches and loops, one row for each proposal ends at its first refusal.
        self.staged.once = self.staged.once and self.single and not self.place
        self.staged.refusals.append(rows.select(PID, at.alias("at"), F.lit(kind).alias("kind"), F.lit(name).alias("rule")))

    def on_require(self, s: ir.Require, b: Bindings) -> Bindings:
        if (failed := self.failed.get((*self.place, self.here))) is not None:
            self.refuse("require", s.name or "require", failed)
            self.gate()
            return b
        kept = self.c.match(ir.Exists(s.prop), b)
        # Inside a loop a gate holds for every pass: a proposal is refused for any row that fails.
        self.refuse("require", s.name or "require", self.c.match(ir.Not(s.prop), b).df)
        self.gate()
        return kept

    def on_bind(self, s: ir.Bind, b: Bindings) -> Bindings:
        if self.single and not self.looping and isinstance(s.prop, ir.Claim) and (counted := self.c.counted(s.prop, b, "__n")) is not None:
            return self.bound(s, counted)
        found = self.c.match(s.prop, b)
        # All statements below start from here: written once, not joined again for each of them.
        found = replace(found, df=written(found.df.select(*(F.col(f"`{n}`") for n in found.kinds)), "bound"))
        came, went = (x.df.select(PID, PATH, F.lit(n).alias("n")) for x, n in ((b, 0), (found, 1)))
        odd = written(came.unionByName(went).groupBy(PID, PATH).agg(F.sum("n").alias("n")).where(f"n <> 1 OR {PID} IS NULL"), "matches")
        self.refuse("bind", s.name or "bind", odd.where(f"n = 0 OR {PID} IS NULL"))
        if one := odd.where("n > 1").isEmpty():
            self.single = self.single or not self.looping
        else:
            self.single = False
            several = found.df.groupBy(*(f"`{n}`" for n in b.kinds)).count().where("count > 1")
            self.refuse("error", f"{s.name or 'bind'} is ambiguous", several)
        if one:
            self.gate()
        else:  # rows of refused proposals go on
            self.gates += 1
        return found

    def bound(self, s: ir.Bind, counted: Bindings) -> Bindings:
        """Of proposals that are one row each: those with one claim go on, the others are refused here."""
        flat = [n for n in counted.kinds if n != PATH]
        # Gates that come next and only compare what is bound are judged as the rows are written: once, not by each statement below.
        easy = lambda g: isinstance(g, ir.Require) and tells_by_itself(g.prop) and ir.variables(g.prop) & set(flat) and not any(isinstance(n, ir.Bin) for n in ir.walk(g.prop))
        gates = list(takewhile(easy, self.body[self.here + 1 :]))
        stop = F.when(F.col("__n") != 1, 0)
        for i, g in enumerate(gates, 1):
            stop = stop.when(~self.c.holds(g.prop, counted)[1], i)
        rows = written(counted.df.select(*(F.col(f"`{n}`") for n in flat), "__n", stop.alias("__stop")), "bound")
        # All rows are in the same place, which needn't be written.
        rows = rows.withColumn(PATH, F.array(*(F.lit(i).cast("long") for i in self.place)).cast("array<long>"))
        name = s.name or "bind"
        self.refuse("bind", name, rows.where("__n = 0"))
        self.refuse("error", f"{name} is ambiguous", rows.where("__n > 1").select(PID, PATH).distinct())
        self.gate()
        self.failed.update({(*self.place, self.here + i): rows.where(F.col("__stop") == i) for i in range(1, len(gates) + 1)})
        return Bindings(rows.where("__stop IS NULL").drop("__n", "__stop"), counted.kinds)

    def on_let(self, s: ir.Let, b: Bindings) -> Bindings:
        if isinstance(s.value, ir.New):
            self.minted += 1
            # Deterministic, so that a recomputed task mints the same subject.
            new = F.concat(F.lit("s-"), F.substring(F.sha2(F.concat_ws("|", F.lit(self.t.name), F.col(PID).cast("string"), F.lit(str(self.minted)), *(F.col(f"`{n}`").cast("string") for n in sorted(b.kinds) if n not in (PID,))), 256), 1, 32))
            return Bindings(b.df.withColumn(s.name, new), {**b.kinds, s.name: "Subject"})
        b, v = self.c.value(s.value, b)
        return Bindings(b.df.withColumn(s.name, self.c.checked(v)), {**b.kinds, s.name: measured(v.kind, v.unit)})

    def row(self, args: tuple, names: list[str], types: list, b: Bindings) -> DataFrame:
        columns: list[Column] = []
        for arg in args:
            b, v = self.c.value(arg, b)
            columns.append(self.c.checked(v))
        return b.df.select(PID, *(c.cast(t).alias(n) if t is not None else c.alias(n) for c, n, t in zip(columns, names, types, strict=True)))

    def on_admit(self, s: ir.Admit, b: Bindings) -> Bindings:
        have = self.fields(s.predicate)
        self.stage(self.staged.adds, s.predicate, self.row(s.args, [f.name for f in have], [f.dataType for f in have], b))
        return b

    def on_emit(self, s: ir.Emit, b: Bindings) -> Bindings:
        names = [f.name for f in self.c.programme.intents[s.intent]]
        self.stage(self.staged.intents, s.intent, self.row(s.args, names, [None] * len(names), b))
        return b

    def on_retract(self, s: ir.Retract, b: Bindings) -> Bindings:
        have = [f.name for f in self.fields(s.claim.predicate)]
        fresh = [self.c.name("r") for _ in have]
        # The pattern's open places take names of their own, so that the whole claim is found.
        args = tuple(ir.Var(n) if isinstance(a, ir.Wild) or isinstance(a, ir.Var) and a.name not in b.kinds else a for a, n in zip(s.claim.args, fresh, strict=True))
        bound = b
        for i, a in enumerate(args):
            if not isinstance(a, ir.Var):
                bound, v = self.c.value(a, bound)
                bound = Bindings(bound.df.withColumn(fresh[i], self.c.checked(v)), {**bound.kinds, fresh[i]: measured(v.kind, v.unit)})
        final = tuple(a if isinstance(a, ir.Var) else ir.Var(n) for a, n in zip(args, fresh, strict=True))
        found = self.found(ir.Claim(s.claim.predicate, final), bound)
        self.stage(self.staged.removes, s.claim.predicate, found.df.select(PID, *(F.col(f"`{a.name}`").alias(n) for a, n in zip(final, have, strict=True))))
        return b

    def on_for(self, s: ir.For, b: Bindings) -> Bindings:
        outer, (inner, source) = b, self.c.value(s.source, b)
        # Passes are numbered: equal elements are passes of their own.
        df = inner.df.select("*", F.posexplode(self.c.checked(source)).alias("__pass", s.name))
        kind = "Timestamp" if isinstance(s.source, ir.Builtin) and s.source.name == "periods" else kind_of_type(df.schema[s.name].dataType)
        self.nested(s.body, self.inside(Bindings(df, {**inner.kinds, s.name: kind}), F.col("__pass")), looping=True)
        return outer

    def on_forclaim(self, s: ir.ForClaim, b: Bindings) -> Bindings:
        found = self.found(s.claim, b)
        order = [F.col(f"`{n}`") for n in found.kinds if n not in b.kinds] or [F.lit(0)]
        number = F.row_number().over(Window.partitionBy(PID, PATH).orderBy(*order))
        self.nested(s.body, self.inside(Bindings(found.df.withColumn("__pass", number), found.kinds), F.col("__pass")), looping=True)
        return b

    def on_choose(self, s: ir.Choose, b: Bindings) -> Bindings:
        # The branch taken may read what the test bound nowhere, so each side keeps only its rows.
        here = self.here
        self.nested(s.then, self.inside(self.c.match(ir.Exists(s.test), b)))
        self.here = here
        if s.other:
            self.nested(s.other, self.inside(self.c.match(ir.Not(s.test), b)))
        return b


def step(here: int, s, before: Bindings, after: Bindings) -> DataFrame:
    """A row for each proposal and pass that came to a statement: how many bindings came and went on."""
    what = next((x for x in (getattr(s, n, None) for n in ("name", "predicate", "intent")) if x), None) or (s.claim.predicate if isinstance(s, ir.Retract | ir.ForClaim) else None)
    counted = lambda b, n: b.df.groupBy(PID, PATH).agg(F.count("*").alias(n))
    rows = counted(before, "came").join(counted(after, "went_on"), [PID, PATH], "left")
    at = F.concat(PATH, F.array(F.lit(here).cast("long"))).alias("at")
    return rows.select(PID, at, F.lit(type(s).__name__.lower()).alias("statement"), F.lit(what).alias("what"), "came", F.coalesce("went_on", F.lit(0)).cast("long").alias("went_on"))


def trace(c: Compiler, name: str, proposals: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """What each statement made of each proposal, up to the first that refuses it, without committing.

    pid, at (the statement's place: its number, within a branch or loop after that one's number and
    the pass), statement, what (its name, or the predicate or intent it is about), came and went_on
    (bindings before and after). Rules are not statements.
    """
    proposals = written(proposals, "asked")  # read by each statement: the same rows, lists in the same order
    body = Body(c, c.programme.transformations[name], traced=True)
    staged = body.run(proposals, kinds)
    none = c.spark.createDataFrame([], f"{PID} long, at array<long>, kind string, rule string")
    first = union([none, *staged.refusals]).groupBy(F.col(PID).alias("__pid")).agg(F.min("at").alias("__stop"))
    entries = union(body.steps) if body.steps else none.select(PID, "at", F.col("kind").alias("statement"), F.col("rule").alias("what"), F.lit(0).cast("long").alias("came"), F.lit(0).cast("long").alias("went_on"))
    return entries.join(first, F.col(PID) == F.col("__pid"), "left").where(F.col("__stop").isNull() | (F.col("at") <= F.col("__stop"))).drop("__pid", "__stop")


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def stage(c: Compiler, name: str, proposals: DataFrame, kinds: dict[str, str], single: bool = False) -> tuple[DataFrame, dict[str, tuple[DataFrame, DataFrame]], dict[str, DataFrame]]:
    """Refusals by gates; of the rest by predicate the claims to add and to remove; intents.

    ``single``: whether each proposal is known to be one row.
    """
    staged = Body(c, c.programme.transformations[name], single=single).run(proposals, kinds)
    none = c.spark.createDataFrame([], f"{PID} long, at array<long>, kind string, rule string")
    first = F.min_by(F.struct("kind", "rule"), "at").alias("why")
    refused = union([none, *staged.refusals])
    # What is staged is read many times below: written once, it is also cheap to recover.
    gated = written(refused.drop("at") if staged.once else refused.groupBy(PID).agg(first).select(PID, "why.kind", "why.rule"), "gated")
    changes = {}
    for p in sorted({*staged.adds, *staged.removes}):
        empty = c.claims[p].limit(0).select(F.lit(0).cast("long").alias(PID), *c.claims[p].columns)
        both = []
        for of in (staged.adds, staged.removes):
            frames = of.get(p, [])
            rows = union([empty, *(staged.accepted(f, gated) for f in frames)])
            # Nothing to join with: cheaper to read again from what is bound.
            both.append(rows if all(staged.passed[id(f)] == staged.gates for f in frames) else written(rows, p))
        changes[p] = tuple(both)
    return gated, changes, {i: union([staged.accepted(f, gated) for f in frames]) for i, frames in staged.intents.items()}


def decide(c: Compiler, name: str, proposals: DataFrame, kinds: dict[str, str]) -> Outcome:
    """Judge all proposals of one transformation, as if one after another by ``pid``."""
    require_valid(c.programme)
    removing = {s.claim.predicate for s in ir.walk(c.programme.transformations[name].body) if isinstance(s, ir.Retract)}
    # Read by each statement: the same rows each time, with lists in the same order.
    outcomes, todo = [], written(proposals, "asked")
    single = todo.groupBy(PID).agg(F.count("*").alias("n")).where(f"n > 1 OR {PID} IS NULL").isEmpty()
    while True:
        gated, changes, intents = stage(c, name, todo, kinds, single)
        first = first_dependent(c, name, todo, changes)
        if first is not None:
            now = F.col(PID) < first
            gated, intents = gated.where(now), {i: f.where(now) for i, f in intents.items()}
            changes = {p: tuple(f.where(now) for f in of) for p, of in changes.items()}
        outcomes.append(out := judge(c, gated, changes, intents, removing))
        if first is None:
            break
        state = {p: written(df, "state") if p in out.delta else df for p, df in out.after.items()}
        c, todo = with_state(c, state), todo.where(F.col(PID) >= first)
    join = lambda frames: {p: union([f[p] for f in frames if p in f]) for p in sorted(set().union(*frames))}
    return Outcome(union([o.refused for o in outcomes]), join([o.delta for o in outcomes]), join([o.intents for o in outcomes]), outcomes[-1].after)


def text_of(column: Column, kind: str) -> Column:
    """The same text for equal values, whatever the scale of a decimal's type."""
    return F.coalesce((column.cast("decimal(38,10)") if kind == "Decimal" else column).cast("string"), F.lit("null"))


def first_dependent(c: Compiler, name: str, proposals: DataFrame, changes: dict[str, tuple[DataFrame, DataFrame]]) -> int | None:
    """The least ``pid`` whose answer may depend on what an earlier proposal does."""
    writes = {p: union(list(of)) for p, of in changes.items()}
    fields = {p: list(zip(c.claims[p].columns, c.kinds_of(p, c.claims[p]), strict=True)) for p in writes}
    key = lambda tag, values: F.to_json(F.array(F.lit(tag), *values))
    made: list[tuple[DataFrame, str, list[tuple[Column, str]], bool]] = []

    def add(rows: DataFrame, tag: str, values: list[tuple[Column, str]], wrote: bool) -> None:
        made.append((rows, tag, values, wrote))

    # What is written, by tag: predicate, columns and, as text, guards.
    told_of: dict[str, dict[tuple, list]] = {f"claim {p}": {(p, tuple(n for n, _ in fields[p]), ""): []} for p in writes}
    for rule in c.programme.invariants:
        told = rules.impact(c.programme, rule)
        mine = [o for o in told.occurrences if o.predicate in writes]
        shared = sorted(set.intersection(*(set(o.names.values()) for o in told.occurrences))) if told.occurrences and not told.widened else []
        for o in mine:
            at = {n: i for i, n in o.names.items()}
            guards = [F.col(f"`{fields[o.predicate][i][0]}`") == literal(g.kind, g.value) for i, g in o.guards.items() if g.kind in ("Subject", "Bool", "Decimal")]
            columns = tuple(fields[o.predicate][at[n]][0] for n in shared)
            told_of.setdefault(f"rule {rule.name}", {})[o.predicate, columns, repr(sorted(o.guards.items(), key=str)) if guards else ""] = guards
    needed = dict(told_of)
    for tag, mine in told_of.items():
        # Proposals that share this key share another one of fewer columns too.
        if len(mine) == 1:
            (p, columns, _), *_ = mine
            if any(other != tag and (p, fewer, "") in needed[other] and set(fewer) <= set(columns) for other in needed for q, fewer, _ in needed[other] if q == p):
                del needed[tag]
    for tag, mine in needed.items():
        for (p, columns, _), guards in mine.items():
            kinds = dict(fields[p])
            add(writes[p].where(reduce(Column.__and__, guards, F.lit(True))), tag, [(F.col(f"`{n}`"), kinds[n]) for n in columns], True)
    t = c.programme.transformations[name]
    given = {p for p, _ in t.params} & set(proposals.columns)
    for i, node in enumerate(ir.walk(t.body)):
        if isinstance(node, ir.Claim) and node.predicate in writes:
            known = [j for j, a in enumerate(node.args) if isinstance(a, ir.Lit) or isinstance(a, ir.Var) and a.name in given]
            of = [fields[node.predicate][j] for j in known]
            asked = [literal(a.kind, a.value) if isinstance(a, ir.Lit) else F.col(f"`{a.name}`") for a in (node.args[j] for j in known)]
            add(proposals, f"read {i}", [(x, k) for x, (_, k) in zip(asked, of, strict=True)], False)
            add(writes[node.predicate], f"read {i}", [(F.col(f"`{n}`"), k) for n, k in of], True)
        elif isinstance(node, ir.Call | ir.Figure) and (read := read_by(c.programme, node.name, set()) & set(writes)):
            add(proposals, f"call {node.name}", [], False)
            for p in read:
                add(writes[p], f"call {node.name}", [], True)
    if not made:
        return None
    # Whole numbers needn't become wide decimals to have one hash, if they are whole wherever they are compared.
    whole: dict[tuple[str, int], bool] = {}
    for rows, tag, values, _ in made:
        for i, (x, _) in enumerate(values):
            whole[tag, i] = whole.get((tag, i), True) and rows.select(x).schema[0].dataType.typeName() in ("byte", "short", "integer", "long")
    plain = lambda tag, i, kind: "string" if kind != "Decimal" else "long" if whole[tag, i] else "decimal(38,10)"
    short = lambda tag, values: F.xxhash64(F.lit(tag), *(x.cast(plain(tag, i, k)) for i, (x, k) in enumerate(values))).alias("short")
    # Few proposals share a key as a rule: first by hashes, then exactly for the hashes that several have.
    hashed = union([rows.select(short(tag, values), PID, F.when(F.lit(wrote), F.col(PID)).alias("writer")) for rows, tag, values, wrote in made])
    met = written(hashed.groupBy("short").agg(F.min("writer").alias("writer"), F.max(PID).alias("last")).where("last > writer").select("short"), "met")
    if met.isEmpty():
        return None
    exact = union([rows.select(short(tag, values), key(tag, [text_of(x, k) for x, k in values]).alias("key"), PID, F.lit(wrote).alias("wrote")) for rows, tag, values, wrote in made])
    rows = written(exact.join(met.hint("merge"), "short", "left_semi").groupBy("key", PID).agg(F.max("wrote").alias("wrote")), "shared")
    # A key with one proposal only binds nobody; of the others, the second in order matters.
    earliest = rows.groupBy("key").agg(F.min(F.when(F.col("wrote"), F.col(PID))).alias("__first"), F.count("*").alias("n")).where("n > 1").select("key", "__first")
    return rows.join(earliest, "key").where(F.col(PID) > F.col("__first")).agg(F.min(PID)).first()[0]


def read_by(programme: ir.Programme, name: str, seen: set[str]) -> set[str]:
    """Predicates that a definition reads, itself or through others."""
    if name in seen:
        return set()
    seen.add(name)
    out: set[str] = set()
    for node in ir.walk(programme.defines[name].body):
        if isinstance(node, ir.Claim):
            out.add(node.predicate)
        elif isinstance(node, ir.Call | ir.Figure):
            out |= read_by(programme, node.name, seen)
    return out


def judge(c: Compiler, gated: DataFrame, changes: dict[str, tuple[DataFrame, DataFrame]], intents: dict[str, DataFrame], removing: set[str]) -> Outcome:
    """Check the rules for proposals of which none depends on another."""
    none = c.spark.createDataFrame([], f"{PID} long, place int")
    ruled = {o.predicate for rule in c.programme.invariants for o in rules.impact(c.programme, rule).occurrences}
    delta: dict[str, DataFrame] = {}
    plain: dict[str, DataFrame] = {}
    after = dict(c.claims)
    for p, (adds, removes) in changes.items():
        pre = c.claims[p]
        columns = pre.columns
        delta[p] = effective(pre, adds, removes)
        if p in ruled:  # read by each rule
            delta[p] = written(delta[p], "delta")
        plain[p] = delta[p].drop(PID).distinct()
        after[p] = candidate(pre, adds.select(*columns), removes.select(*columns))
    checker = Compiler(c.spark, c.programme, after, c.claims, constants=c.constants)
    breaches = [none]
    for place, rule in enumerate(c.programme.invariants):
        if (one := rules.unique_keys(c.programme, rule)) and one[0] in delta:
            p, keys = one[0], [c.claims[one[0]].columns[i] for i in one[1]]
            # Claims added that the delta hasn't are in the state before or hold a null.
            void = reduce(Column.__or__, (F.col(f"`{n}`").isNull() for n in c.claims[p].columns))
            others = kept(c.claims[p], changes[p][1]).unionByName(changes[p][0].drop(PID).where(void))
            breaches.append(clashing(keys, others, delta[p]).select(PID, F.lit(place).alias("place")))
            continue
        if (alone := rules.local(c.programme, rule, c.constants)) and alone[0].predicate in delta:
            breaches.append(breaking(c, *alone, delta[alone[0].predicate]).select(PID, F.lit(place).alias("place")))
            continue
        found = rules.checked(checker, rule, {p: d.drop("op") for p, d in plain.items()})
        if found is None:
            continue
        told = rules.impact(c.programme, rule)
        owners = charged(c, rule, told, found, delta)
        breaches.append(owners.select(PID, F.lit(place).alias("place")))
    named = F.array(*(F.lit(rule.name) for rule in c.programme.invariants)).cast("array<string>")
    broken = union(breaches).groupBy(PID).agg(F.min("place").alias("place"))
    broken = written(broken.select(PID, F.lit("invariant").alias("kind"), F.get(named, F.col("place")).alias("rule")), "broken")
    # What gates refuse is staged nowhere.
    fine = {p: without(d, broken) for p, d in delta.items()}
    final = dict(c.claims)
    for p, d in fine.items():
        columns = c.claims[p].columns
        gone = d.where("op = 'del'") if p in removing else c.claims[p].limit(0)
        # The delta's claims are distinct, and none of them stands.
        final[p] = kept(c.claims[p], gone).distinct().unionByName(d.where("op = 'ins'").select(*columns))
    return Outcome(gated.unionByName(broken), fine, {i: without(f, broken) for i, f in intents.items()}, final)


def effective(pre: DataFrame, adds: DataFrame, removes: DataFrame) -> DataFrame:
    """What changes and whose it is, by one shuffle: a claim that stands is not added, one asserted too not removed.

    None of the proposals depends on another, so no two of them have the same claim.
    """
    columns = [F.col(f"`{n}`") for n in pre.columns]
    full = reduce(Column.__and__, (c.isNotNull() for c in columns))
    part = lambda df, pid, what: df.where(full).select(*columns, pid.alias(PID), F.lit(what).alias("__what"))
    rows = union([part(adds, F.col(PID), 0), part(pre, F.lit(None).cast(adds.schema[PID].dataType), 1), part(removes, F.col(PID), 2)])
    told = [F.max(F.col("__what") == i).alias(f"__{i}") for i in range(3)]
    met = rows.groupBy(*columns).agg(F.min(PID).alias(PID), *told).where("__0 AND NOT __1 OR __2 AND __1 AND NOT __0")
    return met.select(PID, *columns, F.when(F.col("__0"), "ins").otherwise("del").alias("op"))


def breaking(c: Compiler, claim: ir.Claim, asked, delta: DataFrame) -> DataFrame:
    """Proposals that add a claim which by itself breaks a rule."""
    columns = delta.columns[1:-1]
    kinds = c.kinds_of(claim.predicate, c.claims[claim.predicate])
    added = delta.where("op = 'ins'")
    for n, a in zip(columns, claim.args, strict=True):
        if isinstance(a, ir.Lit):
            added = added.where(F.col(f"`{n}`") == literal(a.kind, a.value))
    names = {a.name: (n, k) for a, n, k in zip(claim.args, columns, kinds, strict=True) if isinstance(a, ir.Var)}
    b = Bindings(added.select(F.col(PID).alias("__owner"), *(F.col(f"`{n}`").alias(v) for v, (n, _) in names.items())), {v: k for v, (_, k) in names.items()})
    return rules.broken(c, b, asked).df.select(F.col("__owner").alias(PID))


def kept(pre: DataFrame, removes: DataFrame) -> DataFrame:
    return pre.join(removes.select(*pre.columns).hint("merge"), pre.columns, "left_anti")


def clashing(keys: list[str], others: DataFrame, delta: DataFrame) -> DataFrame:
    """Proposals that add a claim under keys that other claims have in the state after, by one shuffle.

    None depends on another, so no two of them touch the same keys.
    """
    names = others.columns
    rest = [F.col(f"`{n}`") for n in names if n not in keys]
    value = [*(F.col(f"`{k}`") for k in keys), *(x.alias(f"__{i}") for i, x in enumerate(rest)), reduce(Column.__or__, (x.isNull() for x in rest)).alias("__void")]
    none = F.lit(None).cast(delta.schema[PID].dataType).alias(PID)
    rows = others.select(*value, none, F.lit(False).alias("__new")).unionByName(delta.where("op = 'ins'").select(*value, PID, F.lit(True).alias("__new")))
    # Column by column: numbers are aggregated by hashing, whole rows would be sorted.
    ends = [f(f"__{i}").alias(f"{n}{i}") for i in range(len(rest)) for f, n in ((F.min, "low"), (F.max, "high"))]
    unlike = " OR ".join(f"low{i} <> high{i}" for i in range(len(rest)))
    met = rows.where(reduce(Column.__and__, (F.col(f"`{k}`").isNotNull() for k in keys))).groupBy(*(f"`{k}`" for k in keys)).agg(*ends, F.max("__void").alias("__void"), F.max(PID).alias("__pid"), F.max("__new").alias("__new"))
    return met.where(f"__new AND ({unlike} OR __void)").select(F.col("__pid").alias(PID))


def charged(c: Compiler, rule: ir.Invariant, told: rules.Impact, found: DataFrame, delta: dict[str, DataFrame]) -> DataFrame:
    """The proposals whose changes touch the broken cases; all that touch the rule, if it has no cases."""
    made = []
    for o in told.occurrences:
        if o.predicate not in delta:
            continue
        d = delta[o.predicate]
        names = {n: d.columns[1 + i] for i, n in o.names.items() if n in found.columns}
        if told.widened or not names:
            made.append(d.select(PID).crossJoin(F.broadcast(found.select(F.lit(1).alias("__any")).limit(1))).select(PID))
        else:
            cases = found.select(*(F.col(f"`{n}`").alias(f"__c{i}") for i, n in enumerate(names))).distinct()
            on = reduce(Column.__and__, (F.col(f"`{f}`") == F.col(f"__c{i}") for i, f in enumerate(names.values())))
            made.append(d.join(cases, on).select(PID))
    return union(made).distinct()


def explain(c: Compiler, name: str, proposals: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """What would become of each proposal, without committing: pid, verdict, kind, rule, and the acts
    that could supply the claim that a refusing gate asks for."""
    out = decide(c, name, proposals, kinds)
    body = c.programme.transformations[name].body
    gates = [s for s in body if isinstance(s, ir.Require | ir.Bind) and isinstance(s.prop, ir.Claim)]
    rows = [(s.name or type(s).__name__.lower(), suppliers(c.programme, s.prop.predicate)) for s in gates]
    told = c.spark.createDataFrame(rows, "rule string, suppliers array<string>")
    judged = proposals.select(PID).join(out.refused.hint("merge"), PID, "left").join(F.broadcast(told), "rule", "left")
    return judged.select(PID, F.when(F.col("kind").isNull(), "admissible").otherwise("rejected").alias("verdict"), "kind", "rule", "suppliers")


@dataclass
class Receipt:
    name: str
    accepted: bool
    kind: str | None = None
    rule: str | None = None


def fold(c: Compiler, acts: list[tuple[str, dict]], kinds: Callable[[str], dict[str, str]], atomic: bool = False, cut: Callable[[DataFrame, str], DataFrame] = lambda df, p: df) -> tuple[list[Receipt], dict[str, DataFrame]]:
    """Acts one after another, each against what the ones before left.

    ``acts``: a transformation's name and a proposal (actor, decided_at and parameters) each. With
    ``atomic`` the first refusal undoes all. ``cut`` may write a state between acts, to cut lineage.
    """
    receipts, state = [], dict(c.claims)
    for i, (name, proposal) in enumerate(acts):
        now = Compiler(c.spark, c.programme, state, constants=c.constants)
        frame = c.spark.createDataFrame([{PID: i, **proposal}])
        out = decide(now, name, frame, kinds(name))
        refused = out.refused.first()
        receipts.append(Receipt(name, refused is None, refused and refused.kind, refused and refused.rule))
        if refused is None:
            state = {p: cut(df, p) if p in out.delta else df for p, df in out.after.items()}
        elif atomic:
            return receipts, dict(c.claims)
    return receipts, state


def with_state(c: Compiler, claims: dict[str, DataFrame]) -> Compiler:
    return Compiler(c.spark, replace(c.programme), claims, c.pre, c.flag_errors, c.constants)
