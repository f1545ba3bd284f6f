"""Personal data by bootstrapped contextual extraction.

1. *Seeds.* Patterns find the base entities: e-mail and IP addresses, card and phone numbers. Other
   pieces of a text that are shaped like these are instances that a context may confirm: addresses
   (local@host, or spelled "local at host dot com") may be e-mail addresses; numbers of at least
   ``FEWEST_DIGITS`` digits, whose groups may be joined by single blanks or punctuation, and words
   with as many digits may be of the other kinds. They have any length and are taken whole.
2. *Graph.* The lexical contexts of an entity or instance are the last word and the last two words
   before it, with only blanks and punctuation between; a word has no digit, and what belongs to
   another entity or instance isn't one. Spark joins contexts and instances.
3. *Rounds.* A context is a pattern for a kind if it precedes ``MIN_SEEDS`` different accepted
   instances of it; seeds are accepted. Its confidence is the sum of their scores over its
   occurrences in all texts. An instance's score is the chance that at least one of its patterns is
   right. Where both a pattern and the score reach ``CONFIDENCE``, the instance is accepted, and its
   other contexts may become patterns in the next round. Rounds end when none is accepted any more.
4. *Discovery.* Accepted instances behind a pattern that reaches ``CONFIDENCE`` become spans of its
   kind. The base spans always stay.

The corpus statistics cover all documents. The contexts that the second pass counts are sent to
the executors only if they are at most ``MAX_SENT``; beyond that the words of all texts are
joined with them by a shuffle, which counts the same.

Defined cases: a null or empty text has no span; a repeated row is found again; a null id is
carried as null; an empty table gives an empty result; other columns are not looked at. An instance
that is confirmed for several kinds takes that of the best score, then confidence, then the first
kind. Time is linear in the length of a text.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import arrow_types, discard, materialise, table, texts

KINDS = ("email", "ip", "card", "phone")
MIN_SEEDS, CONFIDENCE, MAX_SENT, FEWEST_DIGITS = 3, 0.5, 200_000, 4

#: An address from its @ on; what stands before is taken backwards, which keeps time linear.
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")
TOKEN = re.compile(r"[^\W_]+")
DIGITS = re.compile(r"[0-9]+")
#: What an identifier is made of besides letters and digits, and what a spelled address is joined by.
JOINERS, HOST_CHARS = frozenset("-._@+()/:"), frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789.-")
AT = re.compile(r"@| at | ?[(\[]at[)\]] ?")
SPELLED_HOST = re.compile(r"[A-Za-z0-9-]++(?:(?: dot | ?[(\[]dot[)\]] ?|\.)[A-Za-z0-9-]++)+")
#: Kinds that an instance of each shape may be of.
NUMBER, ADDRESS = -1, -2
MAY_BE = {NUMBER: (1, 2, 3), ADDRESS: (0,)}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(number of the kind, start, end), leftmost and non-overlapping within each kind."""
    out, last = [], 0
    if "@" in text:
        for m in DOMAIN.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in LOCAL_CHARS:
                start -= 1
            if start < m.start():
                out.append((0, start, last := m.end()))
    for m in IP.finditer(text):
        if all(len(x := part.lstrip("0")) <= 3 and int(x or 0) <= 255 for part in m[0].split(".")):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((3, *m.span()))
    return out


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Pieces like local@host, and spelled ones."""
    last = 0
    for m in AT.finditer(text):
        start, end = m.span()
        if m[0] == "@":
            while end < len(text) and text[end] in HOST_CHARS:
                end += 1
            while end > m.end() and text[end - 1] in ".-":
                end -= 1
            if end == m.end():
                continue
        elif not (host := SPELLED_HOST.match(text, end)):
            continue
        else:
            end = host.end()
        while start > last and text[start - 1] in LOCAL_CHARS:
            start -= 1
        while start < m.start() and text[start] in ".-":
            start += 1
        if start < m.start():
            yield start, end
            last = end


def numbers(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Pieces with digits that touch nothing of ``taken`` (in order); neighbours without letters are one if a blank is between."""
    i = last = 0
    held: tuple[int, int] | None = None  # a piece without letters, to which the next may belong

    def whole(piece: tuple[int, int] | None) -> Iterator[tuple[int, int]]:
        if piece and sum(len(d) for d in DIGITS.findall(text, *piece)) >= FEWEST_DIGITS:
            yield piece

    for m in DIGITS.finditer(text):
        if m.start() < last:
            continue
        start, end = m.span()
        while start > last and (text[start - 1].isalnum() or text[start - 1] in JOINERS):
            start -= 1
        while end < len(text) and (text[end].isalnum() or text[end] in JOINERS):
            end += 1
        last = end
        while end > start and not text[end - 1].isalnum():
            end -= 1
        while start < end and not (text[start].isalnum() or text[start] in "+("):
            start += 1
        while i < len(taken) and taken[i][1] <= start:
            i += 1
        if i < len(taken) and taken[i][0] < end:
            yield from whole(held)
            held = None
        elif any(c.isalpha() for c in text[start:end]):
            yield from whole(held)
            yield from whole((start, end))
            held = None
        elif held and text[held[1] : min(start, held[1] + 3)] in (" ", ") "):
            held = held[0], end
        else:
            yield from whole(held)
            held = start, end
    yield from whole(held)


def things(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and instances (shape, start, end) that touch none of them."""
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    taken = merged(taken)
    found = apart(addresses(text), taken)
    every = merged(sorted(taken + found)) if found else taken
    return base, [(ADDRESS, a, b) for a, b in found] + [(NUMBER, a, b) for a, b in numbers(text, every)]


def apart(spans: Iterator[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of spans in order those that touch nothing of ``taken`` (in order, without overlaps)."""
    out, i = [], 0
    for a, b in spans:
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if i == len(taken) or taken[i][0] >= b:
            out.append((a, b))
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, overlapping ones as one."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def contexts(text: str, at: int, after: int) -> list[str]:
    """The last word between ``after`` and ``at`` and the last two, in lower case."""
    words: list[str] = []
    while len(words) < 2:
        while at > after and not (text[at - 1].isalnum()):
            at -= 1
        end = at
        while at > after and text[at - 1].isalnum():
            at -= 1
        if at == end or any(c.isdigit() for c in text[at:end]):
            break
        words.insert(0, text[at:end].lower())
    return [" ".join(words[-n:]) for n in (1, 2) if len(words) >= n]


def words_outside(text: str, spans: list[tuple[int, int]]) -> Iterator[list[str]]:
    """Words, and tokens with digits, of each stretch of text between ``spans`` (merged), in lower case."""
    at = 0
    for a, b in [*spans, (len(text), len(text))]:
        part = text[at:a]
        yield TOKEN.findall(part.lower()) if part.isascii() else [t.lower() for t in TOKEN.findall(part)]
        at = b


def surface(text: str) -> str:
    """What tells one identifier from another: letters and digits, in lower case, as a digest."""
    return hashlib.blake2b("".join(c for c in text.lower() if c.isalnum()).encode(), digest_size=12).hexdigest()


FOUND = "row long, doc_id long, base array<struct<kind:int,start:long,end:long>>, edges array<struct<context:string,kind:int,instance:string,start:long,end:long>>"


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: its base spans, and an edge for each entity or instance and each of its contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base_column, edge_column = [], []
            for body in texts(batch.column(2)):
                base, instances = things(body)
                base_column.append([{"kind": k, "start": a, "end": b} for k, a, b in base])
                edges, after = [], 0
                for a, b, k in sorted((a, b, k) for k, a, b in base + instances):
                    edges += [{"context": c, "kind": k, "instance": surface(body[a:b]), "start": a, "end": b} for c in contexts(body, a, min(a, after))]
                    after = max(after, b)
                edge_column.append(edges)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(base_column, types[2]), pa.array(edge_column, types[3])], names=["row", "doc_id", "base", "edges"])

    types = arrow_types(docs.sparkSession, FOUND)
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return materialise(numbered.mapInArrow(run, FOUND), "pii-found")


def occurrences(docs: DataFrame, candidates: DataFrame, text: str = "text") -> DataFrame:
    """How often each candidate context occurs in all texts: context, occurs."""
    spark = docs.sparkSession
    few = candidates.limit(MAX_SENT + 1).collect()
    known = spark.sparkContext.broadcast(frozenset(r.context for r in few)) if len(few) <= MAX_SENT else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counts(counter: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counter), pa.string()), pa.array(list(counter.values()), pa.int64())], names=["context", "occurs"])

        wanted, total = known.value if known else None, Counter()
        for batch in batches:
            for body in texts(batch.column(0)):
                base, instances = things(body)
                for words in words_outside(body, merged(sorted((a, b) for _, a, b in base + instances))):
                    pairs = map(" ".join, zip(words, words[1:], strict=False))
                    total.update(words if wanted is None else filter(wanted.__contains__, words))
                    total.update(pairs if wanted is None else filter(wanted.__contains__, pairs))
                if len(total) > 300_000:
                    yield counts(total)
                    total.clear()
        yield counts(total)

    counted = docs.select(text).mapInArrow(run, "context string, occurs long")
    if known is None:
        counted = counted.join(candidates.select("context"), "context", "left_semi")
    return counted.groupBy("context").agg(F.sum("occurs").alias("occurs"))


def bootstrap(docs: DataFrame, found: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(context, of, confidence) of the patterns and (instance, of, score) of the accepted instances."""
    edges = found.select(F.explode("edges").alias("e")).select("e.context", "e.kind", "e.instance").groupBy("context", "kind", "instance").agg(F.count("*").alias("times"))
    edges = materialise(edges, "pii-edges")
    # Only a context of so many different instances can ever be a pattern.
    likely = edges.groupBy("context").agg(F.countDistinct("instance").alias("instances")).where(F.col("instances") >= MIN_SEEDS).select("context")
    occurs = materialise(occurrences(docs, materialise(likely, "pii-contexts"), text), "pii-occurs")
    of = F.when(F.col("kind") >= 0, F.array("kind"))
    for shape, kinds in MAY_BE.items():
        of = of.when(F.col("kind") == shape, F.array(*map(F.lit, kinds)))
    graph = edges.join(occurs, "context").withColumn("of", F.explode(of))
    graph = materialise(graph.groupBy("context", "occurs", "of", "instance").agg(F.sum("times").alias("times"), F.max(F.col("kind") >= 0).alias("seed")), "pii-graph")
    accepted = materialise(edges.where("kind >= 0").select("instance", F.col("kind").alias("of"), F.lit(1.0).alias("score")).distinct(), "pii-accepted")
    count = accepted.count()
    while True:
        told = graph.join(accepted, ["instance", "of"]).groupBy("context", "of").agg(F.countDistinct("instance").alias("instances"), (F.sum(F.col("times") * F.col("score")) / F.first("occurs")).alias("confidence"))
        patterns = materialise(told.where(F.col("instances") >= MIN_SEEDS).select("context", "of", "confidence"), "pii-patterns")
        hit = graph.join(patterns, ["context", "of"]).groupBy("instance", "of").agg(
            (1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))).alias("told"), F.max("confidence").alias("best")
        )
        hit = hit.where(F.least("told", "best") >= CONFIDENCE).select("instance", "of", "told")
        # What was accepted stays; a seed's score is 1.
        now = accepted.join(hit, ["instance", "of"], "full").select("instance", "of", F.greatest("score", "told").alias("score"))
        now, before = materialise(now, "pii-accepted"), accepted
        discard(docs.sparkSession, before)
        accepted, more = now, now.count()
        if more == count:
            return patterns.where(F.col("confidence") >= CONFIDENCE), accepted
        count = more
        discard(docs.sparkSession, patterns)


def discovered(found: DataFrame, patterns: DataFrame, accepted: DataFrame) -> DataFrame:
    """row and its array of new spans (kind, start, end)."""
    open_edges = found.select("row", F.explode("edges").alias("e")).where("e.kind < 0").select("row", "e.context", "e.kind", "e.instance", "e.start", "e.end")
    may_be = F.lit(False)
    for shape, kinds in MAY_BE.items():
        may_be = may_be | (F.col("kind") == shape) & F.col("of").isin(*kinds)
    hits = open_edges.join(patterns, "context").where(may_be).join(accepted, ["instance", "of"])
    best = hits.groupBy("row", "start", "end").agg(F.max_by("of", F.struct("score", "confidence", -F.col("of"))).alias("kind"))
    return best.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"))


def extract(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's spans: doc_id, base and more, arrays of (number of the kind in KINDS, start, end)."""
    found = find(docs, doc_id, text)
    more = discovered(found, *bootstrap(docs, found, text))
    return found.select("row", "doc_id", "base").join(more, "row", "left").select("doc_id", "base", F.coalesce("more", F.expr("array()").cast("array<struct<kind:int,start:bigint,end:bigint>>")).alias("more"))


def _joined(spans):
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"], s["end"])), ",")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = extract(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return spans.select("doc_id", *counts, F.size("more").cast("long").alias("n_more"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "more")).alias("spans"))
