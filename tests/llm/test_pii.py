import hashlib
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from claimspark.llm import pii as M

PARTS = ["a.b", "@", "x-y", ".", "..", "mail", "1", "255", "256", "0007", "4111 1111 1111 1111", "4111-1111-1111-1111", "378282246310005", "+1 (743) 555-3824", "+", "(", ") ", "-", " ", "é", "\n", "10.0.0.1", "٣", "%", "a@b.c", "+49 30 1234567"]


def brute(text):
    """The contract's patterns read plainly, failing matches dropped."""
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if max(map(int, m[0].split("."))) <= 255]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c in "0123456789"]
        double = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
        if 16 <= len(digits) <= 19 and sum(double) % 10 == 0:
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return sorted(out)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=16).map("".join))
def test_base_spans_are_those_of_the_plain_patterns(text):
    assert sorted(M.base_spans(text)) == brute(text)


def test_long_runs_take_linear_time():
    for piece in ("a", "1", "1.", "a@", "a.", "+1 ", "(", "1-", "1)", "a at ", "a at b dot ", "@", "-", "1 "):
        base, instances = M.things(piece * 200_000)
        for _, a, b in (base + instances)[:50]:
            M.contexts(piece * 200_000, a, 0)


def shown(text):
    return [text[a:b] for _, a, b in sorted(M.things(text)[1], key=lambda x: x[1:])]


def test_instances_are_whole_whatever_their_length():
    assert shown("my number (555) 123-4567, or 555 123 4567.") == ["(555) 123-4567", "555 123 4567"]
    assert shown("host fe80:0:0:1200::7, room 12") == ["fe80:0:0:1200::7"]
    assert shown("write anna@localhost or anna at example dot com or jane_doe@intranet") == ["anna@localhost", "anna at example dot com", "jane_doe@intranet"]
    assert shown("order AB-1234-X 5678 9012") == ["AB-1234-X", "5678 9012"]
    assert shown("id " + "a1" * 45 + " next") == ["a1" * 45]
    assert shown("call +1 743 555 1000, 10.0.0.1") == [] and shown("12 of 123 at 4") == []


def test_contexts_are_next_to_their_instance():
    text = "word " + " " * 90 + "1234"
    assert M.contexts(text, len(text) - 4, 0) == ["word"]
    assert M.contexts("x" * 90 + " 1234", 91, 0) == ["x" * 90]
    assert M.contexts("Call My: 1234", 9, 0) == ["my", "call my"] and M.contexts("call 7 my 1234", 10, 0) == ["my"]
    assert M.contexts("a@b.com 1234", 8, 7) == []


def plain_spans(docs):
    """Spans beyond the base ones, by plain loops over the whole corpus."""
    occurs, edges = Counter(), []
    for doc, text in enumerate(docs):
        base, instances = M.things(text)
        found = sorted((a, b, k) for k, a, b in base + instances)
        inside = [any(a <= i < b for a, b, _ in found) for i in range(len(text))]
        starts = {}
        for a, b, k in found:
            if not inside[a - 1 : a] or not inside[a - 1]:
                starts.setdefault(a, []).append((k, b))
        # Tokens in order; a thing is a token of its own.
        i, before = 0, []
        while i < len(text):
            for k, b in starts.get(i, []):
                for n in (1, 2):
                    if len(before) >= n and all(before[-n:]):
                        edges.append((" ".join(before[-n:]), k, "".join(c for c in text[i:b].lower() if c.isalnum()), doc, i, b))
            if inside[i]:
                before.append(None)
                i += 1
            elif text[i].isalnum():
                j = i
                while j < len(text) and text[j].isalnum() and not inside[j]:
                    j += 1
                before.append(None if any(c.isdigit() for c in text[i:j]) else text[i:j].lower())
                for n in (1, 2):
                    if len(before) >= n and all(before[-n:]):
                        occurs[" ".join(before[-n:])] += 1
                i = j
            else:
                i += 1
    kinds = lambda k: (k,) if k >= 0 else (1, 2, 3) if k == -1 else (0,)
    accepted = {(name, k): 1.0 for _, k, name, *_ in edges if k >= 0}
    while True:
        weight, different = Counter(), {}
        for context, k, name, *_ in edges:
            for of in kinds(k):
                if (name, of) in accepted:
                    weight[context, of] += accepted[name, of]
                    different.setdefault((context, of), set()).add(name)
        pattern = {key: weight[key] / occurs[key[0]] for key, names in different.items() if len(names) >= 3}
        told = {}
        for context, of, name in {(c, of, name) for c, k, name, *_ in edges for of in kinds(k) if (c, of) in pattern}:
            miss, best = told.get((name, of), (1, 0))
            told[name, of] = miss * max(1e-9, 1 - pattern[context, of]), max(best, pattern[context, of])
        new = {key: 1 - miss for key, (miss, best) in told.items() if 1 - miss >= 0.5 and best >= 0.5}
        size = len(accepted)
        accepted = {key: max(accepted.get(key, 0), new.get(key, 0)) for key in accepted | new}
        if len(accepted) == size:
            break
    out = {}
    for context, k, name, doc, a, b in edges:
        for of in kinds(k) if k < 0 else ():
            if pattern.get((context, of), 0) >= 0.5 and (name, of) in accepted:
                out[doc, a, b] = max(out.get((doc, a, b), (0, 0, -9)), (round(accepted[name, of], 9), round(pattern[context, of], 9), -of))
    return {(doc, a, b): -of for (doc, a, b), (_, _, of) in out.items()}


def more_of(rows):
    return {(r.doc_id, x["start"], x["end"]): x["kind"] for r in rows for x in r.more}


def test_discovery_against_plain_loops_on_the_corpus_with_planted_contexts(spark):
    docs = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for i in range(60):
        docs[i] += f" zork my number +1 743 555 {1000 + i}" * (i < 12) + f" zork my number 0743/555/{2000 + i % 9}" * (12 <= i < 20)
        docs[i] += f" dial ZORK line: 0743 555 {2000 + i % 9}" * (i % 3 == 0) + f" dial zork line 88-{i:04}-x" * (i % 3 == 1) + f" mail zorko u{i}@host" * (i % 2) + f" mail zorko u{i}@a.host" * (i < 40)
    wanted = plain_spans(docs)
    assert {k for k in wanted.values()} == {0, 3}
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    assert more_of(M.extract(frame).collect()) == wanted


def test_what_is_discovered_leads_to_further_contexts(spark):
    rows = [f"call my number +1 743 555 {1000 + i}" for i in range(8)]
    rows += [f"call my number 0743/{i}" for i in (2001, 2002, 2003)] + [f"dial line 0743/{i}" for i in (2001, 2002, 2003)] + ["dial line jane-77123", "other 5551 2222"]
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert more_of(M.extract(frame).collect()) == plain_spans(rows) == {**{(i, 15, 24): 3 for i in (8, 9, 10)}, **{(i, 10, 19): 3 for i in (11, 12, 13)}, (14, 10, 20): 3}


def test_addresses_without_digits_very_long_texts_and_null_ids(spark):
    rows = [(i, f"write to jo{'abcdefgh'[i]}@mail.example now") for i in range(8)]
    rows += [(8, "write to jane_doe@intranet now"), (None, "write to jane_doe@intranet now"), (9, "blah " * 300_000 + "write to jane_doe@intranet")]
    got = {(r.doc_id, x["start"], x["end"], x["kind"]) for r in M.extract(spark.createDataFrame(rows, "doc_id long, text string")).collect() for x in r.more}
    assert got == {(8, 9, 26, 0), (None, 9, 26, 0), (9, 1_500_009, 1_500_026, 0)}


def test_ties_between_kinds_go_to_the_first(spark):
    rows = [(i, f"reach us 10.0.0.{i + 1}") for i in range(4)] + [(4 + i, f"reach us +1 743 555 100{i}") for i in range(4)] + [(9, "reach us 7777-8")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert more_of(M.extract(frame).collect()) == {}  # 4 of 9 for each kind
    frame = frame.where("doc_id <> 9").union(spark.createDataFrame([(20, "reach us 7777-8"), (21, "call 7777-8")], "doc_id long, text string"))
    assert more_of(M.extract(frame.where(F.col("doc_id") % 4 != 3)).collect()) == plain_spans([r[1] for r in rows if r[0] % 4 != 3 and r[0] != 9] + ["reach us 7777-8", "call 7777-8"])


def corpus(spark):
    rows = [(i, f"please call my number +1 743 555 {1000 + i} soon") for i in range(8)]
    rows += [(100, "please call my number 0743/555/9999 soon"), (101, "chapter 20401 begins, order 5551-2222 shipped"), (102, None), (103, ""), (103, "")]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' as spans", "'y' as base", "1 as row")


def test_contexts_of_seeds_find_an_unseen_identifier(spark):
    rows = {r.doc_id: r for r in M.extract(corpus(spark)).collect()}
    assert [tuple(x) for x in rows[100].more] == [(3, 22, 35)]
    assert all(not r.more for k, r in rows.items() if k != 100) and all(len(rows[i].base) == 1 for i in range(8))
    assert M.extract(corpus(spark)).count() == 13


def test_contexts_too_many_to_send_are_joined_and_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(M, "MAX_SENT", 0)
    test_contexts_of_seeds_find_an_unseen_identifier(spark)


def test_empty_table(spark):
    assert M.extract(corpus(spark).limit(0)).count() == 0


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = M.op1_pii(spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute(texts[r.doc_id])
        joined = ",".join(f"{M.KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for k, _, _ in base) for i in range(4)]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))
