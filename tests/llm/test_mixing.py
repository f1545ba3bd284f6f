import re
import tracemalloc
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from claimspark.llm import mixing as M


@settings(max_examples=300, deadline=None)
@given(st.lists(st.none() | st.text(alphabet=" \t\n\x0b\x1c\x85aé　b", max_size=12), max_size=8))
def test_words_are_counted_as_the_pattern_counts_them(texts):
    plain = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    assert M.count_words(pa.array(texts, pa.string())).tolist() == plain
    assert M.count_words(pa.array(["x y", *texts], pa.string())[1:]).tolist() == plain


def test_counting_words_takes_a_few_times_the_memory_of_the_texts():
    texts = pa.array(["seven letters " * 100_000, "", None, "a b " * 300_000])
    M.count_words(texts[:1])
    tracemalloc.start()
    try:
        assert M.count_words(texts).tolist() == [200_000, 0, 0, 600_000]
        assert tracemalloc.get_traced_memory()[1] < 6 * texts.nbytes
    finally:
        tracemalloc.stop()


def plain_targets(size):
    """Shared by weight again and again until no target is above its cap."""
    order = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, out = float(sum(size.values())), set(size), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total >= 3 * size[s]}
        for s in over or open_:
            out[s] = 3.0 * size[s] if over else left * weight[s] / total
        left -= sum(out[s] for s in over)
        open_ -= over or set(open_)
    return out


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 40, None: 5}, {"z": 7}, {"b": 0, "a": 3}, {"a": 1, "b": 1, "c": 1, "d": 100, "é": 2, None: 1}])
def test_mix_meets_its_targets(spark, sizes):
    rows, n = [], 0
    for source, size in sizes.items():
        while size > 0:
            step = min(size, 1 + n % 7)
            rows.append((n, "w " * step, source))
            n, size = n + 1, size - step
    rows += [(n, None, "b"), (n, "", "b"), (None, "  ", "b"), (0, "", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as row", "2 as weight", "3 as of")
    got = M.mix(docs).collect()
    assert len(got) == len(rows)
    targets, taken, size = plain_targets(sizes), Counter(), Counter()
    for r in got:
        taken[r.source] += r.taken
        size[r.source] += r.size
        assert 0 <= r.taken <= 3 * r.size and r.target == pytest.approx(targets.get(r.source, 0))
    assert all(abs(taken[s] - targets[s]) <= 0.5 for s in sizes)
    mixed = Counter()
    for r in M.apply_mix(docs).collect():
        mixed[r.source] += len(r.text.split())
    assert all(mixed[s] == taken[s] for s in sizes)


def test_good_quality_is_taken_more_often(spark):
    docs = spark.createDataFrame([(i, "w w", "a" if i < 400 else "b") for i in range(800)], "doc_id long, text string, source string")
    quality = spark.createDataFrame([(i, 8.0 if i % 2 else 0.125) for i in range(800)] + [(1, None), (1, -1.0)], "doc_id long, weight double")
    rows = [r for r in M.mix(docs, quality).collect() if r.source == "b"]
    good, bad = (sum(r.taken for r in rows if r.doc_id % 2 == x) for x in (1, 0))
    assert good > 2 * bad


def test_empty_table_and_reruns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert M.mix(docs.limit(0)).count() == 0
    assert sorted(M.mix(docs).drop("row").collect()) == sorted(M.mix(docs.repartition(5)).drop("row").collect())


def test_query_against_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'")
    found = M.op2_mixing(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, found.collect())) == sorted(con.sql(M.OP2_SQL).select(*found.columns).fetchall())
