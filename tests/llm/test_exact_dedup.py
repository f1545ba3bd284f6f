import hashlib
import re

import duckdb
import pytest

from claimspark.llm import exact_dedup as M


def brute(rows):
    """(doc_id, keep_id, group_size, kept, sha256) of each row, repeated rows in any order."""
    groups = {}
    for n, (doc_id, text) in enumerate(rows):
        bare = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        groups.setdefault(bare, []).append((-len(text or ""), doc_id is None, doc_id or 0, n, doc_id))
    out = []
    for bare, members in groups.items():
        sha = hashlib.sha256(bare.encode()).hexdigest()
        for i, m in enumerate(sorted(members)):
            out.append((m[4], min(members)[4], len(members), i == 0, sha))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=str)


def rows():
    out = [(i, f"text {i % 37}" + " " * (i % 5)) for i in range(400)] + [(i, "one hot text") for i in range(1000, 1300)]
    return out + [(7, None), (8, ""), (9, " \t\n\x0b\x0c\r"), (None, "text 1"), (None, "nobody"), (5000, "a b\x1c"), (5001, "ab\x1c"), (5002, "a\xa0b"), (5003, "x" * 200_000), (5004, "x " * 200_000)]


@pytest.mark.parametrize("partitions", [1, 3, 20, 70])
def test_against_brute_force_with_any_number_of_runs(spark, partitions):
    docs = spark.createDataFrame(rows(), "doc_id long, text string").repartition(partitions).selectExpr("*", "1 as points", "'x' as digest", "2 as uid", "3 as rows")
    assert got(M.exact_dedup(docs)) == brute(rows())
    assert M.exact_dedup(docs.limit(0)).count() == 0


def test_repeated_rows_leave_one(spark):
    many = [(1, "same"), (1, "same"), (1, "same"), (2, "other"), (3, "o t h e r"), (4, None), (4, None)]
    docs = spark.createDataFrame(many, "doc_id long, text string").selectExpr("*", "1 as points", "'x' as digest", "2 as rows", "3 as keep_id")
    found = got(M.exact_dedup(docs))
    assert found == brute(many) and sum(x[3] for x in found) == 3
    kept = M.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, "same"), (3, "o t h e r"), (4, None)]
    assert M.drop_copies(docs.limit(0)).count() == 0


def test_query_against_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    found = M.op4_exact_dedup(spark, folder)
    assert sorted(map(tuple, found.collect())) == sorted(con.sql(M.OP4_SQL).select(*found.columns).fetchall())
