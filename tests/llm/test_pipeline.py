import os
import re
from collections import Counter

import pytest

import corpus_pipeline
from claimspark.llm import _common, components, exact_dedup, mixing, packing, simhash
from test_mixing import plain_targets
from test_packing import check
from test_simhash import plain_components, plain_print

FOLDER = "/root/testdata/sf0.001"
BLANK = re.compile(r"[\x20\x09-\x0D]+")


def stage(spark, tmp_path, name, docs):
    made = dict(corpus_pipeline.STAGES)[name](spark, docs, FOLDER)
    made.write.parquet(str(tmp_path / name))
    return spark.read.parquet(str(tmp_path / name))


def test_each_stage_against_brute_force(spark, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "simhash_dedup", "mixing", "packing"]
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    text = "CASE doc_id % 50 WHEN 7 THEN NULL WHEN 8 THEN '12 34' ELSE text END AS text"
    docs = documents.selectExpr("doc_id", text, "lang", "source", "n_chars", "'x' AS _id", "1 AS row").unionByName(documents.where("doc_id < 5").selectExpr("*", "'x' AS _id", "1 AS row"))
    docs.write.parquet(str(tmp_path / "documents"))
    docs = spark.read.parquet(str(tmp_path / "documents"))
    columns = docs.columns

    kept = stage(spark, tmp_path, "language_id", docs)
    assert kept.columns == columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted((r.doc_id, r.text) for r in docs.collect() if any(c.isalpha() for c in r.text or ""))

    before, kept = kept.collect(), stage(spark, tmp_path, "exact_dedup", kept)
    best = {}
    for r in sorted(before, key=lambda r: (-len(r.text), r.doc_id)):
        best.setdefault(BLANK.sub("", r.text), (r.doc_id, r.text))
    assert kept.columns == columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted(best.values())

    before, kept = kept.collect(), stage(spark, tmp_path, "simhash_dedup", kept)
    component = plain_components([(r.doc_id, plain_print(r.text)) for r in before])
    assert kept.columns == columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(component.values()))

    before, kept = kept.collect(), stage(spark, tmp_path, "mixing", kept)
    size = Counter()
    for r in before:
        size[r.source] += len(r.text.encode().split())
    taken = Counter()
    whole = {r.doc_id: r.text for r in before}
    for r in kept.collect():
        taken[r.source] += len(r.text.encode().split())
        assert whole[r.doc_id].startswith(r.text)
    assert kept.columns == columns
    assert all(abs(taken[s] - t) <= 0.5 for s, t in plain_targets(size).items())

    made = stage(spark, tmp_path, "packing", kept)
    bodies = kept.collect()
    many = Counter(r.doc_id for r in bodies)
    rows = made.collect()
    # Sequences are gapless whatever is in them; documents taken once can be told by their id.
    check(rows, {r.doc_id: r.text for r in bodies if many[r.doc_id] == 1}, 4096)
    assert sum(r.piece == 0 for r in rows) == len(bodies)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i * i % 7919}" for i in range(70_000))
ODD = [
    (None, "a text without an id, in words of its own", None, None, None),
    (None, "another text that has no id but says other things", "en", "a", 1),
    (1, None, "en", "a", 0),
    (2, "", None, None, 0),
    (3, "12 34 . !", "en", "a", 9),
    (4, LONG, "en", "b", len(LONG)),
    (5, "one row that is there twice over", "en", "a", 3),
    (5, "one row that is there twice over", "en", "a", 3),
    (6, "one  row that is there\ttwice over", "en", None, 3),
    (7, "ein Satz in einer anderen Sprache", "de", "c", 3),
]


def whole_run(spark, folder, rows, labels=()):
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    return corpus_pipeline.run(spark, str(folder)).collect()


@pytest.mark.parametrize("labelled", [True, False])
def test_run_on_nulls_repeated_rows_and_very_long_texts(spark, tmp_path, labelled):
    rows = [r if labelled else (*r[:2], None, *r[3:]) for r in ODD]
    made = whole_run(spark, tmp_path, rows)
    # Without white space 5, 5 and 6 are equal; 6 is longer. Two texts without ids both stay.
    kept = {4, 6, 7}
    assert {r.doc_id for r in made} == {None, *kept}
    words = Counter()
    for doc_id, text, _, source, _ in ODD:
        if doc_id is None or doc_id in kept:
            words[source] += len(text.split())
    goal = plain_targets(words)
    # b holds nearly all words, so the others are taken three times over and b less often than once.
    assert goal["a"] == 3 * words["a"] and goal[None] == 3 * words[None]
    starts = Counter(r.doc_id for r in made if r.piece == 0)
    assert starts[6] == 3 and starts[7] == 3 and starts[None] == 6 and starts[4] == 1
    check(made, {}, 4096)


def test_run_on_an_empty_table_and_what_it_leaves_behind(spark, tmp_path):
    assert whole_run(spark, tmp_path / "none", []) == []
    root = _common.shared_dir(spark)
    before = set(os.listdir(root))
    whole_run(spark, tmp_path / "some", ODD)
    new = {name.rsplit("-", 1)[0] for name in set(os.listdir(root)) - before}
    assert new == {"pipeline-mixing", "pack-pieces", "pack-placed"}


def workers_at_once(plan):
    """How many Python workers a task of a plan needs: Python nodes above each other without an exchange between."""
    most, above = 0, []  # (depth, Python nodes from the last exchange down to this one)
    for line in plan.splitlines():
        name = line.lstrip(" :+-*0123456789()")
        depth = len(line) - len(name)
        while above and above[-1][0] >= depth:
            above.pop()
        count = 0 if re.match("Exchange|BroadcastExchange", name) else (above[-1][1] if above else 0) + bool(re.match(r"\w*(InArrow|InPandas|EvalPython)", name))
        above.append((depth, count))
        most = max(most, count)
    return most


def test_no_task_needs_two_python_workers(spark, tmp_path, monkeypatch):
    """A worker that is started stays, and all that wait take turns: each grows as large as the largest stage makes it."""
    plans = []

    def noted(df, tag, write=_common.materialise):
        plans.append((tag, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, tag)

    for module in (_common, components, exact_dedup, mixing, packing, simhash):
        monkeypatch.setattr(module, "materialise", noted)
    spark.createDataFrame(ODD * 30, DOCS).repartition(20).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(exact_dedup, "ROUNDS", 1)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    spark.conf.set("spark.sql.files.openCostInBytes", "64k")
    try:
        last = corpus_pipeline.run(spark, str(tmp_path))
        plans.append(("pipeline-packing", last._jdf.queryExecution().executedPlan().toString()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {"pipeline-language_id", "dedup-runs", "dedup-stay", "pipeline-exact_dedup", "pipeline-simhash_dedup", "pipeline-mixing", "pack-placed"} <= {tag for tag, _ in plans}
    assert max(plan.count("FlatMapGroupsInArrow") for tag, plan in plans if tag == "dedup-stay") > 1
    assert {tag: n for tag, plan in plans if (n := workers_at_once(plan)) > 1} == {}
