import random
import re

import numpy as np
import pytest
import xxhash

from claimspark.llm import simhash as M


def plain_print(text):
    """Bit by bit from the contract."""
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """doc -> smallest doc reachable, by trying all pairs."""
    parent = {d: d for d, _ in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, a in prints:
        for e, b in prints:
            if d < e and (a ^ b).bit_count() <= 3:
                x, y = sorted((find(d), find(e)))
                parent[y] = x
    return {d: find(d) for d in parent}


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_query_against_all_pairs(spark, folder):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    prints = {d: plain_print(t) for d, t in texts.items()}
    expected = plain_components(list(prints.items()))
    rows = M.op5_simhash(spark, folder).collect()
    assert len(rows) == len(texts)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {d: (f"{prints[d]:016x}", expected[d]) for d in texts}


def planted():
    """Fingerprints in balls of up to three flips, chains of balls, and strangers."""
    rng, out = random.Random(7), []
    for _ in range(40):
        here = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            out.append(here)
            for _ in range(rng.randint(0, 4)):
                here ^= 1 << rng.randrange(64)
    return list(dict.fromkeys(out))


@pytest.mark.parametrize("crowd", [16_384, 8, 3])
def test_links_connect_what_all_pairs_connect(spark, monkeypatch, crowd):
    monkeypatch.setattr(M, "CROWD", crowd)
    prints = planted() + ([(1 << 40) - 1 ^ 1 << i for i in range(40)] if crowd < 9 else [])
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(x,) for x in signed], "fingerprint long")
    place = {x: i for i, x in enumerate(signed)}
    roots = {r.node: r.root for r in M.components(M.links(nodes)).collect()}
    expected = plain_components(list(enumerate(prints)))
    groups, wanted = {}, {}
    for x in signed:
        groups.setdefault(roots.get(x, x), set()).add(place[x])
        wanted.setdefault(expected[place[x]], set()).add(place[x])
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_edges_and_what_stays(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(5, text), (3, text.upper()), (3, text), (9, None), (8, " \t"), (None, "alone"), (None, "alone"), (2, "other words here and there today"), (2, "quite another thing, as it were, again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as fingerprint", "2 as _rows_", "3 as root")
    found = [(r.doc_id, r.component_id) for r in M.near_components(docs).collect()]
    assert sorted(found, key=str) == sorted([(5, 3), (3, 3), (3, 3), (9, 8), (8, 8), (None, None), (None, None), (2, 2), (2, 2)], key=str)
    assert M.near_components(docs.limit(0)).count() == 0
    stay = M.drop_near_copies(docs)
    assert stay.columns == docs.columns
    kept = sorted(((r.doc_id, r.text) for r in stay.collect()), key=str)
    assert [k for k, _ in kept].count(3) == 1 and [k for k, _ in kept].count(8) == 1 and [k for k, _ in kept].count(None) == 1
    assert not any(k in (5, 9) for k, _ in kept)


@pytest.mark.parametrize("sent", [200_000, 0])
def test_each_component_keeps_one_row_though_ids_are_null_or_shared(spark, monkeypatch, sent):
    monkeypatch.setattr(M, "MAX_SENT", sent)
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(20)) for x in "abcd")
    rows = [(None, a), (None, b), (None, b), (3, c), (7, c), (7, d), (2, a + " more of a"), (2, b + " and now for something else entirely, at length, in other words"), (None, c)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as fingerprint", "2 as id", "3 as root")
    component = plain_components([(i, plain_print(t)) for i, (_, t) in enumerate(rows)])
    groups = {}
    for i, root in component.items():
        groups.setdefault(root, []).append(rows[i])
    least = {frozenset(g): min((r for r in g), key=lambda r: (r[0] is None, r[0] or 0))[0] for g in groups.values()}
    kept = [(r.doc_id, r.text) for r in M.drop_near_copies(docs).collect()]
    assert len(kept) == len(groups) >= 4
    for group, doc_id in least.items():
        assert [k for k, t in kept if (k, t) in group] == [doc_id]
    assert {t for _, t in kept} >= {a, b, c, d}


def test_very_long_texts_and_one_word():
    for text in (" ".join(f"w{i * i % 7919}" for i in range(70_000)), "A" * 3_000_000, "\x0b \t"):
        assert M.fingerprint(text.encode()) == plain_print(text)
