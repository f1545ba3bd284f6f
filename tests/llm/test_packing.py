import sys
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from claimspark.llm import packing as M

TOKENIZER = Tokenizer.from_file(public_tokenizers.path(M.VOCABULARY))
ENCODER = M.Encoder()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aAéÉßſİΣσς'st́ \t\n\x0b\x1c\x1f\x85\xa0 　<|>0٣½ⅷ漢字!$_-ﬁ", max_size=40) | st.text(max_size=40))
def test_word_by_word_gives_the_ids_of_the_whole_text(text):
    assert np.frombuffer(b"".join(ENCODER.encode_all([text])), "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_special_strings_are_met_as_the_tokenizer_meets_them():
    for text in ("a<|endoftext|>b <|startoftext|> c", "<|endoftext|>", "< |endoftext|>"):
        assert np.frombuffer(b"".join(ENCODER.encode_all([text])), "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_words_of_the_tables_give_the_ids_of_the_whole_text():
    import pyarrow.parquet as pq

    for name in ("documents", "pages"):
        column = pq.read_table(f"/root/testdata/sf0.001/{name}.parquet").column("text" if name == "documents" else "html").to_pylist()
        for text, ids in zip(column, ENCODER.encode_all(column), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_each_plain_character_alone_and_in_a_word():
    plain = [chr(i) for i in range(0x250)]
    for text in [*plain, *(f"a{c}b" for c in plain), *(f"{c}{c}1" for c in plain), *(f"'{c}s" for c in plain)]:
        assert np.frombuffer(b"".join(ENCODER.encode_all([text])), "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids, ascii(text)


def plain_best_fit(lengths, limit):
    left, out = [], [None] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [c for c in left if c >= lengths[i]]
        if fits:
            left[left.index(min(fits))] -= lengths[i]
        else:
            left.append(limit - lengths[i])
        out[i] = (min(fits) if fits else limit) - lengths[i]
    return sorted(left), out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_best_fit_decreasing_against_a_plain_search(lengths):
    sequences, offsets, left = M.best_fit(np.array(lengths, np.int64), 20)
    plain_left, after = plain_best_fit(lengths, 20)
    assert sorted(left.tolist()) == plain_left
    assert [20 - o - n for o, n in zip(offsets.tolist(), lengths, strict=True)] == after


def check(rows, texts, limit, tokenizer=TOKENIZER):
    """Exact round trip: every document's pieces are its ids, every sequence is gapless from 0."""
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= limit
    for doc_id, text in texts.items():
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        found = sorted(by_doc[doc_id], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in found] == [(i, s, len(ids[s : s + limit]), zlib.crc32(ids[s : s + limit].tobytes())) for i, s in enumerate(range(0, len(ids), limit))]
    return len(by_sequence)


def test_query_round_trip(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = M.op6_packing(spark, folder).collect()
    used = check(rows, texts, 4096)
    assert used <= -(-sum(r.length for r in rows) // 4096) + 1


@pytest.mark.parametrize("group", [1 << 16, 10])
def test_edges_and_several_groups(spark, monkeypatch, group):
    monkeypatch.setattr(M, "GROUP", group)
    texts = {1: None, 2: "", 3: "word " * 100, 4: "a b c", **{10 + i: "x " * (i % 15) for i in range(60)}}
    docs = spark.createDataFrame([(k, v) for k, v in texts.items()], "doc_id long, text string").selectExpr("*", "1 as uid", "2 as length", "3 as piece")
    rows = M.pack(docs, limit=16, keep_ids=True).collect()
    used = check(rows, texts, 16)
    assert all(len(r.ids) == r.length for r in rows)
    assert used <= -(-sum(r.length for r in rows) // 16) + (2 if group > 10 else 4)
    assert M.pack(docs.limit(0)).count() == 0


def test_null_ids_repeated_rows_and_a_very_long_text(spark):
    long = "some words and more " * 30_000
    docs = spark.createDataFrame([(None, "a b c"), (None, None), (1, "twice"), (1, "twice"), (2, long)], "doc_id long, text string")
    rows = M.pack(docs).collect()
    check(rows, {2: long}, 4096)
    ids = lambda text: len(TOKENIZER.encode(text, add_special_tokens=False).ids) + 1
    assert sorted(r.length for r in rows if r.doc_id is None) == sorted([ids("a b c"), 1])
    assert [(r.piece, r.start, r.length) for r in rows if r.doc_id == 1] == [(0, 0, ids("twice"))] * 2


def test_what_an_encoder_keeps_is_bounded_whatever_it_has_read(monkeypatch):
    encoder = M.Encoder()
    kept = lambda: [x for cache in (encoder.words, encoder.parts) for x in (*cache, *cache.values())]
    # Whole texts that count as one word are not kept, and still have their ids.
    odd = [f"a\x1c{i} " + "some words " * 2000 for i in range(200)] + ["x" * 50_000 + str(i) for i in range(20)]
    for text, ids in zip(odd, encoder.encode_all(odd), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids
    assert sum(map(len, kept())) < 100_000
    # Nor are more words than a worker has room for, and those in use are known on.
    monkeypatch.setattr(M, "CACHED", 4500)
    for at in range(0, 10 * M.CACHED, 1000):
        text = "often used, " + " ".join(f"w{i}x" for i in range(at, at + 1000))
        assert np.frombuffer(b"".join(encoder.encode_all([text])), "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids
    assert max(len(encoder.words), len(encoder.parts)) <= M.CACHED + 2100 and {"often", "used,"} <= encoder.words.keys()


def test_full_caches_leave_room_for_two_workers_in_an_executor():
    encoder = M.Encoder()
    letters = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(5))
    most = 0
    for at in range(0, 750_000, 30_000):
        b"".join(encoder.encode_all([" ".join(letters(i) + "." * (i % 3) for i in range(at, at + 30_000))]))
        most = max(most, sum(sys.getsizeof(x) for cache in (encoder.words, encoder.parts) for x in (cache, *cache, *cache.values())))
    assert most < 125_000_000
