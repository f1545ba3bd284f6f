import base64
import hashlib
import json
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from claimspark.llm import secret_scan as M

WORDS = ["token", "Token=", "PASSWORD: ", "api_key", "apikey", "secret", "=", ":", " ", '"', "'", "AKIA", "ABCDEF0123", "deadbeef", "0123456789abcdef", "x", "é", "\n", "ſecret", "K", "toKen", "hunter22", "."]


def brute(text):
    """The contract read plainly: every match of each pattern, failing ones dropped."""
    out = []
    pattern = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out += [(0, *m.span()) for m in re.finditer(pattern, text) if len(m[2]) >= 8]
    out += [(1, *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(2, *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda x: (x[1], x[0]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(WORDS), max_size=30).map("".join))
def test_base_spans_are_those_of_the_plain_patterns(text):
    assert sorted(M.base_spans(text), key=lambda x: (x[1], x[0])) == brute(text)


def der(tag, *parts):
    body = b"".join(parts)
    size = bytes([len(body)]) if len(body) < 128 else bytes([0x82]) + len(body).to_bytes(2, "big")
    return bytes([tag]) + size + body


def rsa():
    return der(0x30, der(2, b"\0"), *(der(2, bytes([1 + i] * 40)) for i in range(8)))


def test_structure_confirms_keys_and_tokens():
    key = base64.b64encode(rsa()).decode()
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    token = f"{part({'alg': 'HS256'})}.{part({'sub': '1'})}.c2ln"
    armour = f"-----BEGIN RSA PRIVATE KEY-----\n{key[:64]}\n{key[64:]}\n-----END RSA PRIVATE KEY-----"
    for text, kind in ((key, 4), (rsa().hex(), 4), (token, 3), (armour, 4)):
        assert list(M.confirmed_spans(f"é {text} z")) == [(kind, 2, 2 + len(text))]


def test_what_only_looks_like_a_key_is_left_alone():
    key = base64.b64encode(rsa()).decode()
    bad = rsa()[:1] + bytes([0x82, 1, 1]) + rsa()[4:]
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    for text in (key[:-8], base64.b64encode(bad).decode(), bad.hex(), f"{part({'a': 1})}.{part({})}.x", "M" + "A" * 200, "30" * 100, "eyJ.eyJ.", "-----BEGIN PRIVATE KEY-----\nAAAA\n-----END PRIVATE KEY-----"):
        assert list(M.confirmed_spans(text)) == [], text


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "token = " + "f" * 40, "x"), (3, "token = " + "f" * 40, "x"), (None, "AKIA" + "Z" * 100_000, "x")], "doc_id long, text string, spans string")
    rows = {(r.doc_id, len(r.spans)) for r in M.secret_scan(docs).collect()}
    assert rows == {(1, 0), (2, 0), (3, 2), (None, 1)}
    assert M.secret_scan(docs.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = M.op9_secret_scan(spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute(texts[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for k, _, _ in base) for i in range(3)]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{M.KINDS[k]}:{a}:{b}" for k, a, b in base).encode()).hexdigest()


def test_query_spans_with_planted_secrets(spark, tmp_path):
    """All spans of the query: the plain patterns' and each planted secret's, at its place."""
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    key = base64.b64encode(rsa()).decode()
    secrets = [(3, f"{part({'alg': 'HS256'})}.{part({'sub': '1'})}.c2ln"), (4, key), (4, rsa().hex()), (4, f"-----BEGIN PRIVATE KEY-----\n{key}\n-----END PRIVATE KEY-----")]
    rows, planted = [], {}
    for i, r in enumerate(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()):
        words, text, spans = (r.text or "").split(" "), "", []
        for n, word in enumerate(words):
            if n % 40 == 20 and i % 3:
                kind, secret = secrets[(i + n // 40) % 4]
                spans.append((kind, len(text), len(text) + len(secret)))
                text += secret + " "
            text += word + " "
        rows.append((r.doc_id, text))
        planted[r.doc_id] = (text, spans)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = M.op9_secret_scan(spark, str(tmp_path)).collect()
    assert len(found) == len(rows) and sum(r.n_confirmed for r in found) > 20
    for r in found:
        text, spans = planted[r.doc_id]
        every = sorted(brute(text) + spans, key=lambda x: (x[1], x[0], x[2]))
        assert r.spans == M.joined(every) and r.n_confirmed == len(spans)
