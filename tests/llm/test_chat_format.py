import random
from functools import lru_cache

import pytest

from claimspark.llm import chat_format as M


def plain_cost(turns):
    """Cheapest repair by trying everything: after each prefix, every legal list of roles so far (only its last role matters)."""
    legal = {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}

    @lru_cache(None)
    def best(i, last, inserted):
        out = 0 if i == len(turns) and last == "assistant" else float("inf")
        if inserted < 4:
            out = min([out, *(2 + best(i, r, inserted + 1) for r in legal[last])])
        if i < len(turns):
            role, empty = turns[i]
            known = role in ("system", "user", "assistant")
            for r in legal[last]:
                out = min(out, (0 if r == role else 5 if known else 1) + best(i + 1, r, 0))
            if last is not None and not inserted:
                merge = (0 if empty else 1) if role == last else 1 if empty else 4 if known else 2
                out = min(out, merge + best(i + 1, last, 0))
        return out

    return best(0, None, 0)


def random_turns(rng, n):
    return tuple((rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None]), rng.random() < 0.2) for _ in range(n))


def roles_of(rendered):
    return [line[2:-2] for line in rendered.split("\n") if line.startswith("<|") and line.endswith("|>") and line != "<|end|>"]


def is_legal(roles):
    roles = roles[1:] if roles[:1] == ["system"] else roles
    return len(roles) % 2 == 0 and all(r == ("user", "assistant")[i % 2] for i, r in enumerate(roles)) and roles


def check(rows, turns):
    rows = sorted(rows, key=lambda r: (r.place, r.sub))
    rendered = "".join(r.rendered for r in rows)
    roles = roles_of(rendered)
    assert is_legal(roles) and rendered.endswith("<|end|>\n") and rendered.count("<|end|>\n") == len(roles)
    assert sum(r.cost for r in rows) == plain_cost(tuple(turns))
    return rendered


def test_steps_and_repair_against_trying_everything():
    rng = random.Random(1)
    for n in (1, 1, 1, 2, 2, 3, 4, 6) * 40:
        turns = random_turns(rng, n)
        kinds = [M.kind_of(M.role_code(r), e) for r, e in turns]
        assert sum(x[4] for x in M.render(kinds, ["" if e else "x" for _, e in turns])) == plain_cost(turns)


@pytest.mark.parametrize("rows", [50_000, 7, 1])
def test_conversations_cut_anywhere(spark, monkeypatch, rows):
    monkeypatch.setattr(M, "ROWS", rows)
    rng = random.Random(rows)
    turns = {c: random_turns(rng, rng.choice([1, 2, 3, 5, 40])) for c in range(12)}
    table = [(c, i, r, "" if e else f"t{c}-{i} <|end|>") for c, ts in turns.items() for i, (r, e) in enumerate(ts)]
    rng.shuffle(table)
    chats = spark.createDataFrame(table, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as part", "2 as place", "'x' as blank", "3 as cost")
    got = M.format_chats(chats).collect()
    for c, ts in turns.items():
        rendered = check([r for r in got if r.conv_id == c], ts)
        told = [x for x in rendered.replace("​", "").split() if x.startswith("t")]
        assert told == [f"t{c}-{i}" for i, (_, e) in enumerate(ts) if not e]


def test_edges(spark):
    table = [(1, 0, "HUMAN ", "hi"), (1, 1, "gpt", "yo"), (2, None, "assistant", "b"), (2, 5, "user", "a"), (3, 0, None, None), (None, 1, "user", "x"), (None, 1, "user", "x"), (4, 0, "system", "s" * 100_000)]
    chats = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
    by = {}
    for r in M.format_chats(chats).orderBy("place", "sub").collect():
        by[r.conv_id] = by.get(r.conv_id, "") + r.rendered
    assert by[1] == "<|user|>\nhi<|end|>\n<|assistant|>\nyo<|end|>\n"
    assert by[2] == "<|user|>\na<|end|>\n<|assistant|>\nb<|end|>\n"
    assert by[None] == "<|user|>\nx\n\nx<|end|>\n<|assistant|>\n<|end|>\n"
    assert roles_of(by[4]) == ["system", "user", "assistant"] and is_legal(roles_of(by[3]))
    assert M.format_chats(chats.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    turns = {}
    for r in spark.read.parquet(f"{folder}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append((r.role, not r.text.strip(" \t\n\r\x0b\x0c")))
    got = M.op7_chat_format(spark, folder).collect()
    assert {r.conv_id for r in got} == set(turns)
    for c, ts in turns.items():
        if len(ts) == len({i for i, _ in enumerate(ts)}):
            check([r for r in got if r.conv_id == c], ts)
