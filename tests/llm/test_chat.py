import itertools
import random

import pytest

from paperloom.llm import chat


def brute(roles):
    """Least cost over all roles, merges and insertions, by plain recursion."""
    given = [chat.ROLES.index(r) + 1 if r in chat.ROLES else 0 for r in roles]

    def rest(state, i, room):
        best = chat.NEVER
        if i == len(given):
            best = 0 if state in (chat.START, chat.ASSISTANT) else chat.NEVER
        else:
            for role in (chat.SYSTEM, chat.USER, chat.ASSISTANT):
                cost = chat._relabel(given[i], role)
                if (state, role) in chat._LEGAL:
                    best = min(best, cost + rest(role, i + 1, 2))
                if state == role:
                    best = min(best, cost + chat.MERGE + rest(role, i + 1, 2))
        if room:
            for role in (chat.USER, chat.ASSISTANT):
                if (state, role) in chat._LEGAL:
                    best = min(best, chat.INSERT + rest(role, i, room - 1))
        return best
    return rest(chat.START, 0, 2)


def cost_of(roles, repaired):
    total, state = 0, chat.START
    for place, role, merged in repaired:
        r = chat.ROLES.index(role) + 1
        if place is None:
            total += chat.INSERT
        else:
            given = roles[place]
            total += chat._relabel(chat.ROLES.index(given) + 1 if given in chat.ROLES else 0, r) + (chat.MERGE if merged else 0)
        assert state == r if merged else (state, r) in chat._LEGAL
        state = r
    assert state in (chat.START, chat.ASSISTANT)
    return total


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_least_cost(n):
    for roles in itertools.product(["system", "user", "assistant", "bot"], repeat=n):
        got = chat.repair(list(roles))
        assert [p for p, _, _ in got if p is not None] == list(range(n))
        assert cost_of(roles, got) == brute(roles)


def test_blocks_give_the_same_cost():
    rng = random.Random(8)
    for _ in range(50):
        roles = [rng.choice(["system", "user", "assistant", None]) for _ in range(rng.randrange(1, 40))]
        given = [chat.ROLES.index(r) + 1 if r in chat.ROLES else 0 for r in roles]
        parts = [given[i:i + 5] for i in range(0, len(given), 5)]
        ways = chat.border_states([chat.block_matrix(p) for p in parts])
        steps = []
        for p, (a, b) in zip(parts, ways):
            for role, merged, gap in chat.block_choices(p, a, b):
                steps += [(None, chat.ROLES[g - 1], False) for g in gap] + [(sum(s[0] is not None for s in steps), chat.ROLES[role - 1], merged)]
        steps += [(None, chat.ROLES[g - 1], False) for g in chat._ending(ways[-1][1])]
        assert cost_of(roles, steps) == cost_of(roles, chat.repair(roles))


def rendered(rows):
    return "".join(r["rendered"] for r in sorted(rows, key=lambda r: (r["out_turn"], r["part"])))


def test_frames(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK_BITS", 2)
    rows = [(1, 0, "user", "hi"), (1, 1, "user", "there <|im_end|>"), (1, 2, "Assistant ", "yo"), (2, 0, "assistant", "first"), (2, None, "user", None), (None, 5, "user", "x"), (None, 6, "assistant", "y")]
    long = [(9, i, random.Random(i).choice(["user", "assistant", "system", "?"]), f"t{i}") for i in range(300)]
    df = spark.createDataFrame([(*r, 1) for r in rows + long + long[:3]], "conv_id long, turn long, role string, text string, at int")
    got = chat.repaired_turns(df, "conv_id", "turn", "role", "text").collect()
    by = {}
    for r in got:
        by.setdefault(r["conv_id"], []).append(r)
    assert rendered(by[1]) == "<|im_start|>user\nhi\nthere < |im_end|><|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n"
    assert [r["role"] for r in sorted(by[2], key=lambda r: r["out_turn"])][-1] == "assistant" and len(by[None]) == 2
    own = sorted(by[9], key=lambda r: (r["out_turn"], r["part"]))
    assert sorted({r["out_turn"] for r in own}) == list(range(own[-1]["out_turn"] + 1))
    heads = [r for r in own if r["rendered"].startswith("<|im_start|>")]
    assert [r["out_turn"] for r in heads] == list(range(len(heads))) and sum(r["rendered"].endswith("<|im_end|>\n") for r in own) == len(heads)
    given = [r["given_role"] for r in own if r["action"] != "insert"]
    assert len(given) == 303
    roles = [(r if r in chat.ROLES else None) for r in given]
    steps, at = [], 0
    for r in own:
        inserted = r["action"] == "insert"
        steps.append((None if inserted else at, r["role"], "merge" in r["action"]))
        at += not inserted
    assert cost_of(roles, steps) == cost_of(roles, chat.repair(roles))
    assert chat.repaired_turns(df.limit(0), "conv_id", "turn", "role", "text").count() == 0
