import random

import pytest

from laborlens.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def slow_parents(rows):
    """(conv, turn) -> parent turn, by comparing every quoted passage with every earlier message."""
    read = [(c, t, chat.parse(x)) for c, t, _, x in rows]
    out = {}
    for c, t, (_, _, _, quotes) in read:
        found = {}
        for q in quotes:
            turns = [u for d, u, p in read if d == c and u < t and q["key"] in p[2]]
            if turns:
                best = found.get((q["level"], q["seq"]))
                mine = (-q["part"], max(turns))
                found[q["level"], q["seq"]] = max(best, mine) if best else mine
        if found:
            out[c, t] = found[min(found)][1]
    return out


def test_random_threads_equal_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for conv in range(6):
        texts = []
        for turn in range(25):
            own = rng.choice([f"message {conv} {turn}", "ok", f"two lines {turn}\nof text", f"p {turn}\n\nq {rng.randint(0, 3)}"])
            text = own
            if texts and rng.random() < 0.7:
                src = rng.choice(texts)
                part = rng.choice([src, src.split("\n")[0], "never said"])
                text = "\n".join("> " + x for x in part.split("\n")) + "\n" + own
                if rng.random() < 0.3:
                    text = "On Monday A wrote:\n" + text
            rows.append((conv, turn, "user", text))
            texts.append(text)
    got = chat.threads(spark.createDataFrame(rows, SCHEMA)).collect()
    want = slow_parents(rows)
    assert {(r.conv_id, r.turn): r.parent_turn for r in got if r.parent_turn is not None} == want
    for r in got:
        assert ">" not in r.body and "wrote:" not in r.body
    order = slow_order({(c, t): want.get((c, t)) for c, t, _, _ in rows})
    assert {(r.conv_id, r.turn): (r.root_turn, r.depth, r.position) for r in got} == order
    assert [(r.conv_id, r.position) for r in got] == sorted((r.conv_id, r.position) for r in got)


def test_nested_levels():
    body, n, _, quotes = chat.parse("Hi\nOn Tuesday B wrote:\n>> deep one\n> > deep two\n> upper\n\nbye")
    assert body == "Hi\n\nbye" and n == 2
    assert sorted({(q["level"], q["seq"]) for q in quotes}) == [(1, 2), (2, 1)]


def test_long_reply_chain(spark):
    rows = [(1, 0, "a", "m0")] + [(1, t, "a", f"> m{t - 1}\nm{t}") for t in range(1, 70)]
    got = chat.threads(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [r.depth for r in got] == list(range(70))


def test_repeated_passages_link_to_the_latest(spark):
    rows = [(1, t, "a", "same") for t in range(600)] + [(1, 600, "b", "> same\nanswer"), (1, 300, "c", "> SAME \nmid")]
    got = {(r.turn, r.role): r for r in chat.threads(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[600, "b"].parent_turn == 599 and got[300, "c"].parent_turn == 299


def test_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, None, ""), (1, 2, "user", "> \n>\nx"), (None, 3, "user", "> x"), (2, None, "user", "t"),
            (1, 2, "user", "> \n>\nx"), (3, 0, "user", "line\n" * 20000)]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS path", "'b' AS body", "2 AS uid")
    got = chat.threads(frame).collect()
    assert len(got) == 7 and all(r.n_linked == 0 and r.parent_turn is None and r.depth == 0 for r in got)
    assert [r.body for r in got if r.turn == 2] == ["x", "x"]
    assert chat.threads(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("text,level", [("> a", 1), (">> a", 2), (" > > a", 2), ("a > b", 0), (">a", 1)])
def test_quote_level(text, level):
    assert chat.passages(text)[0][0] == level


def slow_order(nodes):
    """(conv, turn) -> (root, depth, position) of turn -> parent, by walking the trees."""
    out = {}
    for conv in {c for c, _ in nodes}:
        todo = [(t, t, 0) for t in sorted((t for (c, t), p in nodes.items() if c == conv and p is None), reverse=True)]
        replies = {}
        for (c, t), p in sorted(nodes.items()):
            if c == conv and p is not None:
                replies.setdefault(p, []).append(t)
        place = 0
        while todo:
            t, root, depth = todo.pop()
            out[conv, t] = root, depth, place
            place += 1
            todo += [(u, root, depth + 1) for u in reversed(replies.get(t, []))]
    return out


def test_places_equal_a_walk_of_the_trees(spark):
    rng = random.Random(3)
    nodes = {(1, t): t - 1 if t else None for t in range(3000)}                       # one long chain
    nodes |= {(2, t): None if t in (-700, 400) else -700 for t in range(-700, 900)}   # many replies to one message
    for conv in range(3, 9):
        turns = sorted(rng.sample(range(-400, 1200), 200))
        nodes |= {(conv, t): rng.choice([None, *turns[max(0, k - 5):k]]) if k else None for k, t in enumerate(turns)}
    frame = spark.createDataFrame([(c, t, p) for (c, t), p in nodes.items()], "conv_id long, turn long, parent long")
    got = chat.places(frame).collect()
    assert {(r.conv_id, r.turn): (r.root_turn, r.depth, r.position) for r in got} == slow_order(nodes)
    assert len(got) == len(nodes)


def test_threads_are_ordered_without_paths(spark):
    rows = [(1, 0, "a", "m0")] + [(1, t, "a", f"> m{t - 1}\nm{t}") for t in range(1, 300)] + [
        (1, 400, "b", "> m7\nlate"), (None, 3, "c", "x"), (1, None, "c", "y"), (1, 400, "b", "> m7\nlate")]
    out = chat.threads(spark.createDataFrame(rows, SCHEMA))
    assert not [f.name for f in out.schema if f.dataType.typeName() == "array"]
    got = out.collect()
    assert [r.position for r in got] == [None, None, *range(300), 300, 300]
    assert [(r.turn, r.parent_turn, r.depth, r.root_turn) for r in got[-2:]] == [(400, 7, 8, 0)] * 2


def test_turns_far_apart(spark):
    """Turn numbers 10^9 apart, 5000 turns in one conversation, one passage in all of them."""
    rows = [(1, 10 ** 9 * t - 7, "a", f"same\n\nm{t}" if t % 5 else f"> m{t - 3}\nsame\n\nm{t}") for t in range(5000)]
    numbers = {(r.conv_id, r.turn): r.no for r in chat.numbered(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert numbers == {(1, 10 ** 9 * t - 7): t for t in range(5000)}
    got = {r.turn: r for r in chat.threads(spark.createDataFrame(rows, SCHEMA)).collect()}
    for t in (5, 10, 4995):
        assert got[10 ** 9 * t - 7].parent_turn == 10 ** 9 * (t - 3) - 7
    assert sum(r.parent_turn is not None for r in got.values()) == 999
    assert sorted(r.position for r in got.values()) == list(range(5000))


def test_rows_that_hash_alike_stay_apart(spark):
    """A null role with a text, and that text as a role with a null text."""
    rows = [(1, 0, "q", "x"), (1, 1, None, "> x"), (1, 1, "> x", None)]
    got = chat.threads(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.role or "", r.n_linked) for r in got) == [("", 1), ("> x", 0), ("q", 0)]
