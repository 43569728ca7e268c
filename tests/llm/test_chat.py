import random

from graphloom.llm import chat


def talk(*pairs):
    return [{"role": r, "content": c} for r, c in pairs]


def brute(messages, render):
    """Longest common prefix letter by letter; the closing text ends every output."""
    outs = [render(messages[:k]) for k in range(len(messages) + 1)]
    found = []
    for a, b in zip(outs, outs[1:]):
        same = 0
        while same < min(len(a), len(b)) and a[same] == b[same]:
            same += 1
        tail = a[same:]
        moved = bool(tail) and b[same:].endswith(tail) and all(x.endswith(tail) for x in outs)
        found.append((same, len(b) - len(tail) * moved, bool(tail) and not moved))
    return outs[-1], found


def test_spans():
    m = talk(("system", "Be kind."), ("user", "Hi?"), ("assistant", "Hello."), ("user", "Bye"))
    text, found = chat.spans(m, chat.chatml)
    assert [text[a:b] for a, b, _ in found] == [f"<|im_start|>{x['role']}\n{x['content']}<|im_end|>\n" for x in m]
    assert not any(r for *_, r in found)
    text, found = chat.spans(m, chat.instruct)
    assert [r for *_, r in found] == [False] * 4 and "Hello." in text[found[2][0] : found[2][1]]
    _, found = chat.spans(talk(("user", "a"), ("assistant", "first"), ("user", "b"), ("assistant", "second")), chat.last_answer_only)
    assert [r for *_, r in found] == [False, False, False, True]


def test_repeated_answers_are_rewriting():
    m = talk(("assistant", "same"), ("assistant", "the same"), ("assistant", "the same"))
    assert [r for *_, r in chat.spans(m, chat.last_answer_only)[1]] == [False, True, True]


def test_a_raise_in_the_middle_costs_two_turns():
    m = talk(*[("user", x) for x in "abcd"])

    def broken(messages):
        if len(messages) in (0, 2):
            raise ValueError
        return chat.chatml(messages)

    text, found = chat.spans(m, broken)
    whole = chat.spans(m, chat.chatml)
    assert text == whole[0] and found == [whole[1][0], (None,) * 3, (None,) * 3, whole[1][3]]
    assert chat.spans(m[:2], broken) == (None, found[:2])


def test_brute_force_on_random_conversations():
    rng = random.Random(4)
    for _ in range(150):
        m = [{"role": rng.choice(["system", "user", "assistant"]), "content": "".join(rng.choice("ab<|s/>\n") for _ in range(rng.randint(0, 12)))} for _ in range(rng.randint(0, 6))]
        for render in chat.TEMPLATES.values():
            if m:
                assert chat.spans(m, render) == brute(m, render)


def test_conversations(spark):
    rows = [(1, 1, "assistant", "B"), (1, 0, "user", "A"), (2, 0, "user", None), (2, None, None, "n"), (2, 0, "user", None), (None, 0, "user", "lost"), (3, 0, "user", "long" * 50000)]
    turns = spark.createDataFrame([(c, t, r, x, "q") for c, t, r, x in rows], "conv_id long, turn long, role string, text string, start string")
    got = chat.format_conversations(turns).collect()
    assert len(got) == 3 * 6
    one = [r for r in got if r.conv_id == 1 and r.template == "chatml"]
    assert [(r.turn, r.role) for r in one] == [(0, "user"), (1, "assistant")] and one[0].text is None and one[1].text == "<|im_start|>user\nA<|im_end|>\n<|im_start|>assistant\nB<|im_end|>\n"
    two = [r.turn for r in got if r.conv_id == 2 and r.template == "chatml"]
    assert two == [None, 0, 0]

    def broken(messages):
        if len(messages) > 1:
            raise ValueError
        return "x"

    bad = chat.format_conversations(turns, {"broken": broken}).collect()
    assert [(r.start, r.end, r.rewrites, r.length, r.text) for r in bad if r.conv_id == 3] == [(1, 1, False, 1, "x")]
    assert [(r.start, r.end, r.length) for r in bad if r.conv_id == 1] == [(1, 1, None), (None, None, None)]
    named = spark.createDataFrame([("one", "0", "user", "A"), ("5", "x", "user", "B")], "conv_id string, turn string, role string, text string")
    assert [(r.conv_id, r.turn, r.end) for r in chat.format_conversations(named, {"chatml": chat.chatml}).collect()] == [(5, None, 29)]
    assert chat.format_conversations(turns.limit(0)).count() == 0
