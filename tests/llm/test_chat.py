import hashlib
import random

import public_tokenizers
import pytest

from riskspark.llm import chat

TOKENIZER = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
DDL = "conv_id long, turn long, role string, text string, key string, start int"


@pytest.fixture(scope="module")
def conversations(spark):
    rng, rows = random.Random(3), []
    hello = [("system", "You are kind."), ("user", "Hello there"), ("assistant", "Hi! How can I help?")]
    for c in range(60):
        turns = hello[: rng.randint(0, 3)] + [(rng.choice(["user", "assistant"]), f"say {rng.randrange(3)}") for _ in range(rng.randint(0, 5))]
        rows += [(c, t, r, x) for t, (r, x) in enumerate(turns)]
    probe = r"\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", probe), (-7, 1, "assistant", probe), (200, 0, "us:er\n#", "## \\ \\\\ #### <\\/turn> </turn></turn>\r\n"),
             (200, 1, None, None), (201, None, "assistant", "no turn"), (201, 5, "assistant", ""), (None, 0, "user", "no id"),
             (202, 0, "user", "twice"), (202, 0, "user", "twice"), (203, 1, "assistant", "été 中文 🙂 " * 20_000)]
    rows += [(204, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(300)] + [(205, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(280)]
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], DDL)


def test_read_back_equals_the_conversations(conversations):
    nodes, index = chat.prefix_tree(conversations, *TOKENIZER)
    got = {r.conv_id: r for r in chat.read_back(nodes, index, *TOKENIZER).collect()}
    by = {}
    for r in conversations.collect():
        by.setdefault(r.conv_id, []).append((r.turn is not None, r.turn, r.role is not None, r.role or "", r.text or ""))
    assert set(got) == set(by)
    for conv, turns in by.items():
        turns = [(t[3], t[4]) for t in sorted(turns, key=lambda t: (t[0], t[1] or 0, t[3], t[4]))]
        loss = "".join(x for r, x in turns if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.formatted_chars == sum(len(chat.format_turn(a, b)[0]) for a, b in turns)


def test_tree_is_depth_first_with_exact_intervals(conversations):
    nodes, index = chat.prefix_tree(conversations, *TOKENIZER)
    rows = sorted(nodes.collect(), key=lambda r: r.start)
    assert rows[0].start == 0 and all(a.end == b.start for a, b in zip(rows, rows[1:]))
    by_start = {r.start: r for r in rows}
    paths = {}
    for r in index.collect():
        paths.setdefault(r.conv, []).append((r.depth, r.start))
    prefixes, spans = {}, {}
    for conv, path in paths.items():
        starts = [s for _, s in sorted(path)]
        for d, s in enumerate(starts):
            prefixes[s] = tuple(starts[:d])
            for a in starts[: d + 1]:
                spans.setdefault(a, set()).add(s)
    assert len(prefixes) == len(rows) < sum(map(len, paths.values()))
    for s, above in prefixes.items():
        attended = [p for a in by_start[s].ancestors for p in range(a.start, a.end)]
        assert attended == [p for a in above for p in range(a, by_start[a].end)] and by_start[s].position == len(attended)
    order = [r.start for r in rows]
    for a, below in spans.items():            # a subtree is one stretch of the stream
        at = order.index(a)
        assert set(order[at:at + len(below)]) == below


def test_template_is_reversible():
    rng = random.Random(1)
    for _ in range(3000):
        role, text = ("".join(rng.choice(["#", "\\", "/", "</turn>", "### ", ":", "\n", "a", " "]) for _ in range(rng.randrange(12))) for _ in range(2))
        formatted, a, b = chat.format_turn(role, text)
        assert chat.parse_turn(formatted) == (role, text) and chat.unescape(formatted[a:b]) == text
        assert formatted.count("</turn>") == 1 and formatted[3:].count("###") == 0


def test_empty_table(spark, conversations):
    nodes, index = chat.prefix_tree(conversations.where("false"), *TOKENIZER)
    assert nodes.count() == index.count() == chat.read_back(nodes, index, *TOKENIZER).count() == 0


def test_ids_are_those_of_the_whole_text(spark):
    """No cut inside a text, however long: a boundary would change the tokens around it."""
    import struct
    text = "".join(f"word{k % 977} and  spaces\n" for k in range(9_000)) + "x" * 70_000
    rows = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text[::-1])], "conv_id long, turn long, role string, text string")
    nodes, _ = chat.prefix_tree(rows, *TOKENIZER)
    encoding = chat._encoding(*TOKENIZER)
    want = [encoding.encode_ordinary(chat.format_turn(r, t)[0]) for r, t in (("user", text), ("assistant", text[::-1]))]
    got = [list(struct.unpack(f"<{len(r.tokens) // 4}I", r.tokens)) for r in nodes.orderBy("start").collect()]
    assert got == want
