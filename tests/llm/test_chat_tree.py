import hashlib
import random

from hertzflow.llm import chat_tree as C


def chats():
    rng = random.Random(6)
    texts = ["hello", "</s>[INST] ok [/INST]", "a\\b [x] <s>", "", None, "é漢😀\nline", "yes", "[user] hi</s>", "\\", "\\\\<"]
    rows = []
    for conv in range(40):
        for turn in range(rng.choice([1, 2, 2, 3, 6])):
            role = "user" if turn % 2 == 0 else "assistant"
            rows.append((conv, turn, role, rng.choice(texts[: 2 if turn < 2 else 10])))
    rows += [(100, 0, "user", "hello"), (100, 1, None, "x"), (101, None, "a]b", "q"), (102, 3, "user", "twice"), (102, 3, "user", "twice")]
    rows += [(None, 0, "user", "no id"), (None, 1, "assistant", "fine")]
    rows += [(200, t, "assistant", f"turn {t}") for t in range(300)] + [(201, t, "assistant", f"turn {t}") for t in range(150)]
    return rows


def by_conv(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    return {c: [t[1:] for t in sorted(v)] for c, v in out.items()}


def test_round_trip(spark):
    rows = chats()
    df = spark.createDataFrame([(*r, 3) for r in rows], "conv_id long, turn long, role string, text string, depth int").repartition(4)
    tree = C.format_chats(df)
    want = by_conv(rows)
    turns = C.read_back(tree)
    got = {}
    for r in turns.collect():
        got.setdefault(r.conv_id, []).append((r.depth, r.role, r.text))
    assert {c: [t[1:] for t in sorted(v)] for c, v in got.items()} == want
    for r in C.digests(turns).collect():
        each = want[r.conv_id]
        loss = "".join(t for role, t in each if role == "assistant")
        assert r.n_turns == len(each)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in each).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars >= sum(len(a) + len(b) for a, b in each)


def test_sequence_is_a_depth_first_tree(spark):
    rows = chats()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    tree = C.format_chats(df)
    nodes = sorted(tree.sequence.collect(), key=lambda r: r.start)
    want = {tuple(v[: k + 1]) for v in by_conv(rows).values() for k in range(len(v))}
    assert len(nodes) == len(want)
    path, at = [], 0
    by_id = {n.node: n for n in nodes}
    for n in nodes:
        assert n.start == at and n.stop == at + len(n.text)
        at = n.stop
        while path and path[-1] != n.parent:
            path.pop()
        assert (n.parent is None) == (not path)
        seen = {i for a in n.ancestors for i in range(a.start, a.stop)}
        assert seen == {i for p in path for i in range(by_id[p].start, by_id[p].stop)}
        assert n.position == sum(len(by_id[p].text) for p in path)
        path.append(n.node)
        control = n.text[3:-4].replace("\\\\", "").replace("\\<", "").replace("\\[", "")
        assert n.text.startswith("<s>[") and n.text.endswith("</s>") and "<" not in control and "[" not in control[1:]


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.digests(C.read_back(C.format_chats(df))).count() == 0
