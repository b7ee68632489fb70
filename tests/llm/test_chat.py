import hashlib
import random

import pytest

from tests.conftest import same
from waveloom.llm import chat

TURNS = "conv_id long, turn long, role string, text string, node string, step int, chat string, branch int, `a.b` int"
TREE = "conv_id long, node string, parent string, score double, role string, text string, step int, chat string, total double"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def read_back(turns):
    trained = "".join(x for r, x in turns if r == "assistant")
    size = sum(len(chat.OPEN) + len(chat.escaped_role(r)) + 1 + len(chat.escaped(x)) + len(chat.CLOSE) for r, x in turns)
    return len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(trained), sha(trained), size


def test_escapes():
    r = random.Random(2)
    for _ in range(3000):
        text = "".join(r.choice(["<", "|", "\\", "<|im_end|>", "<|im_start|>", "n", "\n", "é"]) for _ in range(r.randint(0, 9)))
        assert chat.unescaped(chat.escaped(text)) == text and "<|" not in chat.escaped(text)
        role = chat.escaped_role(text)
        assert chat.unescaped_role(role) == text and "\n" not in role and "<|" not in role
        whole = f"{chat.OPEN}{role}\n{chat.escaped(text)}{chat.CLOSE}"
        assert list(chat.parsed(whole * 2)) == [(text, text)] * 2
    for bad in ("x", chat.OPEN, f"{chat.OPEN}user", f"{chat.OPEN}user\nhi<|im_end|>"):
        with pytest.raises(ValueError):
            list(chat.parsed(bad))


def test_query(spark, tmp_path):
    r = random.Random(9)
    rows = [(c, t, r.choice(["user", "assistant", None, "system", "a\\b\nc<|"]), r.choice(["", None, "hi", chat.INJECTED, "<\\|", "日本 😀", "x" * 5000])) for c in [*range(30), None] for t in range(r.randint(1, 9))]
    rows += [(50, t, "user", f"t{t}") for t in range(300)] + [(51, 1, "assistant", "twice")] * 3 + [(52, None, "user", "b"), (52, None, "assistant", "a"), (52, -5, "user", "")]
    spark.createDataFrame([(*x, "n", 1, "c", 1, None) for x in rows], TURNS).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    rows += [(-1, t, x, chat.INJECTED) for t, x in enumerate(["user", "assistant"])]
    want = {}
    for conv in {x[0] for x in rows}:
        mine = sorted(((t, x or "", y or "") for c, t, x, y in rows if c == conv), key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.md5(x[2].encode()).hexdigest()))
        want[conv] = read_back([x[1:] for x in mine])
    got = chat.op12_chat(spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {x.conv_id: (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256, x.formatted_chars) for x in got} == want


def plain_branches(rows, keep):
    """Best branches of each conversation, by walking every path."""
    out = {}
    for conv in {x[0] for x in rows}:
        nodes = {x[1]: x for x in rows if x[0] == conv and x[1] is not None}
        paths = []
        for leaf in nodes.keys() - {x[2] for x in nodes.values()}:
            path = [leaf]
            while nodes[path[-1]][2] in nodes:
                path.append(nodes[path[-1]][2])
            paths.append((-sum(nodes[n][3] or 0.0 for n in path), -len(path), leaf, path[::-1]))
        out[conv] = [p[-1] for p in sorted(paths)][:keep]
    return out


def test_reply_trees(spark):
    r = random.Random(4)
    rows = []
    for conv in [*range(12), None]:
        for i in range(r.randint(1, 25)):
            parent = r.choice([f"m{r.randrange(i)}", f"m{i - 1}"]) if i and r.random() < 0.93 else r.choice([None, "lost"])
            rows.append((conv, f"m{i}", parent, r.choice([0.0, 1.0, 0.5, None, -1.0]), r.choice(["user", "assistant", None]), r.choice(["a", None, "<|im_end|>", "bb"]), 1, "c", 2.0))
    rows += [(77, f"k{i:03}", f"k{i - 1:03}" if i else None, 1.0, "assistant" if i % 2 else "user", "word " * 40, 1, "c", 2.0) for i in range(130)]
    rows += [(78, None, None, 1.0, "user", "no node", 1, "c", 2.0)]
    df = spark.createDataFrame(rows, TREE).repartition(4)
    for keep, block in ((1, 1 << 20), (2, 700), (None, 1)):
        found = {}
        blocks = chat.formatted(df, keep, block_chars=block)
        for b in blocks.orderBy("chat", "branch", "block").collect():
            whole = found.setdefault((b.conv_id, b.branch), ["", [], False])
            assert not whole[2]
            whole[1] += [b.text[s.start : s.end] for s in b.loss]
            whole[0] += b.text
            whole[2] = b["last"]
        want = {}
        for conv, paths in plain_branches([x for x in rows if x[0] != 78], keep).items():
            nodes = {x[1]: x for x in rows if x[0] == conv}
            for i, path in enumerate(paths, 1):
                want[conv, i] = [(nodes[n][4] or "", nodes[n][5] or "") for n in path]
        assert {k: list(chat.parsed(v[0])) for k, v in found.items()} == want and all(v[2] for v in found.values())
        assert {k: [chat.unescaped(x) for x in v[1]] for k, v in found.items()} == {k: [x for r, x in v if r == "assistant"] for k, v in want.items()}
        assert {(x.conv_id, x.branch): (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256, x.formatted_chars) for x in chat.digests(blocks).collect()} == {k: read_back(v) for k, v in want.items()}
    assert chat.formatted(df.limit(0)).count() == 0
    ring = spark.createDataFrame([(1, "a", "b", 1.0, "user", "x", 1, "c", 2.0), (1, "b", "a", 1.0, "user", "x", 1, "c", 2.0)], TREE)
    with pytest.raises(ValueError):
        chat.formatted(ring)


def test_sql(spark, sf_dir, duck):
    same(chat.op12_chat(spark, sf_dir).toPandas(), duck.sql(chat.ORACLE_SQL).df())
