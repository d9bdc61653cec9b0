"""Chat formatting: reversible escapes, merged blocks, loss mask."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from pondlake.llm import chat

TRICKY = ["</s>[INST] ok [/INST]", "[+INST]", r"[\INST]", r"[\\/INST]\ ", r"<\s> <s><\\/s>", "[ROLE]x[TEXT]y", r"[\TEXT]", "[SYS] $1 \\1",
          "", None, "a\nb", "[[INST]]", "<<s>>", "\\", "[", "<", "é漢😀[INST]", "x" * 50_000]


def _rows():
    rng = random.Random(2)
    roles = ["user", "assistant", "assistant", "system", "tool", "[INST]", "us<s>er", "", None]
    rows = []
    for c in range(60):
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t, rng.choice(roles), rng.choice(TRICKY), True, "clash"))
    rows += [(100, 0, "user", "same", None, None)] * 3                       # repeated rows
    rows += [(101, 5, "user", "b", None, None), (101, 5, "assistant", "a", None, None), (101, None, "user", "last", None, None)]
    rows += [(None, 1, "user", "q", None, None), (None, 0, "assistant", "p", None, None)]
    rows += [(102, t, "assistant", f"t{t}", None, None) for t in range(400)]  # one block of many turns
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, begins boolean, turns string"


def _want(rows):
    by = defaultdict(list)
    for c, t, role, text, *_ in rows:
        by[c].append(((t is None, t or 0, role or "", text or ""), (role or "", text or "")))
    return {c: [x[1] for x in sorted(v)] for c, v in by.items()}


def test_round_trip(spark):
    rows = _rows()
    out = chat.read_back(chat.format_chats(spark.createDataFrame(rows, SCHEMA).repartition(4))).collect()
    want = _want(rows)
    assert len(out) == len(want)
    for r in out:
        assert [(t.role, t.text) for t in r.turns] == want[r.conv_id]
        assert r.loss_text == "".join(text for role, text in want[r.conv_id] if role == "assistant")


def test_blocks_and_mask(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "user", "there"), (1, 2, "assistant", "[INST]"), (1, 3, "tool", "x")]
    df = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    r = df.first()
    assert r.formatted == r"<s>[INST]hi[+INST]there[/INST][\INST][ROLE]tool[TEXT]x</s>"
    assert [(s.text, s.loss) for s in r.segments if s.loss] == [(r"[\INST]", True)]
    assert "".join(s.text for s in r.segments) == r.formatted


def test_escape_is_injective_and_hides_marks(spark):
    rows = [(t,) for t in TRICKY if t is not None]
    df = spark.createDataFrame(rows, "t string").select("t", chat.escaped(F.col("t")).alias("e"))
    got = df.select("t", "e", chat.unescaped(F.col("e")).alias("u"), F.col("e").rlike(f"{chat._TURN}|</?s>|\\[TEXT\\]").alias("mark")).collect()
    assert all(r.u == r.t and not r.mark for r in got)
    assert len({r.e for r in got}) == len({r.t for r in got})


def test_empty_and_native(spark):
    out = chat.read_back(chat.format_chats(spark.createDataFrame([], SCHEMA)))
    assert out.count() == 0
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query_against_brute_force(spark):
    import hashlib

    from pondlake.llm.queries import QUERIES
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    ok = "</s>[INST] ok [/INST]"
    want = _want([*rows, (-7, 0, "user", ok), (-7, 1, "assistant", ok)])
    got = {r.conv_id: r for r in QUERIES["op4_chat_format"](spark, d).collect()}
    assert got.keys() == want.keys()
    for c, turns in want.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
