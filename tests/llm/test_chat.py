"""Layouts of chat records, all mixed, and the chat query by brute force."""

import hashlib
import json
from collections import Counter

from pyspark.sql import functions as F

from plexus.llm import chat

HI, YO = ("user", "hi"), ("assistant", "yo")
KNOWN = [
    ({"role": "user", "text": "hi"}, "turn", [HI]),
    ({"role": "user", "text": "hi", "turn": 3, "conv_id": "a"}, "turn", [HI]),
    ({"role": None, "text": None}, "turn", [(None, None)]),
    ({"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]}, "messages", [HI, YO]),
    ({"messages": [{"role": "user", "content": "hi", "name": "x"}, {"role": "assistant", "content": "yo", "meta": {"a": [1]}}], "extra": [[1], {"b": 2}]}, "messages", [HI, YO]),
    ({"messages": []}, "messages", []),
    ({"messages": [{"role": "user", "content": "hi"}, {"content": "yo"}, {"role": "tool"}]}, "messages", [HI, (None, "yo"), ("tool", None)]),
    ({"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}], "id": 4}, "conversations", [HI, YO]),
    ({"prompt": "hi", "completion": "yo", "metadata": {"k": 1}}, "prompt", [HI, YO]),
    ({"prompt": "hi", "completion": "yo", "system": "be"}, "prompt", [("system", "be"), HI, YO]),
    ({"prompt": "hi", "response": "yo"}, "prompt_response", [HI, YO]),
    ({"instruction": "hi", "output": "yo"}, "instruction", [HI, YO]),
    ({"instruction": "hi", "input": "", "output": "yo"}, "instruction", [HI, YO]),
    ({"instruction": "do", "input": "it", "output": "yo", "source": "z"}, "instruction", [("user", "do\n\nit"), YO]),
    ({"question": "hi", "answer": "yo"}, "question", [HI, YO]),
]
UNKNOWN = [{"what": 1}, {}, {"messages": ["a", "b"]}, {"messages": "text"}, {"prompt": "hi"}, {"prompt": "hi", "completion": "yo", "messages": []}, [1, 2], "text", 7]


def test_all_layouts_mixed(spark):
    rows = [(i, json.dumps(r), "own") for i, (r, _, _) in enumerate(KNOWN)] + [(100 + i, json.dumps(r), "own") for i, r in enumerate(UNKNOWN)] + [(200, "{", "own"), (201, None, "own"), (202, "", "own")]
    d = spark.createDataFrame(rows, "id bigint, record string, layout_ string").repartition(3)
    known = chat.canonical_turns(d)
    assert known.columns == ["id", "record", "layout_", "fingerprint", "layout", "turns"]
    got = {r["id"]: r for r in known.collect()}
    assert len(got) == len(rows)
    for i, (_, layout, turns) in enumerate(KNOWN):
        assert (got[i]["layout"], [tuple(t) for t in got[i]["turns"]]) == (layout, turns), KNOWN[i]
    bad = [r for i, r in got.items() if i >= 100]
    assert [r for r in bad if r["turns"] is not None] == [] and all(got[i]["fingerprint"] is None for i in (200, 201, 202))
    assert sum(r["n"] for r in chat.rejected(known).collect()) == len(bad)
    turns = known.where("turns is not null").select("id", F.posexplode("turns").alias("turn", "t")).select("id", "turn", "t.role", "t.text")
    back = {r["id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat.read_back(chat.formatted(turns, "id")).collect()}
    assert back == {i: [(r or "", t or "") for r, t in turns] for i, (_, _, turns) in enumerate(KNOWN) if turns}
    assert chat.canonical_turns(d.where(F.lit(False))).count() == 0


def test_chat_query_by_brute_force(spark, tmp_path):
    rows = [(-1, 0, "user", "mine"), (-1, 1, "assistant", "own"), (1, 1, "assistant", None), (1, 0, None, "q"), (2, 0, "assistant", "x" * 40_000), (3, 0, "user", "twice"), (3, 0, "user", "twice"), (4, 5, "assistant", "<|nl|>\\<|im_end|>\n"), (None, 0, "user", "")]
    d = spark.createDataFrame([(*r, "z") for r in rows], "conv_id bigint, turn bigint, role string, text string, record string")
    d.write.parquet(f"file://{tmp_path}/conversations.parquet")
    say = "<|im_end|><|im_start|>assistant ok"
    convs = {}
    for key, c, t, role, text in [(c, c, t, r or "", x or "") for c, t, r, x in rows] + [("added", -1, 0, "user", say), ("added", -1, 1, "assistant", say)]:
        convs.setdefault((key, c), []).append((t, role, text))
    want = Counter()
    for (_, c), turns in convs.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        learned = "".join(x for _, r, x in turns if r == "assistant")
        want[c, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest()] += 1
    got = chat.op3_chat(spark, f"file://{tmp_path}").collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    d.where(F.lit(False)).write.parquet(f"file://{tmp_path}/none/conversations.parquet")
    assert [r["conv_id"] for r in chat.op3_chat(spark, f"file://{tmp_path}/none").collect()] == [-1]
