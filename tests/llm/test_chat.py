import collections
import hashlib
import random

import pyarrow.parquet as pq

from tidemark.llm import chat
from tidemark.llm.queries import QUERIES

PIECES = ["\\", "<", "s", ">", "/", "[INST]", "</s>", "<|im_end|>", "a", "\n", "<|", "|>", "im_start", "é", "n", "\\n"]


def test_escaping_is_reversible_and_leaves_no_control_string():
    rng, coder = random.Random(2), chat.tokens_of(chat.TOKENIZER)
    for _ in range(2000):
        t = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12)))
        assert chat.unescape(chat.escape(t)) == t and not any(c in chat.escape(t) for c in chat.CONTROL)
        ids, lo, hi = chat.format_turn(coder, t, t[::-1])
        assert chat.read_turn(coder.decode(ids)) == (t, t[::-1]) and chat.unescape(coder.decode(ids[lo:hi])) == t[::-1]


def test_everything_is_read_back(spark, sf):
    t = pq.read_table(f"{sf}/conversations.parquet").to_pylist()
    said = collections.defaultdict(list)
    for r in t:
        said[r["conv_id"]].append((r["turn"], r["role"], r["text"]))
    said[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    out = QUERIES["op8_prefix_tree_chat"](spark, sf).collect()
    assert len(out) == len(said)
    for r in out:
        turns = sorted(said[r["conv_id"]])
        loss = "".join(x for _, role, x in turns if role == "assistant")
        digest = hashlib.sha256("".join(f"{role}\n{x}\n" for _, role, x in turns).encode()).hexdigest()
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), digest)
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] >= sum(len(x) + len(role) for _, role, x in turns)


def test_shared_turns_stand_once(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (2, 1, "assistant", "no"), (2, 2, "user", "ok"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (3, 2, "user", "x"), (4, 0, "user", "other")]
    packs = chat.packed(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(packs) == 1
    p = packs[0]
    assert len(p["nodes"]) == 6 and p["nodes"][-1]["end"] == len(p["input_ids"]) == len(p["position_ids"])
    for node in p["nodes"]:
        parent, chain = node["parent"], [(node["start"], node["end"])]
        while parent is not None:
            up = p["nodes"][parent]
            chain.insert(0, (up["start"], up["end"]))
            parent = up["parent"]
        seen = [i for a, b in node["attends"] for i in range(a, b)]
        assert seen == [i for a, b in chain for i in range(a, b)]
        assert p["position_ids"][node["start"] : node["end"]] == list(range(len(seen) - (node["end"] - node["start"]), len(seen)))


def test_full_packs_are_carried_on(spark):
    rows = [(i, k, "user" if k % 2 == 0 else "assistant", "same start" if k == 0 else f"turn {i} {k} " * 20) for i in range(40) for k in range(4)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    packs = chat.packed(turns, pack_tokens=500)
    assert packs.count() > 5 and chat.read_back(packs).count() == 40


def test_odd_rows(spark):
    rows = [(1, 0, None, None), (None, None, "a\nb", "x"), (2, 0, "user", ""), (2, 0, "user", ""), (2, None, "assistant", "y"), (3, 1, "assistant", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r["n_turns"] for r in chat.read_back(chat.packed(turns)).collect()}
    assert got == {1: 1, None: 1, 2: 3, 3: 1}
    assert chat.read_back(chat.packed(turns.limit(0))).count() == 0
