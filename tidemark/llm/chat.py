"""Chat formatting as packed prefix trees.

Conversations that share initial turns are merged: a pack holds the tokens of each distinct turn path once, depth first,
with position ids that count from the root and, per node, the intervals of the pack that its tokens attend to (its
ancestors and itself). A loss mask covers the assistants' texts.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The vocabulary file, which every executor must find at this path; ``tokenizer`` or TIDEMARK_TOKENIZER names another.
TOKENIZER = os.environ.get("TIDEMARK_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Tokens after which a pack is closed, before the next conversation; one conversation always stays whole.
PACK_TOKENS = 65_536
#: Characters of conversations that a task packs, between two cuts of the sorted order.
TASK_CHARS = 4_000_000

# The template's control strings and those of common other templates, and the split pattern of the vocabulary.
BEGIN, END = "<|im_start|>", "<|im_end|>"
CONTROL = [BEGIN, END, "<|im_sep|>", "<|endoftext|>", "<|startoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Each alternative starts with a plain character, which lets the search skip to it.
_IN_TEXT = re.compile("|".join(f"{re.escape(c[0])}\\\\*{re.escape(c[1:])}" for c in CONTROL))


def escape(text: str) -> str:
    """A backslash more after the first character of every control string, however many it has there already."""
    return _IN_TEXT.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    """The text that ``escape`` was given."""
    return _IN_TEXT.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text)


class Tokens:
    """A byte-level vocabulary with two ids of its own for the template's marks."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.coder = tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.begin = max(ranks.values()) + 2  # one id after the vocabulary stays free for an end of text
        self.end = self.begin + 1
        self.tail = np.concatenate([[self.end], self.encode("\n")]).astype(np.int32)

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.coder.encode_ordinary(text), np.int32)

    @lru_cache(maxsize=1000)  # noqa: B019  a table has few roles
    def head(self, role: str) -> np.ndarray:
        """The mark and the role's line, in which line feeds and backslashes are written out."""
        line = escape(role.replace("\\", "\\\\").replace("\n", "\\n")) + "\n"
        return np.concatenate([[self.begin], self.encode(line)]).astype(np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ``ids``, marks included."""
        out, last = [], 0
        for at in np.flatnonzero(ids >= self.begin).tolist():
            out += [self.coder.decode_bytes(ids[last:at].tolist()), (BEGIN if ids[at] == self.begin else END).encode()]
            last = at + 1
        return b"".join([*out, self.coder.decode_bytes(ids[last:].tolist())]).decode()


@lru_cache(maxsize=2)
def tokens_of(path: str) -> Tokens:
    return Tokens(path)


def format_turn(coder: Tokens, role: str, text: str) -> tuple[np.ndarray, int, int]:
    """Token ids of a turn, and where those of its text begin and end: mark, role, line feed, text, mark, line feed."""
    head, body = coder.head(role), coder.encode(escape(text))
    return np.concatenate([head, body, coder.tail]), len(head), len(head) + len(body)


def read_turn(formatted: str) -> tuple[str, str]:
    """(role, text) of a formatted turn."""
    role, _, text = formatted[len(BEGIN) : -len(END) - 1].partition("\n")
    role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))  # a role stands on one line
    return role, unescape(text)


class Pack:
    """A tree in the making: its tokens so far, its nodes, and the path of the last conversation."""

    def __init__(self, coder: Tokens):
        self.coder = coder
        self.ids: list[np.ndarray] = []
        self.positions: list[np.ndarray] = []
        self.size = 0
        self.loss: list[list[int]] = []
        self.nodes: list[dict] = []
        self.leaves: list[dict] = []
        self.path: list[tuple[tuple[str, str], int]] = []  # (turn, node) from the root

    def add(self, conv_id, turns: list[tuple[str, str]]) -> None:
        """Hang a conversation into the tree, where its turns leave the last one's path."""
        shared = 0
        while shared < min(len(turns), len(self.path)) and self.path[shared][0] == turns[shared]:
            shared += 1
        del self.path[shared:]
        for role, text in turns[shared:]:
            ids, lo, hi = format_turn(self.coder, role, text)
            at, parent = self.size, self.path[-1][1] if self.path else None
            before = 0 if parent is None else self.nodes[parent]["last"] + 1
            self.ids.append(ids)
            self.positions.append(np.arange(before, before + len(ids), dtype=np.int32))
            self.size += len(ids)
            if role == "assistant":
                self.loss.append([at + lo, at + hi])
            seen = [] if parent is None else [list(x) for x in self.nodes[parent]["attends"]]
            if seen and seen[-1][1] == at:
                seen[-1][1] = at + len(ids)
            else:
                seen.append([at, at + len(ids)])
            self.nodes.append({"parent": parent, "start": at, "end": at + len(ids), "last": before + len(ids) - 1, "attends": seen})
            self.path.append(((role, text), len(self.nodes) - 1))
        self.leaves.append({"conv_id": conv_id, "node": self.path[-1][1] if self.path else None})


PACK_TYPE = pa.schema(
    [
        ("input_ids", pa.list_(pa.int32())),
        ("position_ids", pa.list_(pa.int32())),
        ("loss_spans", pa.list_(pa.list_(pa.int32()))),
        ("nodes", pa.list_(pa.struct([("parent", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("attends", pa.list_(pa.list_(pa.int32())))]))),
    ]
)
PACK_DDL = "input_ids array<int>, position_ids array<int>, loss_spans array<array<int>>, nodes array<struct<parent:int,start:int,end:int,attends:array<array<int>>>>, leaves array<struct<conv_id:{id},node:int>>"


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns, path): each conversation's (role, text) by turn, and hashes of its turns from the first on.

    Null roles and texts are empty; equal turn numbers stand by role and text, null ones first. A null conv_id is one
    conversation.
    """
    clean = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    listed = clean.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return listed.select("conv_id", "turns", F.transform("turns", lambda t: F.xxhash64(t["role"], t["text"])).alias("path"))


def packed(turns: DataFrame, tokenizer: str = TOKENIZER, pack_tokens: int = PACK_TOKENS) -> DataFrame:
    """Packs of the conversations in ``turns`` (conv_id, turn, role, text), one row each.

    Conversations are sorted by their turns' hashes over the whole table, so that those with equal beginnings stand
    together, and packed in that order. A tree ends, and is carried on in the next pack with the path that both need, when
    a pack is full or a partition ends: shared turns stand once in a pack, and no tree has to fit into one task.
    Repeated turns all stand, by role and text; a null conv_id is one conversation, held in one task like any other, however
    long. Columns of other names are not read; an empty table gives no packs.
    Columns: input_ids, position_ids (of a node's tokens, counted from its root), loss_spans (of assistants' texts),
    nodes (parent, start, end, and the intervals that it attends to, its own last), leaves (conv_id and its last node).
    """
    listed = conversations(turns)
    chars = turns.agg(F.sum(F.length("text"))).first()[0] or 0
    ordered = listed.repartitionByRange(max(1, -(-chars // TASK_CHARS)), "path", "conv_id").sortWithinPartitions("path", "conv_id")
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, pack, id_type = tokens_of(tokenizer), None, None

        def row() -> pa.RecordBatch:
            leaf = pa.struct([("conv_id", id_type), ("node", pa.int32())])
            flat = (np.concatenate(x) if x else np.empty(0, np.int32) for x in (pack.ids, pack.positions))
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in flat]
            lists += [pa.array([v], t) for v, t in zip((pack.loss, pack.nodes, pack.leaves), [*PACK_TYPE.types[2:], pa.list_(leaf)])]
            return pa.RecordBatch.from_arrays(lists, [*PACK_TYPE.names, "leaves"])

        for batch in batches:
            id_type = batch.column("conv_id").type
            for conv_id, said in zip(batch.column("conv_id").to_pylist(), batch.column("turns").to_pylist()):
                if pack is not None and pack.size >= pack_tokens:
                    yield row()
                    pack = None
                pack = pack or Pack(coder)
                pack.add(conv_id, [(t["role"], t["text"]) for t in said])
        if pack is not None:
            yield row()

    return ordered.select("conv_id", "turns").mapInArrow(run, PACK_DDL.format(id=kind))


def read_back(packs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """What the packs hold of each conversation, read from their tokens alone.

    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars): a conversation's tokens are those that its
    last node attends to; its turns are parsed from their text, and its loss text from the tokens in the loss spans.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens_of(tokenizer)
        for batch in batches:
            rows, kinds = [], [batch.schema.field("leaves").type.value_type.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            for k in range(batch.num_rows):
                ids = batch.column("input_ids")[k].values.to_numpy()
                losses, nodes, leaves = (batch.column(c)[k].as_py() for c in ("loss_spans", "nodes", "leaves"))
                texts = [coder.decode(ids[n["start"] : n["end"]]) for n in nodes]
                turns_of = [read_turn(t) for t in texts]
                starts = {n["start"]: i for i, n in enumerate(nodes)}
                owner = {i: unescape(coder.decode(ids[lo:hi])) for (lo, hi) in losses for i in [_node_of(nodes, lo)]}
                for leaf in leaves:
                    path = []
                    if leaf["node"] is not None:
                        for lo, hi in nodes[leaf["node"]]["attends"]:
                            while lo < hi:
                                path.append(starts[lo])
                                lo = nodes[path[-1]]["end"]
                    turns = [turns_of[i] for i in path]
                    loss = "".join(owner[i] for i in path if i in owner)
                    said = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                    rows.append((leaf["conv_id"], len(turns), said, len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len(texts[i]) for i in path)))
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(6)], names)

    kind = packs.schema["leaves"].dataType.elementType["conv_id"].dataType.simpleString()
    return packs.select("input_ids", "loss_spans", "nodes", "leaves").mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _node_of(nodes: list[dict], at: int) -> int:
    """The node whose tokens hold place ``at``; nodes stand by their start. An empty loss span may end its node's text only."""
    lo, hi = 0, len(nodes)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if nodes[mid]["start"] <= at else (lo, mid)
    return lo
