"""Chat formatting over prefix trees.

Conversations that begin with the same turns share those turns' tokens. Sorted
by their paths (the chain of turn hashes), conversations lie in depth-first
order of the tree; each range of that order is cut into packs, and a pack
emits every turn once. A turn's position ids go on from its parent's, and its
ancestors are given as intervals of the pack's tokens, so attention sees the
path to the root and nothing else.

A pack must hold what its tokens attend to. So a tree of more than ``tokens``
tokens is cut between two conversations, and the turns that both sides share are
emitted again; these are marked ``again``, so that a trainer can give them no
weight. With ``tokens=None`` no tree is cut: each shared turn is emitted exactly
once in the whole output, for as much memory as the largest tree needs.

Template: ``[INST:role]`` text ``[/INST:role]`` with one blank inside either
mark and a line feed after the last. Inside texts every such mark, and every
other control string below, gets one more backslash in front of it; taking it
away gives the text back. The blanks keep a text's own backslashes apart from
the marks of the template.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens after which a pack is closed, at the end of a conversation.
PACK_TOKENS = 1 << 18
#: Strings that a reader of the output may take for marks.
CONTROL = r"\[/?INST(?::[^\]\n]*)?\]|\[/?SYS\]|<</?SYS>>|</?s>|<\|[a-z_]{1,20}\|>"
_ESCAPE = re.compile(rf"(\\*)({CONTROL})")
_OPEN = re.compile(r"\[INST:([^\]\n]*)\] ")
_MARK = re.compile(rf"(\\*)({CONTROL})")


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0][1:] if m[1] else m[0], text)


def _role(role: str) -> str:
    """Roles with ``%``, ``]`` or line feeds are written in percent form."""
    return role.replace("%", "%25").replace("]", "%5D").replace("\n", "%0A")


def _unrole(role: str) -> str:
    return role.replace("%0A", "\n").replace("%5D", "]").replace("%25", "%")


def segments(role: str, text: str) -> tuple[str, str, str]:
    """What comes before the text, the escaped text, what comes after."""
    return f"[INST:{_role(role)}] ", escape(text), f" [/INST:{_role(role)}]\n"


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        m = _OPEN.match(formatted, at)
        if not m:
            raise ValueError("no turn begins here")
        for e in _MARK.finditer(formatted, m.end()):
            if not e[1] and e[2] == f"[/INST:{m[1]}]" and formatted[e.start() - 1] == " " and formatted[e.end() : e.end() + 1] == "\n":
                break
        else:
            raise ValueError("a turn has no end")
        turns.append((_unrole(m[1]), unescape(formatted[m.end() : e.start() - 1])))
        at = e.end() + 1
    return turns


def encoding(path: str):
    """Byte-level BPE: decoding gives exactly the bytes that were encoded."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


PACKED = (
    "pack long, tokens array<int>, loss array<boolean>, positions array<int>, "
    "nodes array<struct<parent:int,role:string,first:int,text_first:int,text_end:int,end:int,again:boolean,ancestors:array<struct<first:int,end:int>>>>, "
    "leaves array<struct<conv_id:long,node:int,n_turns:int>>"
)


def _packs(vocabulary: str, tokens: int | None):
    def run(batches):
        from .common import partition_uid

        enc, take, state, last = encoding(vocabulary), partition_uid(), _Pack(), []
        for batch in batches:
            for conv_id, path, turns in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "path", "turns")), strict=True):
                new_tree = not (path and last and path[0] == last[0])
                if state.leaves and (len(state.tokens) >= PACK_TOKENS and new_tree if tokens is None else len(state.tokens) >= tokens):
                    yield state.row(int(take(1)[0]))
                    state = _Pack()
                shared = 0
                while shared < min(len(path), len(last)) and path[shared] == last[shared]:
                    shared += 1
                state.add(conv_id, path, turns, enc, shared)
                last = path
        if state.leaves:
            yield state.row(int(take(1)[0]))

    return run


class _Pack:
    def __init__(self) -> None:
        self.tokens: list[int] = []
        self.loss: list[bool] = []
        self.positions: list[int] = []
        self.nodes: list[dict] = []
        self.leaves: list[dict] = []
        self.stack: list[tuple[str, int, int]] = []  # (path hash, node, positions used up to its end)

    def add(self, conv_id: int | None, path: list[str], turns: list[dict], enc, shared: int = 0) -> None:
        """``shared``: turns that the conversation before, in this pack or the last one, has too."""
        depth = 0
        while depth < len(self.stack) and depth < len(path) and self.stack[depth][0] == path[depth]:
            depth += 1
        del self.stack[depth:]
        for key, turn in zip(path[depth:], turns[depth:], strict=True):
            parent, at = self.stack[-1][1:] if self.stack else (-1, 0)
            first, marks = len(self.tokens), [len(self.tokens)]
            for k, part in enumerate(segments(turn["role"], turn["text"])):
                ids = enc.encode_ordinary(part)
                self.tokens += ids
                self.loss += [k == 1 and turn["role"] == "assistant"] * len(ids)
                marks.append(len(self.tokens))
            self.positions += range(at, at + marks[3] - first)
            above = [] if parent < 0 else [*self.nodes[parent]["ancestors"], {"first": self.nodes[parent]["first"], "end": self.nodes[parent]["end"]}]
            if len(above) > 1 and above[-2]["end"] == above[-1]["first"]:  # neighbours in the pack are one interval
                above[-2:] = [{"first": above[-2]["first"], "end": above[-1]["end"]}]
            self.nodes.append({"parent": parent, "role": turn["role"], "first": first, "text_first": marks[1], "text_end": marks[2], "end": marks[3], "again": len(self.stack) < shared, "ancestors": above})
            self.stack.append((key, len(self.nodes) - 1, at + marks[3] - first))
        self.leaves.append({"conv_id": conv_id, "node": self.stack[-1][1] if path else -1, "n_turns": len(path)})

    def row(self, number: int) -> pa.RecordBatch:
        interval = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
        node = pa.struct([("parent", pa.int32()), ("role", pa.string()), ("first", pa.int32()), ("text_first", pa.int32()), ("text_end", pa.int32()), ("end", pa.int32()), ("again", pa.bool_()), ("ancestors", interval)])
        leaf = pa.struct([("conv_id", pa.int64()), ("node", pa.int32()), ("n_turns", pa.int32())])
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number], pa.int64()),
                pa.array([self.tokens], pa.list_(pa.int32())),
                pa.array([self.loss], pa.list_(pa.bool_())),
                pa.array([self.positions], pa.list_(pa.int32())),
                pa.array([self.nodes], pa.list_(node)),
                pa.array([self.leaves], pa.list_(leaf)),
            ],
            names=["pack", "tokens", "loss", "positions", "nodes", "leaves"],
        )


def _paths(batches):
    """One row for each conversation, from rows sorted by conversation and turn."""
    held: list = []
    now: object = _paths  # no conversation yet

    def row():
        key, path = "", []
        for t in held:
            key = hashlib.sha256(f"{key}\n{len(t['role'])}\n{t['role']}{t['text']}".encode()).hexdigest()[:32]
            path.append(key)
        return now, path, list(held)

    def batch_of(rows):
        turns = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.string())), pa.array([r[2] for r in rows], turns)], names=["conv_id", "path", "turns"])

    rows: list = []
    size = 0
    for batch in batches:
        for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if now is not _paths and conv_id != now:
                rows.append(row())
                held = []
                if size > 8 << 20:
                    yield batch_of(rows)
                    rows, size = [], 0
            now = conv_id
            size += len(text)
            held.append({"role": role, "text": text})
    if now is not _paths:
        rows.append(row())
        yield batch_of(rows)


def _alone(batches):
    """A conversation of one turn for each row."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield from _paths([batch.slice(i, 1)])


def chat_packs(conversations: DataFrame, vocabulary: str, tokens: int | None = PACK_TOKENS) -> DataFrame:
    """Packs of conversations with shared beginnings: see ``PACKED`` for the columns.

    ``conversations``: conv_id, turn, role, text, a row for each turn; other
    columns are ignored. Turns are ordered by turn, then role, then text, with
    nulls first; a null role or text is empty. A row without conv_id is a
    conversation by itself. Repeated rows are turns of their own, and equal
    conversations share all of theirs. ``loss`` marks the tokens of assistants'
    texts. ``ancestors`` of a node are the intervals of tokens, besides its own,
    that its tokens attend to; ``again`` marks a node that the pack before it in its partition
    holds as well. A pack is closed after ``tokens`` tokens; None: only between
    trees. An empty table gives no pack. One conversation, and the packs' last,
    is held in memory as a whole.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    form = "conv_id long, path array<string>, turns array<struct<role:string,text:string>>"
    whole = rows.where("conv_id IS NOT NULL").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    paths = whole.mapInArrow(_paths, form).unionByName(rows.where("conv_id IS NULL").select("conv_id", "role", "text").mapInArrow(_alone, form))
    if tokens is None:
        root = F.col("path")[0]
        ordered = paths.repartition(root).sortWithinPartitions("path", "conv_id")
    else:
        ordered = paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    return ordered.mapInArrow(_packs(vocabulary, tokens), PACKED)


def read_back(packs: DataFrame, vocabulary: str) -> DataFrame:
    """conv_id, formatted, turns (role, text), loss_texts: each conversation again, from tokens, intervals and mask alone."""

    def run(batches):
        enc = encoding(vocabulary)
        turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for batch in batches:
            for tokens, loss, nodes, leaves in zip(*(batch.column(c).to_pylist() for c in ("tokens", "loss", "nodes", "leaves")), strict=True):
                out: list[list] = [[], [], [], []]
                for leaf in leaves:
                    spans = []
                    if leaf["node"] >= 0:
                        node = nodes[leaf["node"]]
                        spans = [*((x["first"], x["end"]) for x in node["ancestors"]), (node["first"], node["end"])]
                    formatted = enc.decode_bytes([t for a, b in spans for t in tokens[a:b]]).decode()
                    masked, run_of = [], []
                    for a, b in spans:
                        for i in range(a, b):
                            if loss[i]:
                                run_of.append(tokens[i])
                            elif run_of:
                                masked.append(unescape(enc.decode_bytes(run_of).decode()))
                                run_of = []
                    for column, value in zip(out, (leaf["conv_id"], formatted, [{"role": r, "text": t} for r, t in parse(formatted)], masked), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], turn), pa.array(out[3], pa.list_(pa.string()))], names=["conv_id", "formatted", "turns", "loss_texts"])

    return packs.mapInArrow(run, "conv_id long, formatted string, turns array<struct<role:string,text:string>>, loss_texts array<string>")

