"""Chat formatting on a prefix tree.

Conversations that share their initial turns share the nodes of a tree. A tree is emitted depth-first as
one sequence: the tokens of a shared turn stand in it once, each node with the position its
tokens have in a conversation and with the intervals of the sequence that it attends to, which
are those of its ancestors (and, causally, itself). A token is one code point of the formatted text.

A node under which more than `max_conversations` different conversations stand, or more than `max_bytes` of them, is heavy.
The conversations below it are dealt by their next turn into packs of about that size, so that a first turn
which a third of all conversations share never gathers in one task; its tokens then stand once in each
such pack. Conversations equal in all turns are formatted once, with their ids beside.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialens.llm.runtime import col, map_arrow, within_rows, written

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Openings of control strings in common chat templates; none is left bare in a text.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
MAX_CONVERSATIONS = 256
#: Bytes of different conversations that a pack holds, unless one alone has more.
MAX_BYTES = 16_000_000
#: Characters of formatted text in a batch of results.
BLOCK_CHARS = 2_000_000
LEARNED_ROLE = "assistant"

_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """Breaks control strings with a backslash after their first character; backslashes are doubled."""
    text = text.replace("\\", "\\\\")
    for c in CONTROLS:
        text = text.replace(c, c[0] + "\\" + c[1:])
    return text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where in it the loss mask starts and ends (equal: no loss)."""
    head = TURN + escape(role) + TEXT
    body = escape(text)
    start = len(head)
    return head + body + END, start, start + len(body) if role == LEARNED_ROLE else start


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation; no marker stands bare inside a role or text."""
    heads = (piece[len(TURN) :].partition(TEXT) for piece in formatted.split(END)[:-1])
    return [(unescape(role), unescape(text)) for role, _, text in heads]


def build_pack(conversations: list[tuple[str, list[tuple[str, str]]]]) -> dict:
    """One depth-first sequence of (key, turns) conversations: text, nodes, ends.

    nodes: (parent, start, end, position, loss_start, loss_end, context), in the order of emission;
    context has the merged intervals of the ancestors. ends: (key, last node) of each conversation.
    """
    children: list[dict] = [{}]
    stops: list[list[str]] = [[]]
    for key, turns in sorted(conversations):
        at = 0
        for turn in turns:
            if turn not in children[at]:
                children[at][turn] = len(children)
                children.append({})
                stops.append([])
            at = children[at][turn]
        stops[at].append(key)
    text, nodes, ends, offset = [], [], [], 0
    todo = [(child, turn, -1, 0, ()) for turn, child in reversed(children[0].items())]
    while todo:
        at, (role, said), parent, position, context = todo.pop()
        piece, loss_start, loss_end = format_turn(role, said)
        start, end, me = offset, offset + len(piece), len(nodes)
        text.append(piece)
        offset = end
        nodes.append((parent, start, end, position, start + loss_start, start + loss_end, context))
        ends += [(key, me) for key in stops[at]]
        seen = (*context[:-1], (context[-1][0], end)) if context and context[-1][1] == start else (*context, (start, end))
        todo += [(child, turn, me, position + len(piece), seen) for turn, child in reversed(children[at].items())]
    return {"text": "".join(text), "nodes": nodes, "ends": ends}


NODE = "struct<parent:int,start:bigint,end:bigint,position:bigint,loss_start:bigint,loss_end:bigint,context:array<struct<start:bigint,end:bigint>>>"
PACK = f"pack string, text string, nodes array<{NODE}>, ends array<struct<conversation:string,node:int>>"


def conversations_of(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, conversation (key), prefixes, size (bytes), turns: a row for each conversation.

    Rows go by turn, then role and text, nulls first; repeated rows are turns of their own; null roles and texts are empty;
    rows with a null conv_id make one conversation. A prefix's key is a chain of MD5 digests over its turns, so equal
    prefixes, and no others, have equal keys. Written once, so that later steps read only the columns they need.
    """
    said = F.struct(col(turn).alias("turn"), F.coalesce(col(role), F.lit("")).alias("role"), F.coalesce(col(text), F.lit("")).alias("text"))
    grouped = rows.select(col(conv_id).alias("conv_id"), said.alias("said")).groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("said"))
    grouped = grouped.select("conv_id", F.transform("said", lambda s: F.struct(s["role"].alias("role"), s["text"].alias("text"))).alias("turns"))
    kind = grouped.schema["conv_id"].dataType.simpleString()
    keyed = map_arrow(grouped, _chained, f"conv_id {kind}, conversation string, prefixes array<string>, size bigint, turns array<struct<role:string,text:string>>")
    return written(keyed, "conversations")


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of all prefixes, the last one first of all, and the bytes of (conv_id, turns); steps and space grow with the turns alone."""
    for batch in batches:
        turns = batch["turns"]
        offsets = np.asarray(turns.offsets)
        roles, texts = (turns.values.field(c).slice(offsets[0], offsets[-1] - offsets[0]).to_pylist() for c in ("role", "text"))
        starts = (offsets - offsets[0]).tolist()
        keys, last, sizes = [], [], []
        for low, high in zip(starts, starts[1:]):
            key, size = "", 0
            for role, text in zip(roles[low:high], texts[low:high], strict=True):
                said = f"{key}:{len(role)}:{role}:{text}".encode()
                size += len(said) - len(key) - len(str(len(role))) - 3
                key = hashlib.md5(said).hexdigest()
                keys.append(key)
            last.append(key)
            sizes.append(size)
        prefixes = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(keys, pa.string()))
        yield pa.RecordBatch.from_arrays([batch["conv_id"], pa.array(last, pa.string()), prefixes, pa.array(sizes, pa.int64()), turns], names=["conv_id", "conversation", "prefixes", "size", "turns"])


def packs_of(conversations: DataFrame, max_conversations: int = MAX_CONVERSATIONS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Packs (pack, text, nodes, ends) of conversations_of()'s rows; equal conversations count once.

    A prefix is heavy if more conversations than max_conversations, or several of more than max_bytes, share it.
    """
    once = conversations.select("conversation", "prefixes", "size").groupBy("conversation").agg(F.first("prefixes").alias("prefixes"), F.first("size").alias("size"))
    steps = once.select("conversation", "size", F.posexplode("prefixes").alias("depth", "prefix"))
    heavy = steps.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    parts = F.greatest(F.ceil(F.col("n") / F.lit(max_conversations)), F.least(F.col("n"), F.ceil(F.col("bytes") / F.lit(max_bytes)))).cast("bigint")
    # written, so that Spark shuffles it anew and can split the conversations of a very common turn
    heavy = written(heavy.filter((F.col("n") > max_conversations) | ((F.col("bytes") > max_bytes) & (F.col("n") > 1))).select("prefix", parts.alias("parts")), "heavy")
    deepest = steps.join(_small(heavy), "prefix").groupBy("conversation").agg(F.max(F.struct("depth", "prefix", "parts")).alias("heavy"))
    deepest = written(deepest.withColumnRenamed("conversation", "h_conversation"), "deepest")
    both = conversations.join(_small(deepest), F.col("conversation") == F.col("h_conversation"), "left")
    following = F.coalesce(F.get("prefixes", F.col("heavy.depth") + 1), F.col("conversation"))
    bucket = F.pmod(F.xxhash64(following), F.col("heavy.parts"))
    pack = F.when(F.col("heavy").isNull(), F.get("prefixes", F.lit(0))).otherwise(F.concat_ws("#", F.col("heavy.prefix"), bucket))
    rows = map_arrow(both.select(pack.alias("pack"), "conversation", "turns"), _once_a_task, "pack string, conversation string, turns array<struct<role:string,text:string>>")
    return map_arrow(rows.repartition("pack").sortWithinPartitions("pack", "conversation"), _packed, PACK)


def _small(side: DataFrame) -> DataFrame:
    return F.broadcast(side) if within_rows(side) else side


def _once_a_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each conversation in a task, so that copies do not shuffle; those of other tasks meet in their pack."""
    seen: set[str] = set()
    for batch in batches:
        keys = batch.column(1).to_pylist()
        new = [k for k, c in enumerate(keys) if not (c in seen or seen.add(c))]
        yield batch if len(new) == len(keys) else batch.take(pa.array(new, pa.int64()))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs of (pack, conversation, turns) rows in the order of pack and conversation; several in a batch."""
    out, pack, last, held = _Packs(), None, None, []
    for batch in batches:
        turns = batch.column(2)
        ends, roles, texts = turns.offsets.to_pylist(), turns.values.field("role").to_pylist(), turns.values.field("text").to_pylist()
        for i, (name, key) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            if name != pack:
                if held:
                    out.add(pack, build_pack(held))
                    if out.chars > BLOCK_CHARS:
                        yield out.batch()
                        out = _Packs()
                pack, last, held = name, None, []
            if key != last:
                a, b = ends[i], ends[i + 1]
                held.append((key, list(zip(roles[a:b], texts[a:b], strict=True))))
                last = key
    if held:
        out.add(pack, build_pack(held))
    if out.names:
        yield out.batch()


class _Packs:
    """Columns of some packs."""

    def __init__(self):
        self.names, self.texts, self.nodes, self.ends = [], [], [], []
        self.node_ends, self.context_ends, self.contexts, self.conversation_ends = [0], [0], [], [0]
        self.chars = 0

    def add(self, name: str, pack: dict) -> None:
        self.names.append(name)
        self.texts.append(pack["text"])
        self.chars += len(pack["text"])
        self.nodes += pack["nodes"]
        self.node_ends.append(len(self.nodes))
        for node in pack["nodes"]:
            self.contexts += node[-1]
            self.context_ends.append(len(self.contexts))
        self.ends += pack["ends"]
        self.conversation_ends.append(len(self.ends))

    def batch(self) -> pa.RecordBatch:
        numbers = np.array([n[:-1] for n in self.nodes], np.int64).reshape(-1, 6)
        spans = np.array(self.contexts, np.int64).reshape(-1, 2)
        context = pa.ListArray.from_arrays(pa.array(self.context_ends, pa.int32()), pa.StructArray.from_arrays([pa.array(spans[:, 0]), pa.array(spans[:, 1])], ["start", "end"]))
        fields = [pa.array(numbers[:, 0].astype(np.int32)), *[pa.array(numbers[:, j]) for j in range(1, 6)], context]
        nodes = pa.StructArray.from_arrays(fields, ["parent", "start", "end", "position", "loss_start", "loss_end", "context"])
        ends = pa.StructArray.from_arrays([pa.array([k for k, _ in self.ends], pa.string()), pa.array([n for _, n in self.ends], pa.int32())], ["conversation", "node"])
        lists = [pa.ListArray.from_arrays(pa.array(o, pa.int32()), v) for o, v in ((self.node_ends, nodes), (self.conversation_ends, ends))]
        return pa.RecordBatch.from_arrays([pa.array(self.names, pa.string()), pa.array(self.texts, pa.string()), *lists], names=["pack", "text", "nodes", "ends"])


def read_back(packs: DataFrame) -> DataFrame:
    """conversation, formatted, loss (array of the texts under the mask, unescaped), turns: from packs alone."""
    return map_arrow(packs, _read, "conversation string, formatted string, loss array<string>, turns array<struct<role:string,text:string>>")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, chars = [], 0
    for batch in batches:
        nodes, ends = batch.column(2), batch.column(3)
        node_ends, end_ends = nodes.offsets.to_pylist(), ends.offsets.to_pylist()
        parent, start, end, position, loss_start, loss_end = (nodes.values.field(c).to_pylist() for c in ("parent", "start", "end", "position", "loss_start", "loss_end"))
        context = nodes.values.field("context")
        context_ends, opens, closes = context.offsets.to_pylist(), context.values.field("start").to_pylist(), context.values.field("end").to_pylist()
        keys, last = ends.values.field("conversation").to_pylist(), ends.values.field("node").to_pylist()
        for row, text in enumerate(batch.column(1).to_pylist()):
            base = node_ends[row]
            for e in range(end_ends[row], end_ends[row + 1]):
                n = base + last[e]
                formatted = "".join(text[opens[c] : closes[c]] for c in range(context_ends[n], context_ends[n + 1])) + text[start[n] : end[n]]
                loss, at = [], n
                while at >= base:
                    if parent[at] < 0 and position[at] != 0:
                        raise ValueError("a root does not start at position 0")
                    loss.append(unescape(text[loss_start[at] : loss_end[at]]))
                    at = base + parent[at] if parent[at] >= 0 else -1
                out.append((keys[e], formatted, loss[::-1], parse(formatted)))
                chars += len(formatted)
                if chars > BLOCK_CHARS:  # a shared beginning stands in each conversation here, so packs grow
                    yield _told(out)
                    out, chars = [], 0
    if out:
        yield _told(out)


def _told(rows: list) -> pa.RecordBatch:
    turns = [t for r in rows for t in r[3]]
    pairs = pa.StructArray.from_arrays([pa.array([t[j] for t in turns], pa.string()) for j in (0, 1)], ["role", "text"])
    ends = lambda j: pa.array(np.cumsum([0, *[len(r[j]) for r in rows]]).astype(np.int32))
    loss = pa.ListArray.from_arrays(ends(2), pa.array([x for r in rows for x in r[2]], pa.string()))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), loss, pa.ListArray.from_arrays(ends(3), pairs)], names=["conversation", "formatted", "loss", "turns"])


def digests(conversations: DataFrame, packs: DataFrame) -> DataFrame:
    """conv_id and the digests of what its formatted conversation says when read back."""
    back = read_back(packs)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    lost = F.array_join("loss", "")
    back = back.select(
        F.col("conversation").alias("b_conversation"),
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(lost).cast("bigint").alias("loss_chars"),
        F.sha2(lost, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
    both = conversations.select("conv_id", "conversation").join(back, F.col("conversation") == F.col("b_conversation"))
    return both.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def format_chats(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", max_conversations: int = MAX_CONVERSATIONS) -> tuple[DataFrame, DataFrame]:
    """(conversations, packs). Empty tables give empty results; other columns do not matter."""
    conversations = conversations_of(rows, conv_id, turn, role, text)
    return conversations, packs_of(conversations, max_conversations)
