"""Chat formatting as prefix trees: shared initial turns are emitted once, depth first.

Every distinct sequence of initial turns is a node. Nodes are laid out depth first in one
stream of token ids; of each node the stream keeps where it starts (`seq_start`), the position
id of its first token (`position`: the number of tokens of its ancestors) and `attend_to`, the
end of its subtree. A token is visible to exactly the later stream places before its node's
`attend_to`; so the intervals [seq_start, attend_to) that hold a token are those of its
ancestors and itself, and a conversation sees its own turns only.

How it is spread: one pass over the turns of each conversation, in order, names the nodes by
a running digest. Distinct conversations are put in order by their turns' digests, which is
depth-first order: a node belongs to the first conversation that has it, and its subtree ends
with the last. So no tree, however large, meets in one task; a conversation streams through one.

Template: `<|role|>role<|text|>text<|end|>`, the three marks being control ids above the
vocabulary. In roles and texts a backslash is doubled, and one is put inside every control
string, so none of them is left; taking out one backslash before each character reverses it.

Defined results: a null text or role is empty; turns are ordered by turn (null first), role,
text; repeated rows are turns of their own; rows without a conv_id form one conversation;
other columns are not read; an empty table gives an empty stream.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newswatch.llm.common import running_offsets, text_of, written

# Strings that the template or other chat templates give a meaning.
CONTROLS = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
MARKS = ("<|role|>", "<|text|>", "<|end|>")

TURNS = (
    "conv_id long, depth int, node binary, parent binary, role string, ids binary, n_tokens long, position long, "
    "loss_from int, loss_to int, n_turns long, path binary"
)
READ = "leaf binary, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _pattern(controls: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in controls))


def escape(text: str, controls: tuple[str, ...] = CONTROLS) -> str:
    """`text` without any control string."""
    return _pattern(controls).sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


class Codec:
    """Ids of turns and back, by a byte-level tokenizer whose pieces join without loss."""

    def __init__(self, path: str, controls: tuple[str, ...]):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        first = self.tokenizer.get_vocab_size()
        self.role, self.text, self.end = first, first + 1, first + 2
        self.controls = controls
        self.decode = lru_cache(1024)(self._decode)

    def encode(self, roles: list[str], texts: list[str]) -> list[tuple[np.ndarray, int, int]]:
        """Per turn: its ids, and where the text's ids begin and end in them."""
        encode = self.tokenizer.encode_batch_fast
        role_ids = {r: encode([escape(r, self.controls)], add_special_tokens=False)[0].ids for r in set(roles)}
        different = {t: k for k, t in enumerate(dict.fromkeys(texts))}
        text_ids = [e.ids for e in encode([escape(t, self.controls) for t in different], add_special_tokens=False)]
        out = []
        for role, text in zip(roles, texts, strict=True):
            head, body = role_ids[role], text_ids[different[text]]
            ids = np.array([self.role, *head, self.text, *body, self.end], "<u4")
            out.append((ids, len(head) + 2, len(head) + 2 + len(body)))
        return out

    def _decode(self, raw: bytes, low: int, high: int) -> tuple[str, str, str, int]:
        """Role, text, text under the mask (all unescaped) and length of the formatted turn."""
        ids = np.frombuffer(raw, "<u4")
        cut = int(np.flatnonzero(ids == self.text)[0])
        if ids[0] != self.role or ids[-1] != self.end:
            raise ValueError("a turn without its marks")
        strings = self.tokenizer.decode_batch(
            [ids[1:cut].tolist(), ids[cut + 1 : -1].tolist(), ids[low:high].tolist()], skip_special_tokens=False
        )
        role, text, loss = map(unescape, strings)
        return role, text, loss, sum(map(len, MARKS)) + len(strings[0]) + len(strings[1])


@dataclass
class ChatStream:
    """The emitted stream and what is needed to find a conversation in it.

    nodes: node, parent, depth, role, seq_start, n_tokens, position, attend_to, loss_from,
    loss_to, ids; in order of seq_start. paths: leaf, depth, node, one row per turn of a distinct
    conversation. conversations: conv_id, leaf, n_turns.
    """

    nodes: DataFrame
    paths: DataFrame
    conversations: DataFrame


def format_conversations(
    turns: DataFrame, tokenizer: str, loss_role: str = "assistant", controls: tuple[str, ...] = CONTROLS
) -> ChatStream:
    """Lay out `turns` (conv_id, turn, role, text) as prefix trees; texts of `loss_role` are under the loss mask."""
    spark = turns.sparkSession

    def chain(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(tokenizer, controls)
        names = ["conv_id", "depth", "node", "parent", "role", "ids", "n_tokens", "position", "loss_from", "loss_to", "n_turns", "path"]
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
        pending: tuple | None = None  # the last turn, kept until it is known to end its conversation
        path = bytearray()
        for batch in rows:
            if not batch.num_rows:
                continue
            convs, roles, texts = (batch.column(k).to_pylist() for k in (0, 1, 2))
            out = []
            for conv, role, (ids, low, high) in zip(convs, roles, codec.encode(roles, texts), strict=True):
                own = hashlib.sha256(ids.tobytes()).digest()
                if pending and pending[0] == conv:
                    depth, parent, position = pending[1] + 1, pending[2], pending[7] + pending[6]
                    out.append((*pending, None, None))
                else:
                    if pending:
                        out.append((*pending, pending[1] + 1, bytes(path)))
                    depth, parent, position = 0, b"", 0
                    path.clear()
                path += own[:16]
                node = hashlib.sha256(parent + own).digest()
                mask = (low, high) if role == loss_role else (0, 0)
                pending = (conv, depth, node, parent, role, ids.tobytes(), len(ids), position, *mask)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
        if pending:
            last = (*pending, pending[1] + 1, bytes(path))
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(last, kinds, strict=True)], names)

    ordered = (
        turns.select(F.col("conv_id").cast("long"), "turn", text_of("role").alias("role"), text_of("text").alias("text"))
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text")
    )
    chained = written(ordered.mapInArrow(chain, TURNS), "chat-turns")
    ends = chained.filter("path IS NOT NULL").select("conv_id", F.col("node").alias("leaf"), "n_turns", "path")

    # Distinct conversations in the order of their turns. The order is written, so it stays as it is.
    distinct = ends.groupBy("leaf").agg(F.first("path").alias("path"), F.min(F.struct("conv_id")).alias("shown"))
    leaves = written(
        distinct.repartitionByRange("path")
        .sortWithinPartitions("path")
        .select("leaf", F.col("shown.conv_id").alias("conv_id"), F.monotonically_increasing_id().alias("place")),
        "chat-leaves",
    )
    member = chained.alias("c").join(leaves.alias("l"), F.expr("c.conv_id <=> l.conv_id"))
    member = written(member.select("l.leaf", "l.place", "c.depth", "c.node", "c.n_tokens"), "chat-paths")

    # A node belongs to the first conversation that has it; its subtree ends with the last.
    spans = member.groupBy("node").agg(
        F.min("place").alias("first"), F.max("place").alias("last"), F.min("depth").alias("depth"), F.min("n_tokens").alias("n_tokens")
    )
    spans = written(spans, "chat-spans")
    part = F.shiftright("place", 33)  # the partition of the sorted conversations
    owned = spans.groupBy(F.col("first").alias("place")).agg(F.sum("n_tokens").alias("total")).withColumn("part", part)
    parts = running_offsets(spark, owned.groupBy("part").agg(F.sum("total").alias("total")), ["part"], "total", "base")
    within = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(
        owned.join(parts.select("part", "base"), "part").select(
            "place", (F.col("base") + F.coalesce(F.sum("total").over(within), F.lit(0))).alias("start"), "total"
        ),
        "chat-starts",
    )
    along = Window.partitionBy("first").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    placed = spans.join(starts.select(F.col("place").alias("first"), "start"), "first").select(
        "node", "last", (F.col("start") + F.coalesce(F.sum("n_tokens").over(along), F.lit(0))).alias("seq_start")
    )
    placed = placed.join(
        starts.select(F.col("place").alias("last"), (F.col("start") + F.col("total")).alias("attend_to")), "last"
    ).drop("last")
    content = chained.groupBy("node").agg(
        *(F.first(c).alias(c) for c in ("parent", "depth", "role", "n_tokens", "position", "loss_from", "loss_to", "ids"))
    )
    nodes = content.join(placed, "node").select(
        "node", "parent", "depth", "role", "seq_start", "n_tokens", "position", "attend_to", "loss_from", "loss_to", "ids"
    )
    nodes = written(nodes.repartitionByRange("seq_start").sortWithinPartitions("seq_start"), "chat-nodes")
    return ChatStream(nodes, member.select("leaf", "depth", "node"), ends.select("conv_id", "leaf", "n_turns"))


def read_conversations(stream: ChatStream, tokenizer: str, controls: tuple[str, ...] = CONTROLS) -> DataFrame:
    """One row per conversation, read back from the stream: digests of its turns and of its masked text."""

    def digest(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(tokenizer, controls)
        leaf, state = None, None

        def row() -> pa.RecordBatch:
            n, turns, loss_chars, loss, chars = state
            values = [[leaf], [n], [turns.hexdigest()], [loss_chars], [loss.hexdigest()], [chars]]
            kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(values, kinds, strict=True)],
                ["leaf", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

        for batch in rows:
            for r in batch.to_pylist():
                if r["leaf"] != leaf:
                    if state:
                        yield row()
                    leaf, state = r["leaf"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text, loss, chars = codec.decode(r["ids"], r["loss_from"], r["loss_to"])
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += chars
        if state:
            yield row()

    turns = stream.paths.join(stream.nodes.select("node", "ids", "loss_from", "loss_to"), "node")
    turns = turns.select("leaf", "depth", "ids", "loss_from", "loss_to").repartition("leaf").sortWithinPartitions("leaf", "depth")
    read = turns.mapInArrow(digest, READ)
    return stream.conversations.select("conv_id", "leaf").join(read, "leaf").drop("leaf")
