"""Chat formatting as a prefix tree: turns that conversations share are emitted once.

Conversations are dealt over shards by ranges of their path, the hashes of their turns from the
first on, and sorted by it: the order in which a depth-first walk of the prefix tree meets
them. A shard is then one walk: of each conversation only the turns after what it shares with
the one before are emitted, so every node of the tree comes once in a shard, and a shard begins
with the whole path of its first conversation and needs no other. Equal paths are ordered by
the conversation's id, so a hot first turn or conversation is shared out over shards.

A node's tokens continue its parent's: their position ids run on from ``position``, and they
attend to themselves and to the intervals ``attends`` of the shard's token stream, the nodes
above them; nodes that follow each other in the stream are one interval, so a conversation that shares
nothing has one however long it is. Only ``loss_from`` to ``loss_to`` (an assistant's text) bears loss.

The template is ``<|im_start|>role`` line end, text, ``<|im_end|>`` line end, with the two marks as
token ids of their own. In texts and roles every ``<``, any backslashes, ``|`` gets one backslash
more, and line ends in roles are spelled ``<\\n>``; undone on reading.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressmill.llm.common import materialize, table, text_or_empty
from pressmill.llm.tokens import BYTE_BPE, encoding, vocabulary_path

START, END = "<|im_start|>", "<|im_end|>"
#: Ids of the two marks, after the vocabulary's and its own special id.
START_ID, END_ID = 50257, 50258
ASSISTANT = "assistant"
CONTROL = f"{END}{START}assistant ok"

NODES = (
    "shard int, seq long, kind string, depth int, conv_id long, role string, tokens array<int>, start long, position long, "
    "attends array<struct<start: long, end: long>>, loss_from int, loss_to int"
)
_INTERVAL = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_SCHEMA = pa.schema([
    ("shard", pa.int32()), ("seq", pa.int64()), ("kind", pa.string()), ("depth", pa.int32()), ("conv_id", pa.int64()),
    ("role", pa.string()), ("tokens", pa.list_(pa.int32())), ("start", pa.int64()), ("position", pa.int64()),
    ("attends", pa.list_(_INTERVAL)), ("loss_from", pa.int32()), ("loss_to", pa.int32()),
])


def escape(text: str) -> str:
    """No control mark is left, and ``unescape`` gives the text back."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    """Also without line ends, which part a role from its text."""
    return escape(re.sub(r"<(\\*)n>", r"<\\\1n>", role).replace("\n", "<n>"))


def unescape_role(role: str) -> str:
    return re.sub(r"<\\(\\*)n>", r"<\1n>", unescape(role).replace("<n>", "\n"))


def format_turn(role: str, text: str, path: str | None = None) -> tuple[list[int], int, int]:
    """Token ids of a turn, and where in them its text begins and ends."""
    encode = encoding(path or vocabulary_path(BYTE_BPE)).encode_ordinary
    head, body = encode(escape_role(role) + "\n"), encode(escape(text))
    return [START_ID, *head, *body, END_ID, *encode("\n")], 1 + len(head), 1 + len(head) + len(body)


def decode_tokens(tokens: list[int], path: str | None = None) -> str:
    """Text of token ids, marks included."""
    own, out, at = encoding(path or vocabulary_path(BYTE_BPE)), [], 0
    for i, t in enumerate(tokens):
        if t in (START_ID, END_ID):
            out += [own.decode(tokens[at:i]), START if t == START_ID else END]
            at = i + 1
    return "".join([*out, own.decode(tokens[at:])])


@dataclass
class Node:
    turn: tuple[str, str]
    start: int
    tokens: int
    position: int
    attends: tuple[tuple[int, int], ...]

    def below(self) -> tuple[tuple[int, int], ...]:
        """What a child attends to."""
        end = self.start + self.tokens
        if self.attends and self.attends[-1][1] == self.start:
            return (*self.attends[:-1], (self.attends[-1][0], end))
        return (*self.attends, (self.start, end))


def conversations(rows: DataFrame) -> DataFrame:
    """``(conv_id, turns)``: the turns in order; ties of ``turn`` by role and text, nulls as empty."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), text_or_empty(F.col("role")).alias("role"), text_or_empty(F.col("text")).alias("text"))
    return rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def write_tree(rows: DataFrame, shards: int | None = None, vocabulary: str | None = None) -> DataFrame:
    """Writes the shards as a table in the shared folder; one row for each node and conversation.

    Rows of kind ``node`` hold a turn and what a trainer needs of it; rows of kind ``conv``
    follow the node that is their conversation's last turn. Input is ``(conv_id, turn, role,
    text)``; a conversation is one sequence and stays together; repeated turns are turns; a
    null ``conv_id`` is one conversation; other columns are ignored; an empty table gives no rows.
    """
    path = F.transform("turns", lambda t: F.xxhash64(t["role"], t["text"])).alias("path")
    dealt = conversations(rows).select("conv_id", "turns", path)
    dealt = dealt.repartitionByRange(*([shards] if shards else []), "path", "conv_id").sortWithinPartitions("path", "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, seq, end, stack, out = TaskContext.get().partitionId(), 0, 0, [], []
        for batch in batches:
            ids, all_turns = batch.column("conv_id"), batch.column("turns")
            for i in range(batch.num_rows):
                turns = [(t["role"], t["text"]) for t in all_turns[i].as_py()]
                shared = 0
                while shared < min(len(turns), len(stack)) and turns[shared] == stack[shared].turn:
                    shared += 1
                del stack[shared:]
                for depth in range(shared, len(turns)):
                    tokens, lo, hi = format_turn(*turns[depth], vocabulary)
                    position = stack[-1].position + stack[-1].tokens if stack else 0
                    attends = stack[-1].below() if stack else ()
                    stack.append(Node(turns[depth], end, len(tokens), position, attends))
                    role, loss = turns[depth][0], turns[depth][0] == ASSISTANT
                    out.append((shard, seq, "node", depth, None, role, tokens, end, position, [{"start": a, "end": b} for a, b in attends], lo if loss else None, hi if loss else None))
                    seq, end = seq + 1, end + len(tokens)
                out.append((shard, seq, "conv", len(turns), ids[i].as_py(), None, None, end, None, None, None, None))
                seq += 1
                if len(out) >= 500:
                    yield _batch(out)
                    out = []
        if out:
            yield _batch(out)

    return materialize(dealt.select("conv_id", "turns").mapInArrow(run, NODES), "chat")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def read_tree(tree: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)`` from the shards.

    A shard is read in order with the path of the last node in memory, which is what the
    next conversation is made of.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, stack = None, []
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                if r["shard"] != shard:
                    shard, stack = r["shard"], []
                del stack[r["depth"] :]
                if r["kind"] == "node":
                    tokens = r["tokens"]
                    text = decode_tokens(tokens, vocabulary)
                    head, _, body = text[len(START) :].partition("\n")
                    loss = None if r["loss_from"] is None else unescape(decode_tokens(tokens[r["loss_from"] : r["loss_to"]], vocabulary))
                    turn = f"{unescape_role(head)}\n{unescape(body[: -len(END) - 1])}\n"
                    stack.append((turn, loss, len(text)))
                else:
                    losses = "".join(x for _, x, _ in stack if x is not None)
                    found.append({
                        "conv_id": r["conv_id"], "n_turns": len(stack),
                        "turns_sha256": hashlib.sha256("".join(t for t, _, _ in stack).encode()).hexdigest(),
                        "loss_chars": len(losses), "loss_sha256": hashlib.sha256(losses.encode()).hexdigest(),
                        "formatted_chars": sum(n for _, _, n in stack),
                    })
            if found:
                yield pa.RecordBatch.from_pylist(found, schema)

    schema = pa.schema([
        ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
    ])
    rows = tree.select("shard", "seq", "kind", "depth", "conv_id", "tokens", "loss_from", "loss_to")
    rows = rows.repartition("shard").sortWithinPartitions("shard", "seq")
    return rows.mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"), F.lit(CONTROL).alias("text"),
    )
    return read_tree(write_tree(rows.unionByName(planted)))


_SQL_ESCAPED = "regexp_replace({}, '<(\\\\*)\\|', '<\\\\\\1|', 'g')"
_SQL_ROLE = _SQL_ESCAPED.format("replace(regexp_replace(role, '<(\\\\*)n>', '<\\\\\\1n>', 'g'), chr(10), '<n>')")
ORACLE_SQL = f"""with turns as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all
    select -1, t, case t when 0 then 'user' else '{ASSISTANT}' end, '{CONTROL}' from range(2) r(t))
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
    coalesce(sum(length(text)) filter (where role = '{ASSISTANT}'), 0)::bigint as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = '{ASSISTANT}'), '')) as loss_sha256,
    sum({len(START) + len(END) + 2} + length({_SQL_ROLE}) + length({_SQL_ESCAPED.format("text")}))::bigint as formatted_chars
from turns group by conv_id"""
