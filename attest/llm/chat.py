"""Chat formatting as prefix trees: conversations that share initial turns share their formatted tokens.

A turn is formatted as START role SEP text END. Inside roles and texts every backslash is doubled and every control
string is broken by a backslash after its first character, so that no text can open or close a turn; reading undoes it.

Conversations are ordered by the chain of hashes of their turns, so that those with the same beginning stand together,
and dealt by ranges of (chain, conv_id): a first turn, or a whole conversation, that a third of all rows share is split
over tasks. Each task cuts its run into packs of about PACK_CHARS characters. A pack is one prefix tree, emitted
depth-first: each node (a turn in its context) once, with its place, its position id (the place it has in its own
conversation; shared by siblings) and its ancestors. The tokens of a node attend to those of its ancestors' intervals
and, causally, to their own. Tokens are code points unless `tokenizer` names a tokenizer file.

Defined results: turns with equal numbers are ordered by role, then text; a null turn number comes first; null roles and
texts are empty; rows with a null conv_id are one conversation; an empty table gives no packs; further columns are not
read. A conversation is formatted whole in one task; one longer than PACK_CHARS is a pack of its own with others' shared
turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACK_CHARS = 1 << 17
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROL = (START, SEP, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_HIDE = re.compile("|".join(map(re.escape, ("\\", *CONTROL))))
_SHOW = re.compile(r"\\(\\?)")

PACK = "text string, nodes array<struct<start:int,length:int,position:int,depth:int,parent:int,loss_start:int,loss_length:int,tokens:int>>, leaves array<struct<conv_id:long,node:int>>"


def hide(text: str) -> str:
    """The text without control strings in it."""
    return _HIDE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def show(text: str) -> str:
    """What hide() was given."""
    return _SHOW.sub(lambda m: m[1], text)


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each conversation the chain of its turns' hashes, each of 8 bytes over all turns so far."""
    for batch in batches:
        out = []
        for turns in batch.column("turns").to_pylist():
            h, chain = hashlib.blake2b(digest_size=8), []
            for t in turns:
                for part in ((t["role"] or ""), (t["text"] or "")):
                    raw = part.encode()
                    h.update(len(raw).to_bytes(8, "little") + raw)
                chain.append(h.digest())
            out.append(b"".join(chain))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turns"), pa.array(out, pa.binary())], names=["conv_id", "turns", "chain"])


class _Pack:
    """One prefix tree under construction. Conversations come in chain order, so a new branch leaves the last path only."""

    def __init__(self, count):
        self.parts: list[str] = []
        self.nodes: list[dict] = []
        self.leaves: list[dict] = []
        self.size, self.path, self.count = 0, [], count

    def add(self, conv_id, turns: list[dict], chain: list[bytes]) -> None:
        shared = 0
        while shared < min(len(self.path), len(chain)) and self.path[shared][0] == chain[shared]:
            shared += 1
        del self.path[shared:]
        for turn, h in zip(turns[shared:], chain[shared:], strict=True):
            parent = self.path[-1][1] if self.path else -1
            head = START + hide(turn["role"] or "") + SEP
            body = hide(turn["text"] or "")
            whole = head + body + END
            above = self.nodes[parent] if parent >= 0 else None
            learn = (turn["role"] or "") == "assistant"
            self.nodes.append({"start": self.size, "length": len(whole), "position": above["position"] + above["tokens"] if above else 0, "depth": len(self.path), "parent": parent, "loss_start": self.size + len(head) if learn else 0, "loss_length": len(body) if learn else 0, "tokens": self.count(whole)})
            self.parts.append(whole)
            self.size += len(whole)
            self.path.append((h, len(self.nodes) - 1))
        self.leaves.append({"conv_id": conv_id, "node": self.path[-1][1] if self.path else -1})

    def row(self) -> dict:
        return {"text": "".join(self.parts), "nodes": self.nodes, "leaves": self.leaves}


def _packs(pack_chars: int, tokenizer: str | None):
    kinds = pa.schema([("text", pa.string()), ("nodes", pa.list_(pa.struct([(x, pa.int32()) for x in ("start", "length", "position", "depth", "parent", "loss_start", "loss_length", "tokens")]))), ("leaves", pa.list_(pa.struct([("conv_id", pa.int64()), ("node", pa.int32())])))])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = len
        if tokenizer:
            from tokenizers import Tokenizer

            known = Tokenizer.from_file(tokenizer)
            count = lambda s: len(known.encode(s, add_special_tokens=False).ids)
        pack = _Pack(count)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                chain = row.column("chain")[0].as_py()
                pack.add(row.column("conv_id")[0].as_py(), row.column("turns")[0].as_py(), [chain[k : k + 8] for k in range(0, len(chain), 8)])
                if pack.size + 16 * len(pack.leaves) >= pack_chars:
                    yield pa.RecordBatch.from_pylist([pack.row()], schema=kinds)
                    pack = _Pack(count)
        if pack.leaves:
            yield pa.RecordBatch.from_pylist([pack.row()], schema=kinds)

    return of


def pack(conversations: DataFrame, pack_chars: int = PACK_CHARS, tokenizer: str | None = None) -> DataFrame:
    """Packs: text, nodes (start, length, position, depth, parent, loss span, tokens) and leaves (conv_id, node)."""
    spark = conversations.sparkSession
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    whole = conversations.groupBy("conv_id").agg(turns.alias("sorted")).select("conv_id", F.transform("sorted", lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))).alias("turns"))
    chained = whole.mapInArrow(_chains, "conv_id long, turns array<struct<role:string,text:string>>, chain binary")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = chained.repartitionByRange(n, "chain", "conv_id").sortWithinPartitions("chain", "conv_id")
    return dealt.mapInArrow(_packs(pack_chars, tokenizer), PACK)


def attention(packs: DataFrame) -> DataFrame:
    """For each node of each pack: start, length, first position id, and the intervals of its ancestors in the emitted text, root first."""

    def of(batches):
        for batch in batches:
            rows = []
            for nodes in batch.column("nodes").to_pylist():
                seen: list[list] = []
                for x in nodes:
                    above = seen[x["parent"]] + [{"start": nodes[x["parent"]]["start"], "end": nodes[x["parent"]]["start"] + nodes[x["parent"]]["length"]}] if x["parent"] >= 0 else []
                    seen.append(above)
                    rows.append({"start": x["start"], "length": x["length"], "position": x["position"], "ancestors": above})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("start", pa.int32()), ("length", pa.int32()), ("position", pa.int32()), ("ancestors", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]))

    return packs.mapInArrow(of, "start int, length int, position int, ancestors array<struct<start:int,end:int>>")


def read(packs: DataFrame) -> DataFrame:
    """Each conversation read back from the packs alone: digests of its turns, of what is under its loss mask, and its formatted length."""
    kinds = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def of(batches):
        for batch in batches:
            for text, nodes, leaves in zip(*(batch.column(c).to_pylist() for c in ("text", "nodes", "leaves")), strict=True):
                rows = []
                for leaf in leaves:
                    path, at = [], leaf["node"]
                    while at >= 0:
                        path.append(nodes[at])
                        at = nodes[at]["parent"]
                    path.reverse()
                    formatted = "".join(text[x["start"] : x["start"] + x["length"]] for x in path)
                    turns, loss, learnt = hashlib.sha256(), hashlib.sha256(), 0
                    parts = formatted.split(START)[1:]
                    for part in parts:
                        role, _, body = part.partition(SEP)
                        turns.update(f"{show(role)}\n{show(body.removesuffix(END))}\n".encode())
                    for x in path:
                        own = show(text[x["loss_start"] : x["loss_start"] + x["loss_length"]])
                        learnt += len(own)
                        loss.update(own.encode())
                    rows.append({"conv_id": leaf["conv_id"], "n_turns": len(parts), "turns_sha256": turns.hexdigest(), "loss_chars": learnt, "loss_sha256": loss.hexdigest(), "formatted_chars": len(formatted)})
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return packs.mapInArrow(of, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op2_chat_formatting(spark, sf_dir: str) -> DataFrame:
    from .store import table

    extra = spark.sql("SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    return read(pack(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)))
