"""Chat formatting at token level.

Every turn becomes <start> role newline text <end> newline. Roles and texts are encoded on their own, as ordinary text,
and the control tokens are spliced in as reserved ids above the vocabulary, so no text can produce one. The loss mask
covers the tokens of assistant texts; it follows from the prefix sums of the segments' lengths. Control strings inside
roles and texts are escaped before they are encoded, so the rendered text is as unambiguous as the tokens: a backslash
is put before the name, `<|im_end|>` becoming `<|\\im_end|>`, one more where there are some already.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "byte_bpe_50k.json"
#: Reserved ids stand above the tokenizer's 50,257.
START, END = 50_300, 50_301
CONTROL = {START: "<|im_start|>", END: "<|im_end|>"}
_PLAIN = re.compile(r"<\|(\\*)(im_start|im_end)\|>")
_ESCAPED = re.compile(r"<\|\\(\\*)(im_start|im_end)\|>")

TURN = "conv_id long, turn long, role string, ids array<int>, role_tokens int, text_tokens int"


def escape(text: str) -> str:
    return _PLAIN.sub(r"<|\\\1\2|>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<|\1\2|>", text)


@lru_cache(maxsize=2)
def _tokenizer(file: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(file))
    t.encode_special_tokens = True  # their strings in a text are ordinary text
    return t


def encode_turns(turns: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(conv_id, turn, role, ids, role_tokens, text_tokens): the tokens of every turn, each turn on its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(tokenizer)
        newline = t.encode("\n", add_special_tokens=False).ids
        heads: dict[str, list[int]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                roles, texts = ([x or "" for x in part.column(c).to_pylist()] for c in ("role", "text"))
                bodies = [e.ids for e in t.encode_batch([escape(x) for x in texts], add_special_tokens=False)]
                for role in set(roles) - heads.keys():
                    heads[role] = t.encode(escape(role), add_special_tokens=False).ids
                ids = [[START, *heads[r], *newline, *b, END, *newline] for r, b in zip(roles, bodies, strict=True)]
                counts = [pa.array([len(heads[r]) for r in roles], pa.int32()), pa.array([len(b) for b in bodies], pa.int32())]
                if len(heads) > 10_000:
                    heads.clear()
                yield pa.RecordBatch.from_arrays(
                    [part.column("conv_id"), part.column("turn"), part.column("role"), pa.array(ids, pa.list_(pa.int32())), *counts],
                    ["conv_id", "turn", "role", "ids", "role_tokens", "text_tokens"],
                )

    columns = [F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")]
    return turns.select(*columns).mapInArrow(run, TURN)


def loss_spans(role_tokens: np.ndarray, text_tokens: np.ndarray, assistant: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last+1 token, within a conversation, of each assistant text, from prefix sums over the turns' segments."""
    lengths = np.stack([np.ones_like(role_tokens), role_tokens, np.ones_like(role_tokens), text_tokens, np.full_like(role_tokens, 2)], 1)
    ends = np.cumsum(lengths.reshape(-1)).reshape(-1, 5)
    return ends[assistant, 2], ends[assistant, 3]


def ordered_turns(encoded: DataFrame) -> DataFrame:
    """Turns of a conversation one after the other in a partition, by turn, role and tokens; null turns first."""
    keys = ["conv_id", "turn", "role", "ids"]
    return encoded.repartition("conv_id").sortWithinPartitions(*keys)


class _Reader:
    """Reads a conversation back from its tokens and mask, turn by turn, holding one turn at a time."""

    def __init__(self, conv_id, decode):
        self.conv_id, self.decode, self.turns, self.chars, self.loss_chars = conv_id, decode, 0, 0, 0
        self.whole, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, ids: np.ndarray, mask: np.ndarray) -> None:
        marks = np.flatnonzero(ids >= START)
        if len(marks) != 2 or ids[marks[0]] != START or ids[marks[1]] != END:
            raise ValueError(f"conversation {self.conv_id}: a turn isn't one start and one end token")
        body = self.decode(ids[marks[0] + 1 : marks[1]])
        role, _, text = body.partition("\n")
        lost = unescape(self.decode(ids[mask])) if mask.any() else ""
        self.chars += len("".join(CONTROL.values())) + len(body) + len(self.decode(ids[marks[1] + 1 :]))
        self.turns += 1
        self.loss_chars += len(lost)
        self.whole.update(f"{unescape(role)}\n{unescape(text)}\n".encode())
        self.loss.update(lost.encode())

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.whole.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """DIGEST rows of ordered_turns(): decoded, unescaped and hashed from the tokens and the loss mask alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(tokenizer)
        decode = lambda ids: t.decode(ids.tolist(), skip_special_tokens=False)
        names = [c.split()[0] for c in DIGEST.split(", ")]
        now, done = None, []
        for batch in batches:
            n = batch.num_rows
            roles = batch.column("role").to_pylist()
            flat = batch.column("ids").flatten().to_numpy()
            counts = np.array([batch.column(c).to_numpy() for c in ("role_tokens", "text_tokens")])
            assistant = np.array([r == "assistant" for r in roles], bool)
            first, last = loss_spans(counts[0], counts[1], assistant)
            step = np.zeros(len(flat) + 1, np.int8)
            np.add.at(step, first, 1)
            np.add.at(step, last, -1)
            mask = np.cumsum(step[:-1]) > 0
            ends = np.concatenate([[0], np.cumsum(counts.sum(0) + 4)])
            for i, conv in enumerate(batch.column("conv_id").to_pylist()):
                if now is None or now.conv_id != conv:
                    if now is not None:
                        done.append(now.row())
                    now = _Reader(conv, decode)
                now.add(flat[ends[i] : ends[i + 1]], mask[ends[i] : ends[i + 1]])
            if len(done) > 5000 and n:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names)
                done = []
        if now is not None:
            done.append(now.row())
        if done:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)

    return formatted.mapInArrow(run, DIGEST)


def format_chats(turns: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per turn in place: (conv_id, turn, role, ids, role_tokens, text_tokens), conversations whole and in order.

    Null texts and roles are empty. Turns that tie are ordered by role and tokens, rows that repeat are turns of their
    own, and rows with a null conv_id make one conversation. Other columns are ignored; an empty table gives no rows.
    """
    return ordered_turns(encode_turns(turns, tokenizer))


def chat_digests(turns: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    return read_back(format_chats(turns, tokenizer), tokenizer)
