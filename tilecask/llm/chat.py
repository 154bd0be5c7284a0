"""Chat formatting with loss masks aligned by offsets.

A conversation is rendered whole: for each turn ``<|im_start|>`` role newline text ``<|im_end|>`` newline. Inside roles
and texts ``<`` followed by any number of backslashes and ``|`` gets one more backslash, so that no text can spell a
control string; roles also write a newline as backslash n. Both are undone by removing what was added. The rendered
string is encoded once, with offsets; the spans of the turns that count for the loss and the spans of the tokens, both
sorted, are intersected by binary search. What is masked is the part of each such token that lies in a turn.

Control strings are special tokens, never joined with text, so a conversation is encoded in pieces that end after a
control string; state between pieces is a few numbers and running hashes. A conversation of any length thus streams
through one task without being held. Rows come sorted by (conv_id, turn, role, text); null texts and roles are empty,
null conv_ids form one conversation, null turns come first, repeated rows are turns of their own. An empty table gives an
empty one. Columns beyond the four are not looked at, whatever they are called.

A conversation is one task: its digests are over all of it in order, and a hash cannot be joined from parts. The task
sorts on disk and streams, so that a conversation of a third of all rows costs time, not memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

START, END = "<|im_start|>", "<|im_end|>"
#: Turns are encoded together up to about so many characters.
PIECE = 1 << 16

_guard = re.compile(r"<(\\*)\|").sub
_unguard = re.compile(r"<\\(\\*)\|").sub
_role = re.compile(r"\\[\\n]").sub


def escape(text: str) -> str:
    return _guard(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _unguard(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\\", "\\\\").replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return unescape(_role(lambda m: "\n" if m[0] == "\\n" else "\\", role))


def render(role: str, text: str) -> tuple[str, int]:
    """A turn as it is written, and where its text begins."""
    head = f"{START}{escape_role(role)}\n"
    return f"{head}{escape(text)}{END}\n", len(head)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted conversation: the inverse of rendering."""
    turns = []
    for turn in formatted.split(END + "\n")[:-1]:
        assert turn.startswith(START), "not a formatted conversation"
        role, _, text = turn[len(START) :].partition("\n")
        turns.append((unescape_role(role), unescape(text)))
    return turns


def covered(turn_starts: np.ndarray, turn_ends: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The intersections of sorted turn spans with sorted token spans: rows of (turn, begin, end, token).

    For each turn, binary search gives the first token that ends after its begin and the first that begins at or after
    its end; what lies between overlaps it. Tokens that split one character share its span: it is counted once.
    """
    first = np.searchsorted(offsets[:, 1], turn_starts, "right")
    last = np.maximum(np.searchsorted(offsets[:, 0], turn_ends, "left"), first)
    n = last - first
    turn = np.repeat(np.arange(len(n)), n)
    token = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    begin = np.maximum(offsets[token, 0], turn_starts[turn])
    end = np.minimum(offsets[token, 1], turn_ends[turn])
    reached = np.maximum.accumulate(np.r_[0, end])[:-1] if len(end) else end
    begin = np.maximum(begin, np.minimum(reached, end))
    some = end > begin
    return np.stack([turn[some], begin[some], end[some], token[some]], 1)


class Formatter:
    """Formats turns with a vocabulary file of the ``tokenizers`` JSON form; ``loss_role`` is what the loss sees."""

    def __init__(self, path: str, loss_role: str = "assistant"):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.add_special_tokens([START, END])
        self.loss_role = loss_role

    def piece(self, turns: list[tuple[str, str]]) -> tuple[str, np.ndarray, np.ndarray, list[str]]:
        """Formatted text, token ids, loss mask by token, and the masked text of each turn of the loss role, as written."""
        parts, starts, ends, at = [], [], [], 0
        for role, text in turns:
            written, head = render(role, text)
            if role == self.loss_role:
                starts.append(at + head)
                ends.append(at + len(written) - len(END) - 1)
            parts.append(written)
            at += len(written)
        formatted = "".join(parts)
        encoded = self.tokenizer.encode(formatted, add_special_tokens=False)
        offsets = np.array(encoded.offsets, np.int64).reshape(-1, 2)
        found = covered(np.array(starts, np.int64), np.array(ends, np.int64), offsets)
        mask = np.zeros(len(offsets), bool)
        mask[found[:, 3]] = True
        texts = [""] * len(starts)
        by = np.searchsorted(found[:, 0], np.arange(len(starts) + 1))
        for i in range(len(starts)):
            texts[i] = "".join([formatted[a:b] for _, a, b, _ in found[by[i] : by[i + 1]]])
        return formatted, np.array(encoded.ids, np.uint32), mask, texts


def _pieces(batches, columns: list[str], out: Formatter) -> Iterator[tuple]:
    """(conv_id, first piece?, last piece?, formatted, ids, mask, masked texts) from sorted rows."""
    now, turns, size, first = None, [], 0, True
    for batch in batches:
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            if turns and (conv != now or size >= PIECE):
                yield now, first, conv != now, *out.piece(turns)
                first = conv != now
                turns, size = [], 0
            now = conv
            turns.append((role or "", text or ""))
            size += len(turns[-1][1]) + 32
    if turns:
        yield now, first, True, *out.piece(turns)


def _sorted_turns(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    few = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    return few.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def formatted(rows: DataFrame, path: str, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Pieces of formatted conversations: conv_id, piece (from 0), formatted, ids (array), loss_mask (array of 0 and 1)."""
    schema = "conv_id long, piece int, formatted string, ids array<int>, loss_mask array<tinyint>"

    def run(batches):
        out, k = Formatter(path), 0
        for now, first, _, written, ids, mask, _ in _pieces(batches, ["conv_id", "role", "text"], out):
            k = 0 if first else k + 1
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([k], pa.int32()), pa.array([written]), pa.array([ids.astype(np.int32)]), pa.array([mask.astype(np.int8)])], ["conv_id", "piece", "formatted", "ids", "loss_mask"])

    return _sorted_turns(rows.withColumn(conv, F.col(conv).cast("long")), conv, turn, role, text).mapInArrow(run, schema)


def digests(rows: DataFrame, path: str, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation, read back from what ``formatted`` makes: numbers and digests of turns and masked text."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"
    names = [f.name for f in T._parse_datatype_string(schema).fields]

    def run(batches):
        out, done = Formatter(path), []

        def table():
            return pa.RecordBatch.from_pylist(done, pa.schema([(n, pa.string() if n.endswith("sha256") else pa.int64()) for n in names]))

        for now, first, last, written, ids, mask, texts in _pieces(batches, ["conv_id", "role", "text"], out):
            if first:
                turns_hash, loss_hash, n, loss, chars, tokens, masked = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0, 0
            for r, t in parse(written):
                turns_hash.update(f"{r}\n{t}\n".encode())
                n += 1
            for t in map(unescape, texts):
                loss_hash.update(t.encode())
                loss += len(t)
            chars, tokens, masked = chars + len(written), tokens + len(ids), masked + int(mask.sum())
            if last:
                done.append(dict(zip(names, (now, n, turns_hash.hexdigest(), loss, loss_hash.hexdigest(), chars, tokens, masked), strict=True)))
                if len(done) >= 1000:
                    yield table()
                    done = []
        if done:
            yield table()

    return _sorted_turns(rows.withColumn(conv, F.col(conv).cast("long")), conv, turn, role, text).mapInArrow(run, schema)
