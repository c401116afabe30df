"""Chat formatting with offset-aligned masks.

Whole conversations are rendered by a template and encoded once, with offsets. Control strings are
tokens of their own, so no token straddles a turn's edge. Sorted turn spans are intersected with
the sorted token spans by binary search; tokens of assistant texts carry the loss.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of the template: what opens and closes a turn of each role. Turns of any other
# role name it between the INST marks.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"),
         "assistant": ("<s>", "</s>")}
OTHER = ("<s>[INST]", "[/INST]", "</s>")

_PLAIN = re.compile(r"(<)(\\*/?s>|\\*</?SYS>>)|(\[)(\\*/?INST\])")
_ESCAPED = re.compile(r"(<)\\(\\*/?s>|\\*</?SYS>>)|(\[)\\(\\*/?INST\])")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))


def escape(text: str) -> str:
    """Puts a backslash behind the first character of every control string and of every string
    that is one but for backslashes there; no control string is left."""
    return _PLAIN.sub(lambda m: f"{m[1] or m[3]}\\{m[2] or m[4]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: f"{m[1] or m[3]}{m[2] or m[4]}", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int, bool]]]:
    """The formatted conversation and, per turn, start and end of its text and whether it counts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        if role in MARKS:
            before, after = MARKS[role]
        else:
            before, after = OTHER[0] + escape(role) + OTHER[1], OTHER[2]
        body = escape(text)
        spans.append((at + len(before), at + len(before) + len(body), role == "assistant"))
        parts += (before, body, after)
        at += len(before) + len(body) + len(after)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """Turns read back from a formatted conversation."""
    opens = {before: (role, after) for role, (before, after) in MARKS.items()}
    turns, at = [], 0

    def until(mark: str, start: int) -> tuple[str, int]:
        end = formatted.index(mark, start)
        return unescape(formatted[start:end]), end + len(mark)

    while at < len(formatted):
        if formatted.startswith(OTHER[0], at):
            role, at = until(OTHER[1], at + len(OTHER[0]))
            text, at = until(OTHER[2], at)
        else:
            mark = _CONTROL.match(formatted, at)
            role, after = opens[mark[0]]
            text, at = until(after, mark.end())
        turns.append((role, text))
    return turns


def loss_mask(spans: list[tuple[int, int, bool]], offsets: np.ndarray) -> np.ndarray:
    """Which tokens lie in a counting turn; both lists are sorted by place."""
    counting = np.array([s[:2] for s in spans if s[2] and s[1] > s[0]], np.int64).reshape(-1, 2)
    first = np.searchsorted(offsets[:, 0], counting[:, 0], "left")
    last = np.searchsorted(offsets[:, 1], counting[:, 1], "right")
    edges = np.zeros(len(offsets) + 1, np.int64)
    np.add.at(edges, first, 1)
    np.add.at(edges, last, -1)
    return np.cumsum(edges[:-1]) > 0


def masked_text(formatted: str, mask: np.ndarray, offsets: np.ndarray) -> list[str]:
    """The text under the mask, a string for each run of masked tokens."""
    change = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return [formatted[offsets[a, 0]:offsets[b - 1, 1]]
            for a, b in zip(change[::2], change[1::2], strict=True)]


_tokenizers: dict[str, object] = {}


def tokenizer(path: str):
    if path not in _tokenizers:
        from tokenizers import Tokenizer
        from tokenizers.processors import ByteLevel

        made = Tokenizer.from_file(path)
        made.encode_special_tokens = False
        made.add_special_tokens(CONTROL)
        made.post_processor = ByteLevel(trim_offsets=False)
        _tokenizers[path] = made
    return _tokenizers[path]


COLUMNS = ("conv_id long, n_turns long, formatted string, input_ids array<int>, "
           "loss_mask array<boolean>, loss_texts array<string>")


def _format(path: str, at_once: int):
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.bool_()),
             pa.list_(pa.string())]
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = tokenizer(path)
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                part = batch.slice(at, at_once)
                ids = part.column("conv_id").to_pylist()
                conversations = [[(t["role"] or "", t["text"] or "") for t in turns]
                                 for turns in part.column("turns").to_pylist()]
                rendered = [render(turns) for turns in conversations]
                encoded = codec.encode_batch([r[0] for r in rendered], add_special_tokens=False)
                rows = []
                for conv, turns, (formatted, spans), enc in zip(
                        ids, conversations, rendered, encoded, strict=True):
                    offsets = np.array(enc.offsets, np.int64).reshape(-1, 2)
                    mask = loss_mask(spans, offsets)
                    rows.append((conv, len(turns), formatted, enc.ids, mask.tolist(),
                                 [unescape(t) for t in masked_text(formatted, mask, offsets)]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, kind) for column, kind in
                     zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
    return run


def format_chats(turns: DataFrame, tokenizer_path: str, conv_col: str = "conv_id",
                 turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                 at_once: int = 256) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, input_ids, loss_mask, loss_texts.

    Turns are ordered by number (null first), then role and text; repeated rows are turns of their
    own. Null role and text count as empty. Rows without a conversation id form one conversation
    (null). Empty assistant texts have no token and so no loss. An empty table gives an empty
    result; other columns are not read.
    """
    grouped = turns.groupBy(F.col(conv_col).cast("long").alias("conv_id")).agg(
        F.sort_array(F.collect_list(F.struct(
            F.col(turn_col).alias("turn"), F.col(role_col).alias("role"),
            F.col(text_col).alias("text")))).alias("turns"))
    return grouped.mapInArrow(_format(tokenizer_path, at_once), COLUMNS)


def _digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        formatted = batch.column("formatted").to_pylist()
        turns = [parse(x) for x in formatted]
        texts = ["".join(x) for x in batch.column("loss_texts").to_pylist()]
        sha = [hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in x).encode()).hexdigest()
               for x in turns]
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), pa.array(map(len, turns), pa.int64()), pa.array(sha),
             pa.array(map(len, texts), pa.int64()),
             pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts]),
             pa.array(map(len, formatted), pa.int64())],
            names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256",
                   "formatted_chars"])


def chat_digests(chats: DataFrame) -> DataFrame:
    """Digests read back from formatted conversations."""
    return chats.select("conv_id", "formatted", "loss_texts").mapInArrow(
        _digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                 "loss_sha256 string, formatted_chars long")
