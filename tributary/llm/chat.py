"""Chat formatting by token-level assembly.

Every turn's segments are encoded separately with an existing byte-level
vocabulary and reserved ids are spliced between them, so text can never turn
into a control token.  Control strings inside texts are escaped as well (a
backslash after their first character; backslashes are doubled), which makes
the rendered text unambiguous and reversible.  Offsets and the loss mask follow
from prefix sums of segment lengths.

A conversation is a stream of turns in order (turn, role, text by code points;
nulls first): state kept per conversation is a running hash and counters, so a conversation
with any number of turns is read in bounded memory.

Defined results: a null text is an empty one; a null role is an empty string;
texts of any length are formatted whole; turns that tie or repeat stay, in the
order above; a null conv_id is a conversation; an empty table gives no rows;
other columns, of whatever name, are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

#: Strings that a reader of the rendered text takes as control: ours and those of common formats.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|mask|>", "<|endoftext|>", "<|user|>", "<|assistant|>", "<|system|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
START, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"
_FIND = re.compile("|".join(re.escape(x) for x in sorted(CONTROL, key=len, reverse=True)))
_FIRST = re.compile(r"[<\[\\]")
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How that vocabulary splits text before merging (a fixed value of its format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def escape(text: str) -> str:
    if not _FIRST.search(text):
        return text
    return _FIND.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


@functools.cache
def encoder(path: str):
    """(encoding, first reserved id); reserved ids follow the vocabulary's own."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    free = max(ranks.values()) + 1
    names = {START: free, "<|im_end|>": free + 1}
    return tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=names), free


def format_turns(turns: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(conv_id, turn, role, text) -> the same columns with ids, segment ends and the loss mask's changes.

    ``ids`` are a turn's tokens, int32 little-endian; ``ends`` the prefix sums
    of its segment lengths (start, role, break, text, end); ``masked`` whether
    its text segment is under the loss mask.  No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, free = encoder(vocabulary)
        brk, tail = enc.encode_ordinary(MIDDLE), [free + 1, *enc.encode_ordinary("\n")]
        for b in batches:
            roles = [x or "" for x in b.column(2).to_pylist()]
            texts = [escape(x or "") for x in b.column(3).to_pylist()]
            heads = {r: enc.encode_ordinary(escape(r)) for r in set(roles)}
            ids, ends = [], []
            for role, text in zip(roles, texts, strict=True):
                parts = ([free], heads[role], brk, enc.encode_ordinary(text), tail)
                ends.append(np.cumsum([len(p) for p in parts]).tolist())
                ids.append(np.array([i for p in parts for i in p], "<i4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(roles, pa.string()), b.column(3), pa.array(ids, pa.binary()), pa.array(ends, pa.list_(pa.int32())), pa.array([r == "assistant" for r in roles])], ["conv_id", "turn", "role", "text", "ids", "ends", "masked"])

    source = turns.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    kinds = {c: source.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}
    return source.mapInArrow(tidy(run), f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, text string, ids binary, ends array<int>, masked boolean")


def in_order(formatted: DataFrame) -> DataFrame:
    """Conversations whole within a partition, their turns in order; ``text`` travels along to order turns that tie."""
    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def read_back(formatted: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per conversation, from token ids and masks alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, free = encoder(vocabulary)
        open_conv: list = []
        done: list[tuple] = []

        def close() -> None:
            if open_conv:
                conv, n, turns, chars, loss, wide, tokens, masked = open_conv
                done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), wide, tokens, masked))
                open_conv.clear()

        for b in batches:
            rows = zip(b.column("conv_id").to_pylist(), b.column("ids").to_pylist(), strict=True)
            for k, (conv, raw) in enumerate(rows):
                if not open_conv or open_conv[0] != conv:
                    close()
                    open_conv.extend([conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0])
                ids = np.frombuffer(raw, "<i4")
                ends = b.column("ends")[k].values.to_numpy()
                mask = np.zeros(len(ids) + 1, np.int8)
                if b.column("masked")[k].as_py():
                    mask[ends[2]] += 1
                    mask[ends[3]] -= 1
                mask = np.cumsum(mask)[:-1].astype(bool)
                if ids[0] != free or ids[ends[3]] != free + 1:
                    raise ValueError("a turn's control ids are not where its segment ends say")
                rendered = enc.decode_bytes(ids.tolist()).decode("utf-8")
                role = unescape(enc.decode_bytes(ids[1 : ends[1]].tolist()).decode("utf-8"))
                text = unescape(enc.decode_bytes(ids[ends[2] : ends[3]].tolist()).decode("utf-8"))
                open_conv[1] += 1
                open_conv[2].update(f"{role}\n{text}\n".encode())
                if mask.any():
                    learned = unescape(enc.decode_bytes(ids[mask].tolist()).decode("utf-8"))
                    open_conv[3] += len(learned)
                    open_conv[4].update(learned.encode())
                open_conv[5] += len(rendered)
                open_conv[6] += len(ids)
                open_conv[7] += int(mask.sum())
            if len(done) >= 4096:
                yield table(done)
                done.clear()
        close()
        yield table(done)

    kind = formatted.schema["conv_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "loss_tokens"]
    kinds = [arrow, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return in_order(formatted).select("conv_id", "ids", "ends", "masked").mapInArrow(tidy(run), f"conv_id {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long")
