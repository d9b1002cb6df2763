"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with offsets, and the token
spans are intersected with the sorted spans of its assistant turns by binary
search. The template's marks are special tokens, which the tokenizer never
joins to their neighbours, so that a span's edges are token edges.

Template of a turn: ``<|im_start|>role<|im_sep|>text<|im_end|>``. Inside roles
and texts a backslash is put before the bar of every ``<|`` (and of every
``<\\...|``, which gains one), so no control string is left and the change can
be undone.

Defined results: null role or text is empty. Rows are ordered by turn (nulls
first), then role, then text, so equal turns have one order. Rows with a null
conv_id are one conversation. Texts of any length are encoded whole, white space
of RUN characters or more by a way of its own with the same result; an empty
table gives an empty one. Extra columns are ignored. A conversation is the
unit that is rendered and encoded; rows stream in sorted order, and short
conversations are encoded together, so a task holds GROUP_CHARS characters or
one longer conversation, and never a whole partition.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
OPEN = re.compile(r"<(\\*)\|")
SHUT = re.compile(r"<\\(\\*)\|")
#: White space so long that the splitting pattern can't take it; it is one piece of text for the tokenizer, but for its last character.
RUN = 10_000
BLANK = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % RUN)
#: Characters and conversations that are encoded together.
GROUP_CHARS, GROUP = 1 << 19, 512
_held: dict[str, tuple[tiktoken.Encoding, np.ndarray]] = {}


def escape(text: str) -> str:
    return OPEN.sub(r"<\\\1|", text) if "<" in text else text


def unescape(text: str) -> str:
    return SHUT.sub(r"<\1|", text) if "<\\" in text else text


def render(turns: list[tuple[str, str]], trained: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted string, and the sorted spans of the trained role's texts in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        if role == trained:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted string; no control string is left inside a turn, so marks are told by sight."""
    turns = (t[len(START) :].partition(SEP) for t in formatted.split(END)[:-1])
    return [(unescape(r), unescape(t)) for r, _, t in turns]


def tokenizer(path: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """Of a file of byte-level ranks: an encoding whose specials are the marks, and how many bytes each of its tokens stands for."""
    if path not in _held:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        first = max(ranks.values()) + 2  # the id after the ranks is that of the end of a text
        marks = {x: first + i for i, x in enumerate((START, SEP, END))}
        size = np.zeros(first + len(marks), np.int64)
        for token, i in [*ranks.items(), *marks.items()]:
            size[i] = len(token)
        _held[path] = (tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=marks), size)
    return _held[path]


def encode(path: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets [token, start and end]) of a text, in characters.

    A token's bytes are known from the vocabulary, so offsets are running sums;
    a character cut into several tokens is the span of each.
    """
    tok, size = tokenizer(path)
    parts, at = [], 0
    for m in BLANK.finditer(text) if len(text) >= RUN else ():
        # the last character goes with what follows, unless that is a mark or nothing
        end = m.end() - (m.end() < len(text) and not text.startswith((START, SEP, END), m.end()))
        parts += [tok.encode_to_numpy(text[at : m.start()], allowed_special="all"), tok._encode_single_piece(text[m.start() : end])]
        at = end
    ids = np.concatenate([*parts, tok.encode_to_numpy(text[at:], allowed_special="all")]).astype(np.int32)
    end = np.cumsum(size[ids])
    start = end - size[ids]
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    if len(raw) != len(text):
        before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        start, end = before[start + 1] - 1, before[end]
    return ids, np.stack([start, end], 1)


def mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens lie in a span: binary search of each token's start among the spans' starts."""
    out = np.zeros(len(offsets), bool)
    if spans and len(offsets):
        s = np.array(spans, np.int64)
        at = np.searchsorted(s[:, 0], offsets[:, 0], "right") - 1
        out = (at >= 0) & (offsets[:, 0] < s[np.maximum(at, 0), 1]) & (offsets[:, 1] > offsets[:, 0])
    return out


def masked_text(formatted: str, offsets: np.ndarray, on: np.ndarray) -> str:
    """All text under the mask, unescaped; the tokens of one character that was cut count it once."""
    held = offsets[on]
    if not len(held):
        return ""
    upto = np.maximum.accumulate(held[:, 1])
    gap = np.flatnonzero(held[1:, 0] > upto[:-1])  # a new span
    first, last = held[np.append(0, gap + 1), 0], upto[np.append(gap, len(held) - 1)]
    return "".join(unescape(formatted[a:b]) for a, b in zip(first.tolist(), last.tolist(), strict=True))


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    bounds = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(parts), kind))


def _formatter(path: str, trained: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted rows (conv_id, role, text) to formatted conversations."""

    def group(kind: pa.DataType, ids: list, turns: list[list[tuple[str, str]]]) -> pa.RecordBatch:
        made = [render(t, trained) for t in turns]
        encoded = [encode(path, f) for f, _ in made]
        columns = [
            pa.array(ids, kind),
            pa.array([f for f, _ in made], pa.string()),
            lists([i for i, _ in encoded], pa.int32()),
            lists([mask(o, spans) for (_, o), (_, spans) in zip(encoded, made, strict=True)], pa.bool_()),
            lists([o[:, 0] for _, o in encoded], pa.int64()),
            lists([o[:, 1] for _, o in encoded], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["conv_id", "formatted", "ids", "loss_mask", "token_start", "token_end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, turns, chars, kind = [], [], 0, None
        for b in batches:
            kind = b.schema.field("conv_id").type
            for conv_id, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if not ids or conv_id != ids[-1]:
                    if chars > GROUP_CHARS or len(ids) >= GROUP:
                        yield group(kind, ids, turns)
                        ids, turns, chars = [], [], 0
                    ids.append(conv_id)
                    turns.append([])
                turns[-1].append((role, text))
                chars += len(role) + len(text)
        if ids:
            yield group(kind, ids, turns)

    return run


FORMATTED = "formatted string, ids array<int>, loss_mask array<boolean>, token_start array<bigint>, token_end array<bigint>"
DIGESTS = "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_tokens bigint, loss_tokens bigint"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Formatted conversations to what they give when read back."""
    sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
    names = [c.split()[0] for c in DIGESTS.split(", ")]
    kinds = [pa.string() if c.endswith("string") else pa.int64() for c in DIGESTS.split(", ")]
    for b in batches:
        rows = []
        for i, text in enumerate(b.column("formatted").to_pylist()):
            turns = parse(text)
            on = b.column("loss_mask")[i].values.to_numpy(zero_copy_only=False).astype(bool)
            offsets = np.stack([b.column(c)[i].values.to_numpy() for c in ("token_start", "token_end")], 1)
            loss = masked_text(text, offsets, on)
            rows.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text), len(on), int(on.sum())))
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), *columns], ["conv_id", *names])


def _sorted_rows(conversations: DataFrame) -> DataFrame:
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return (
        conversations.select("conv_id", "turn", plain("role"), plain("text"))
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text")
    )


def format_conversations(conversations: DataFrame, path: str, trained: str = "assistant") -> DataFrame:
    """conv_id, formatted, ids, loss_mask, offsets (start and end of each token) of each conversation."""
    kind = conversations.schema["conv_id"].dataType.simpleString()
    return _sorted_rows(conversations).mapInArrow(_formatter(path, trained), f"conv_id {kind}, {FORMATTED}")


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted strings and masks give when read back, a row a conversation."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.mapInArrow(_digest, f"conv_id {kind}, {DIGESTS}")


def formatted_digests(conversations: DataFrame, path: str, trained: str = "assistant") -> DataFrame:
    """digests(format_conversations(...)) without sending the formatted conversations through the JVM between the two."""
    kind = conversations.schema["conv_id"].dataType.simpleString()
    made = _formatter(path, trained)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _digest(made(batches))

    return _sorted_rows(conversations).mapInArrow(run, f"conv_id {kind}, {DIGESTS}")
