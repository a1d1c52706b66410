"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole: each turn is a marker, its role, a marker, its text, a marker. The
markers are added to the tokenizer as special tokens, so no token reaches across one. The rendered text is
encoded once, with offsets, and the spans of the turns to learn from are intersected with the spans of the
tokens by binary search on the sorted starts. A token counts if it shares a character with a span; what a
token has outside the span does not.

Control strings inside roles and texts are escaped: a backslash is doubled, and one is put behind the first
character of every control string, so no control string is left. To read back, a backslash is dropped and
what follows it is kept.

Rows are ordered by turn, then role, then text; null turns come first; null roles and texts are empty. A
null conversation id is one conversation. Repeated rows are repeated turns. Other columns are not read.
A conversation is formatted in one task, since it is encoded as a whole; rows of a partition are streamed
in order, one conversation at a time.
"""

import functools
import hashlib
import os
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
CONTROLS = (TURN, BODY, END, "<|endoftext|>", "<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LEARNED = ("assistant",)

_CONTROL = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROLS))
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(f"{re.escape(TURN)}(.*?){re.escape(BODY)}(.*?){re.escape(END)}", re.S)
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_FORMATTED = (
    "conv_id bigint, formatted string, token_ids binary, "
    "loss_tokens array<struct<start:bigint,end:bigint>>, loss_spans array<struct<start:bigint,end:bigint>>"
)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\g<0>\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation as one text, and the span of each turn's text in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{BODY}", escape(text)
        spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at = spans[-1][1] + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks in parallel
    from tokenizers import AddedToken, Tokenizer, pre_tokenizers, processors

    made = Tokenizer.from_file(path)
    made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False)
    made.post_processor = processors.ByteLevel(trim_offsets=False)
    made.add_special_tokens([AddedToken(m, normalized=False) for m in (TURN, BODY, END)])
    return made


def mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Runs of tokens that meet the sorted spans, and the characters of the spans that tokens cover."""
    tokens, chars = [], []
    starts, ends = offsets[:, 0], offsets[:, 1]
    for a, b in spans:
        first, last = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, b, "left"))
        if first < last:
            tokens.append((first, last))
            chars.append((max(a, int(starts[first])), min(b, int(ends[last - 1]))))
    return tokens, chars


def format_conversation(turns: list[tuple[str, str]], learned: tuple[str, ...], path: str):
    text, spans = render(turns)
    encoded = tokenizer(path).encode(text, add_special_tokens=False)
    wanted = [s for (role, _), s in zip(turns, spans, strict=True) if role in learned]
    offsets = np.array(encoded.offsets, np.int64).reshape(-1, 2)
    tokens, chars = mask(offsets, wanted)
    return text, np.array(encoded.ids, "<u4").tobytes(), tokens, chars


def _spans(rows: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"start": a, "end": b} for a, b in row] for row in rows], _SPAN)


def format_chats(
    df: DataFrame,
    key: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    learned: tuple[str, ...] = LEARNED,
    path: str = TOKENIZER,
) -> DataFrame:
    """conv_id, formatted, token_ids (little-endian 32 bit), loss_tokens and loss_spans (token and character runs)."""
    picked = df.select(
        F.col(key).cast("bigint").alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    ordered = picked.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def batch_of(done: list) -> pa.RecordBatch:
        ids, made = zip(*done, strict=True)
        texts, tokens, loss, chars = zip(*made, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(texts), pa.array(tokens, pa.binary()), _spans(loss), _spans(chars)],
            ["conv_id", "formatted", "token_ids", "loss_tokens", "loss_spans"],
        )

    def rows(batches):
        now, turns = None, []
        for batch in batches:
            done = []
            for conv, said_by, said in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if turns and conv != now:
                    done.append((now, format_conversation(turns, learned, path)))
                    turns = []
                now = conv
                turns.append((said_by, said))
            if done:
                yield batch_of(done)
        if turns:
            yield batch_of([(now, format_conversation(turns, learned, path))])

    return ordered.mapInArrow(rows, _FORMATTED)


_DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_tokens bigint"


def read_back(batches):
    """Digests of formatted conversations, from the formatted text and its mask alone."""
    for batch in batches:
        rows = []
        cells = (batch.column(c).to_pylist() for c in ("conv_id", "formatted", "token_ids", "loss_spans"))
        for conv, formatted, ids, spans in zip(*cells, strict=True):
            turns = parse(formatted)
            said = "".join(f"{role}\n{text}\n" for role, text in turns)
            loss = "".join(unescape(formatted[s["start"] : s["end"]]) for s in spans)
            digests = [hashlib.sha256(x.encode()).hexdigest() for x in (said, loss)]
            rows.append((conv, len(turns), digests[0], len(loss), digests[1], len(formatted), len(ids) // 4))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        columns = zip(*rows, strict=True) if rows else [[]] * 7
        names = [x.split()[0] for x in _DIGESTS.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)


def digests(formatted: DataFrame) -> DataFrame:
    return formatted.mapInArrow(read_back, _DIGESTS)
