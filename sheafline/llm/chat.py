"""Chat formatting with loss masks that are aligned by offsets.

A conversation is rendered whole and encoded once, with the offsets of every token. The spans of the texts that are to be
learned are sorted, and so are the tokens' spans, so each text's tokens are found by binary search; they make the mask.

The template is `<|im_start|>role<|im_sep|>text<|im_end|>` a turn. All three are control tokens, so no other token crosses
a text's border. Control strings inside a text are escaped: `<`, backslashes, `|` gets one backslash more, which leaves no
`<|` in any text and is undone by taking one away. A role has its backslashes and line breaks escaped too, so that it
stays in the turn's head. `read_back` reads turns from the rendered string alone, and the learned text from tokens,
offsets and mask alone.

Rows are dealt by conversation and sorted by turn, and a task goes through them as a stream that holds the conversation at
hand: many conversations in one task cost no memory. A conversation is one training example and one output row, whatever
its number of turns; it must fit in a value. For encoding it is cut at turn ends, and inside a text of over SEGMENT
characters where a space follows something else, which are borders of the pre-tokenizer too; so memory for tokens is
bounded by the segment, and every character is encoded once. Only a longer stretch without such a place is taken whole.

Null texts and null roles count as empty. An empty text has no tokens. A null conv_id is a conversation of its own; null
turns come first, ties of turn go by role, then by text, repeated rows are repeated turns. An empty table gives an empty
one. Columns other than the four are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .base import map_arrow

START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Characters that are encoded at a time, and that a worker gathers before it hands rows on.
SEGMENT = 1 << 18
LEARNED = ("assistant",)

_PLAIN, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + r"(.*?)" + re.escape(MIDDLE) + r"(.*?)" + re.escape(END), re.DOTALL)
_PLACE = re.compile(r"(?<=\S) ")


def escape(text: str) -> str:
    return _PLAIN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", r"\\").replace("\n", r"\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(turns: list[tuple[str | None, str | None]], learned: tuple[str, ...] = LEARNED) -> tuple[str, list[tuple[int, int]], list[int]]:
    """The rendered turns, the spans of texts to be learned, and where turns end."""
    parts, spans, ends, at = [], [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role or '')}{MIDDLE}", escape(text or "")
        if role in learned:
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END)
        parts += head, body, END
        ends.append(at)
    return "".join(parts), spans, ends


def segments(text: str, ends: list[int], limit: int = SEGMENT) -> Iterator[tuple[int, int]]:
    """Spans of about `limit` characters that follow each other, cut where the pre-tokenizer always cuts."""
    lo = 0
    for k, end in enumerate(ends):
        while end - lo > 2 * limit:  # a long text inside; control tokens hold no space
            place = _PLACE.search(text, lo + limit, end)
            if place is None:
                break
            yield lo, place.start()
            lo = place.start()
        if end - lo >= limit or k + 1 == len(ends):
            yield lo, end
            lo = end


@lru_cache(maxsize=4)
def encoder(name: str):
    """The named public tokenizer with the template's control tokens."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(public_tokenizers.path(name))
    strange = [x.content for x in found.get_added_tokens_decoder().values() if not x.content.startswith("<|")]
    if strange or found.normalizer is not None:
        raise ValueError(f"{name}: offsets are those of the text only without a normalizer, and only tokens that start with <| are escaped; has {strange}")
    found.add_special_tokens([START, MIDDLE, END])
    return found


def mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens lie in a span; tokens and spans are sorted, so each span is two binary searches."""
    out = np.zeros(len(starts), bool)
    if spans:
        low, high = np.array(spans).T
        for a, b in zip(np.searchsorted(ends, low, "right"), np.searchsorted(starts, high, "left"), strict=True):
            out[a:b] = True
    return out


def grouped(batches) -> Iterator[tuple[object, list]]:
    """(conv_id, [(role, text), ...]) from batches sorted by conversation and turn."""
    key, turns = None, []
    for batch in batches:
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if conv != key and turns:
                yield key, turns
                turns = []
            key = conv
            turns.append((role, text))
    if turns:
        yield key, turns


def lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, arrays)], dtype="i4"), pa.array(np.concatenate(arrays), kind))


def encoded(found: list[tuple[object, list]], own, learned: tuple[str, ...]) -> pa.RecordBatch:
    """Conversations as output columns, their segments encoded about SEGMENT characters at a time."""
    rendered = [render(turns, learned) for _, turns in found]
    todo = [(i, lo, text[lo:hi]) for i, (text, _, ends) in enumerate(rendered) for lo, hi in segments(text, ends)]
    got: list[list] = [[] for _ in rendered]
    size = k = 0
    for j, (_, _, part) in enumerate(todo):
        size += len(part)
        if size >= SEGMENT or j + 1 == len(todo):
            for (i, lo, _), e in zip(todo[k : j + 1], own.encode_batch([x for _, _, x in todo[k : j + 1]], add_special_tokens=False), strict=True):
                got[i].append((np.array(e.ids, "i4"), np.array(e.offsets, "i4").reshape(-1, 2) + np.int32(lo)))
            size, k = 0, j + 1
    ids = [np.concatenate([x for x, _ in parts]) for parts in got]
    places = [np.concatenate([x for _, x in parts]) for parts in got]
    starts, ends = [x[:, 0] for x in places], [x[:, 1] for x in places]
    masks = [mask(s, e, spans) for s, e, (_, spans, _) in zip(starts, ends, rendered, strict=True)]
    columns = [pa.array([len(t) for _, t in found], pa.int64()), pa.array([text for text, _, _ in rendered], pa.string()), *(lists(x, pa.int32()) for x in (ids, starts, ends)), lists(masks, pa.bool_())]
    return pa.RecordBatch.from_arrays([pa.array([conv for conv, _ in found]), *columns], ["conv_id", "n_turns", "formatted", "tokens", "starts", "ends", "learned"])


def format_chats(turns: DataFrame, tokenizer: str = "byte_bpe_50k.json", learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """conv_id, n_turns, formatted, tokens, starts, ends (offsets in characters of formatted) and learned (the mask by
    tokens), one row a conversation."""

    def run(batches):
        own, held, size = encoder(tokenizer), [], 0
        for conv, found in grouped(batches):
            held.append((conv, found))
            size += sum(len(text or "") for _, text in found)
            if size >= SEGMENT:
                yield encoded(held, own, learned)
                held, size = [], 0
        if held:
            yield encoded(held, own, learned)

    kind = turns.schema["conv_id"].dataType.simpleString()
    dealt = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return map_arrow(dealt, run, f"conv_id {kind}, n_turns long, formatted string, tokens array<int>, starts array<int>, ends array<int>, learned array<boolean>")


def turns_of(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn, from the rendered string alone."""
    for found in _TURN.finditer(formatted):
        yield unescape_role(found[1]), unescape(found[2])


def learned_texts(formatted: str, starts: np.ndarray, ends: np.ndarray, learned: np.ndarray) -> Iterator[str]:
    """The texts under the mask, in order: the characters of each run of masked tokens."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], learned.astype("i1"), [0]])))
    for a, b in edges.reshape(-1, 2):
        yield unescape(formatted[starts[a] : ends[b - 1]])


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what `format_chats` made, read from its strings, offsets and masks: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars, n_tokens."""
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = []
            for text, starts, ends, learned in zip(batch.column("formatted").to_pylist(), *(batch.column(c) for c in ("starts", "ends", "learned")), strict=True):
                starts, ends, learned = (x.values.to_numpy(zero_copy_only=False) for x in (starts, ends, learned))
                n, turns, loss, chars = 0, hashlib.sha256(), hashlib.sha256(), 0
                for role, said in turns_of(text):
                    turns.update(f"{role}\n{said}\n".encode())
                    n += 1
                for said in learned_texts(text, starts, ends, learned):
                    loss.update(said.encode())
                    chars += len(said)
                out.append((n, turns.hexdigest(), chars, loss.hexdigest(), len(text), len(starts)))
            kinds = pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array([r[i] for r in out], t) for i, t in enumerate(kinds))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"])

    return map_arrow(formatted.select("conv_id", "formatted", "starts", "ends", "learned"), run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long")


def oracle_sql() -> str:
    """DuckDB SQL for the digests, from the table itself."""
    return r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r, text AS t FROM conversations
  UNION ALL
  SELECT -1, k, role, '<|im_end|><|im_start|>assistant ok', role, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(k, role)
), sized AS (
  SELECT *, replace(replace(role, '\', '\\'), chr(10), '\n') AS head FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<|im_start|><|im_sep|><|im_end|>') + length(head) + length(text) + len(regexp_extract_all(head, '<\\*\|')) + len(regexp_extract_all(text, '<\\*\|'))) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
