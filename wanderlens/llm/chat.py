"""Format conversations as token ids with a loss mask, and read them back.

Assembly is on the level of tokens. The texts of a turn are encoded by themselves, as plain text, and
the template's control strings are spliced in as reserved ids, which no text can produce: they
follow the vocabulary's last one. Where a text holds a control string (or one that was escaped
before), a backslash goes in behind its first character; reading takes it out again, so every text
comes back as it was, and the formatted text, not only its ids, tells turns from contents. The
segments of a batch lie in one array: prefix sums of their lengths give the places of the turns,
and the prefix sum of +1 where a learnt segment begins and -1 where it ends is the loss mask.

The template: ``[INST]text[/INST]`` for the user, ``text</s>`` for the assistant (the text is learnt,
nothing else), ``<<SYS>>text<</SYS>>`` for the system, ``<|role|>role<|text|>text<|end|>`` for others.

A conversation is a row of ids per turn, in order of ``turn``, as one conversation may hold a third of
all rows. Texts are formatted and read where they lie; only the digests, which run over a whole
conversation, bring its turns together, sorted and one after the other through the task.

Defined cases: a null text or role is an empty one; a null turn comes first; turns with equal numbers
are ordered by role, then text; repeated rows are turns each; a null conversation is one of its own;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The control strings of the template; their ids follow the vocabulary in this order.
CONTROLS = ("[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "</s>", "<|role|>", "<|text|>", "<|end|>")
USER, USER_END, SYSTEM, SYSTEM_END, ANSWER_END, ROLE, TEXT, END = range(len(CONTROLS))
#: What comes before and after the text of a turn.
MARKS = {"user": ([USER], [USER_END]), "assistant": ([], [ANSWER_END]), "system": ([SYSTEM], [SYSTEM_END])}
OPENED = {USER: "user", SYSTEM: "system"}

_PLAIN = re.compile("|".join(f"{re.escape(c[0])}\\\\*{re.escape(c[1:])}" for c in CONTROLS))
_ESCAPED = re.compile("|".join(f"{re.escape(c[0])}\\\\+{re.escape(c[1:])}" for c in CONTROLS))


def escape(text: str) -> str:
    """``text`` with no control string in it."""
    return _PLAIN.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


class Codec:
    """Ids of plain text by a rank file, and reserved ids for the control strings."""

    def __init__(self, ranks: str, pattern: str):
        import tiktoken

        with open(ranks, "rb") as lines:
            found = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.first = max(found.values()) + 1
        self.words = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=found, special_tokens={})

    def encode(self, text: str) -> list[int]:
        return self.words.encode_ordinary(text)

    def decode(self, ids: list[int]) -> str:
        return self.words.decode_bytes(ids).decode()


def segments(role: str, text: str) -> list[tuple[int | None, str, bool]]:
    """A turn in pieces: a control's number or None, the escaped text if there is none, and whether it is learnt."""
    before, after = MARKS.get(role, ([ROLE], [END]))
    named = [] if role in MARKS else [(None, escape(role), False), (TEXT, "", False)]
    return [*((c, "", False) for c in before), *named, (None, escape(text), role == "assistant"), *((c, "", False) for c in after)]


def assemble(codec: Codec, turns: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and loss mask of all turns in one array, and where each turn begins (and the last one ends)."""
    parts: list[list[int]] = []
    learnt: list[bool] = []
    count = [0]
    for role, text in turns:
        for control, piece, learn in segments(role, text):
            parts.append(codec.encode(piece) if control is None else [codec.first + control])
            learnt.append(learn)
        count.append(len(parts))
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)]).astype(np.int64)
    steps = np.zeros(int(bounds[-1]) + 1, np.int64)
    flags = np.array(learnt, np.int64)
    np.add.at(steps, bounds[:-1], flags)
    np.add.at(steps, bounds[1:], -flags)
    ids = np.fromiter((i for p in parts for i in p), np.int32, int(bounds[-1]))
    return ids, np.cumsum(steps)[:-1] > 0, bounds[np.array(count)]


def parse(codec: Codec, ids: np.ndarray, loss: np.ndarray) -> tuple[str, str, str, int]:
    """Role, text, learnt text and the number of characters of a formatted turn."""
    controls = np.flatnonzero(ids >= codec.first)
    texts, chars, at = {}, 0, 0
    for place in [*controls, len(ids)]:
        piece = codec.decode(ids[at:place].tolist())
        before = int(ids[at - 1]) - codec.first if at else None
        texts[before] = unescape(piece)
        chars += len(piece) + (len(CONTROLS[int(ids[place]) - codec.first]) if place < len(ids) else 0)
        at = int(place) + 1
    first = int(ids[controls[0]]) - codec.first
    if first == ANSWER_END:
        role, text = "assistant", texts[None]
    elif first == ROLE:
        role, text = texts[ROLE], texts[TEXT]
    else:
        role, text = OPENED[first], texts[first]
    return role, text, unescape(codec.decode(ids[loss].tolist())), chars


def format_turns(
    turns: DataFrame, ranks: str, pattern: str, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """``key, turn, ids, loss``: the formatted tokens of each turn."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks, pattern)
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.slice(at, 2000)
                ids, loss, bounds = assemble(codec, list(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)))
                offsets = pa.array(bounds.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.ListArray.from_arrays(offsets, pa.array(ids)),
                     pa.ListArray.from_arrays(offsets, pa.array(loss))], ["key", "turn", "ids", "loss"])

    kinds = dict(turns.dtypes)
    rows = turns.select(
        turns[key].alias("key"), turns[turn].alias("turn"), F.coalesce(turns[role], F.lit("")).alias("role"),
        F.coalesce(turns[text], F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"key {kinds[key]}, turn {kinds[turn]}, ids array<int>, loss array<boolean>")


def read_turns(formatted: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``key, turn, role, text, learnt, chars`` of formatted turns: what their tokens say."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks, pattern)
        for batch in batches:
            ids, loss = batch.column(2), batch.column(3)
            flat, mask = ids.values.to_numpy(), loss.values.to_numpy(zero_copy_only=False)
            bounds, marks = ids.offsets.to_numpy(), loss.offsets.to_numpy()
            found = [parse(codec, flat[bounds[i] : bounds[i + 1]], mask[marks[i] : marks[i + 1]]) for i in range(len(batch))]
            columns = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(
                    pa.array(list(c), t) for c, t in zip(columns, (*[pa.string()] * 3, pa.int64()), strict=True))],
                ["key", "turn", "role", "text", "learnt", "chars"])

    kinds = dict(formatted.dtypes)
    return formatted.mapInArrow(
        run, f"key {kinds['key']}, turn {kinds['turn']}, role string, text string, learnt string, chars long")


def digests(turns: DataFrame) -> DataFrame:
    """Per conversation of ``read_turns``: its number of turns, digests of all turns and of the learnt text, lengths."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        now, started = None, False
        n = learnt_chars = chars = 0
        whole, learnt = hashlib.sha256(), hashlib.sha256()
        names = ["key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

        def out() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            done.clear()
            kinds = [None, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), k or schema.field(0).type) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            schema = batch.schema
            for key, role, text, own, size in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5)), strict=True):
                if not started or key != now:
                    if started:
                        done.append((now, n, whole.hexdigest(), learnt_chars, learnt.hexdigest(), chars))
                    now, started, n, learnt_chars, chars = key, True, 0, 0, 0
                    whole, learnt = hashlib.sha256(), hashlib.sha256()
                whole.update(f"{role}\n{text}\n".encode())
                learnt.update(own.encode())
                n, learnt_chars, chars = n + 1, learnt_chars + len(own), chars + size
            if len(done) >= 10_000:
                yield out()
        if started:
            done.append((now, n, whole.hexdigest(), learnt_chars, learnt.hexdigest(), chars))
            yield out()

    kind = dict(turns.dtypes)["key"]
    ordered = turns.repartition("key").sortWithinPartitions("key", F.asc_nulls_first("turn"), "role", "text")
    return ordered.mapInArrow(
        run, f"key {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _length(text: str) -> str:
    """SQL for the characters of an escaped text."""
    rests = {c[0]: "|".join(re.escape(d[1:]) for d in CONTROLS if d[0] == c[0]) for c in CONTROLS}
    for first, rest in rests.items():
        text = f"regexp_replace({text}, '({re.escape(first)})(\\\\*(?:{rest}))', '\\1\\\\\\2', 'g')"
    return f"length({text})"


#: The added conversation: control strings as contents.
PLANTED = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]

ORACLE = f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values {', '.join(map(str, PLANTED))}),
learnt as (select *, case when role = 'assistant' then text else '' end as own from turns)
select conv_id, count(*) n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) turns_sha256,
  sum(length(own))::bigint loss_chars,
  sha256(string_agg(own, '' order by turn nulls first, role, text)) loss_sha256,
  sum(case role when 'user' then 13 when 'assistant' then 4 when 'system' then 15 else 23 + {_length('role')} end
    + {_length('text')})::bigint formatted_chars
from learnt group by conv_id
"""
