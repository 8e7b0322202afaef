"""Repair the turn structure of conversations with the cheapest edits, by iterative-deepening A*.

The wanted order of roles is an optional system turn and then pairs of user and assistant, or nothing
at all. Each row is deleted, kept or given another role, and empty rows are inserted. The search goes
depth first through the edits in ASCII order (Delete, Insert, Keep, Rerole) under a bound on the cost
that rises by one from a lower bound; a table holds, for each row and grammar state, the largest budget
that has failed. So the first accepting path is the cheapest, and of those the first in ASCII order.

Conversations are not brought together in one task: rows are dealt by ranges of (conversation, turn) and
searched in blocks of at most ``BLOCK`` rows or ``CHARS`` characters. A conversation that lies within one
block, between others, is repaired there. Of others each block gives the cheapest edits from each state
of the grammar to each other, and the blocks are joined in order, with four paths at a time; only texts that
stay are sent on. As a block's edits end with a row, no path is the beginning of another one, and the
first in ASCII order of the whole is made of the first ones of the blocks.

A row is a duplicate if its role and text came earlier in the conversation. Copies at one turn are seen
where they lie; of copies at a later turn a notice is made from digests alone, which is dealt to the
same place and sorts before the row.

Defined cases: a null text or role is one space; a null turn comes first; rows with equal turns are
ordered by role, then the digest of the text; an empty role fits nowhere and is deleted or replaced; the
rows of the null conversation are one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wanderlens.sources.stored import stored

BLOCK = 64
CHARS = 1 << 20
DELETE, INSERT, REROLE, CUT = 3, 2, 2, 1
#: States of the grammar: nothing yet, after a system turn, after a user's, after an assistant's.
START, SYSTEM, USER, ANSWER = range(4)
NEXT = (USER, USER, ANSWER, USER)
NAME = {USER: "user", ANSWER: "assistant"}
DONE = (START, ANSWER)
LEGAL = {"su", "ua", "au"}
#: What is still inserted at the end, by state.
TAIL = {START: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ANSWER: (0, "")}

_SPACE = " \t\n\x0b\x0c\r"


def kept_state(state: int, initial: str) -> int | None:
    """The state after a kept row, or None where it does not fit."""
    if initial == "s":
        return SYSTEM if state == START else None
    return NEXT[state] if initial == ("a" if state == USER else "u") else None


def search(initials: str, faults: str, state: int = START, goal: int | None = None) -> tuple[int, str]:
    """The cheapest edits and their cost. ``faults``: b and d must go, t costs when it stays, - is sound.

    Without a ``goal`` the path ends in an accepted structure, inserting at the end where needed;
    with one it ends in that state right after the last row.
    """
    n = len(initials)
    least = [0] * (n + 1)  # what the rows from i on cost at least
    for i in range(n - 1, -1, -1):
        if faults[i] in "bd" or goal in (START, SYSTEM):
            own = DELETE
        else:
            own = (faults[i] == "t") + (REROLE if initials[i] not in ("s", "u", "a") else 0)
        least[i] = least[i + 1] + min(own, DELETE)
    if goal == SYSTEM and state == START:  # one of the rows is kept instead
        least = [max(0, c - DELETE) for c in least]
    failed: dict[tuple[int, int], int] = {}

    def edits(i: int, g: int) -> list[tuple[str, int, int, int]]:
        """Edit, cost, next row and next state, last in ASCII order first."""
        if i == n:
            return [("I", INSERT, i, NEXT[g])] if goal is None else []
        found = [("I", INSERT, i, NEXT[g]), ("D", DELETE, i + 1, g)]
        if faults[i] in "bd":
            return found
        cut = CUT if faults[i] == "t" else 0
        after = kept_state(g, initials[i])
        keep = [] if after is None else [("K", cut, i + 1, after)]
        return [("R", REROLE + cut, i + 1, NEXT[g]), *keep, *found]

    bound = least[0]
    while True:
        path: list[str] = []
        trail = [((0, state), bound, edits(0, state))]
        while trail:
            (i, g), left, open_edits = trail[-1]
            if i == n and (g in DONE if goal is None else g == goal):
                return bound - left, "".join(path)
            if not open_edits:
                failed[i, g] = max(left, failed.get((i, g), -1))
                trail.pop()
                if path:
                    path.pop()
                continue
            edit, cost, to, after = open_edits.pop()
            rest = left - cost
            if rest < least[to] or rest <= failed.get((to, after), -1):
                continue
            path.append(edit)
            trail.append(((to, after), rest, edits(to, after)))
        bound += 1


def repaired(rows: Iterable[tuple[str, str]], audit: str, state: int = START) -> Iterator[tuple[str, str]]:
    """The rows that the edits of ``audit`` leave, in order."""
    left = iter(rows)
    for edit in audit:
        if edit == "D":
            next(left)
        elif edit == "K":
            role, text = next(left)
            state = SYSTEM if role[:1] == "s" else NEXT[state]
            yield role, text
        else:
            state = NEXT[state]
            yield NAME[state], "" if edit == "I" else next(left)[1]


class Digest:
    """SHA-256 of ``role:text`` lines, fed row by row."""

    def __init__(self):
        self.sha, self.any = hashlib.sha256(), False

    def copy(self) -> Digest:
        other = Digest()
        other.sha, other.any = self.sha.copy(), self.any
        return other

    def add(self, rows: Iterable[tuple[str, str]]) -> Digest:
        for role, text in rows:
            self.sha.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
            self.any = True
        return self


@dataclass
class Block:
    """Rows of one conversation that follow each other, with what was counted in them."""

    rows: list[tuple[str, str]] = field(default_factory=list)
    initials: str = ""
    faults: str = ""
    chars: int = 0
    low: int | None = None
    high: int | None = None
    turns: int = 0

    def add(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        signs = text.rstrip(_SPACE)
        if not signs:
            fault = "b"
        elif seen:
            fault = "d"
        else:
            fault = "-" if signs[-1] in ".!?" else "t"
        self.faults += fault
        self.initials += role[:1] or " "
        self.rows.append((role, "" if fault in "bd" else text))
        self.chars += len(text)
        if turn is not None:
            self.turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn

    def counts(self) -> dict:
        pairs = zip(self.initials, self.initials[1:], strict=False)
        return {
            "blank": self.faults.count("b"), "duplicate": self.faults.count("d"), "truncated": self.faults.count("t"),
            "illegal": sum(a + b not in LEGAL for a, b in pairs), "low": self.low, "high": self.high, "turns": self.turns,
            "first": self.initials[:1] or None, "last": self.initials[-1:] or None}


def _gaps(counts: dict) -> int:
    return 0 if counts["low"] is None else counts["high"] - counts["low"] + 1 - counts["turns"]


def join_counts(a: dict, b: dict) -> dict:
    """Counts of two neighbouring blocks together."""
    if a["first"] is None or b["first"] is None:
        return b if a["first"] is None else a
    both = {c: a[c] + b[c] for c in ("blank", "duplicate", "truncated", "illegal")}
    both["illegal"] += a["last"] + b["first"] not in LEGAL
    both["low"] = b["low"] if a["low"] is None else a["low"]
    both["high"] = a["high"] if b["high"] is None else b["high"]
    both["turns"] = a["turns"] + b["turns"] - (a["high"] is not None and a["high"] == b["low"])
    return both | {"first": a["first"], "last": b["last"]}


class Joined:
    """The cheapest paths through the blocks of a conversation, one to each state of the grammar."""

    def __init__(self):
        #: State to (cost, place in ASCII order, digest so far, edits so far as a chain).
        self.paths = {START: (0, 0, Digest(), None)}
        self.counts = Block().counts()

    def add(self, counts: dict, rows: list[tuple[str, str]], edits: list[tuple[int, int, int, str]]) -> None:
        best: dict[int, tuple[int, int, str, int]] = {}
        for entry, leave, cost, audit in edits:
            if entry in self.paths:
                before = self.paths[entry]
                found = (before[0] + cost, before[1], audit, entry)
                best[leave] = min(found, best.get(leave, found))
        order = {leave: i for i, leave in enumerate(sorted(best, key=lambda g: best[g][1:3]))}
        self.paths = {
            leave: (cost, order[leave], self.paths[entry][2].copy().add(repaired(rows, audit, entry)), (self.paths[entry][3], audit))
            for leave, (cost, _, audit, entry) in best.items()}
        self.counts = join_counts(self.counts, counts)

    def result(self) -> tuple:
        def text(chain) -> str:
            parts = []
            while chain:
                chain, part = chain
                parts.append(part)
            return "".join(reversed(parts))

        ends = [(p[0] + TAIL[g][0], text(p[3]) + TAIL[g][1], g) for g, p in self.paths.items()]
        cost, audit, state = min(ends)
        digest = self.paths[state][2].copy().add(repaired([], TAIL[state][1], state))
        c = self.counts
        return _gaps(c), c["blank"], c["duplicate"], c["truncated"], c["illegal"], cost, audit, digest.sha.hexdigest()


def whole(block: Block) -> tuple:
    """The result of a conversation that is one block."""
    cost, audit = search(block.initials, block.faults)
    c = block.counts()
    sha = Digest().add(repaired(block.rows, audit)).sha.hexdigest()
    return _gaps(c), c["blank"], c["duplicate"], c["truncated"], c["illegal"], cost, audit, sha


def part_of(block: Block, entries: Iterable[int]) -> list[tuple[int, int, int, str]]:
    """``entry, leave, cost, audit`` of a block for each pair of states that can be reached."""
    found = []
    for entry in entries:
        for leave in range(4):
            possible = leave in (USER, ANSWER) or leave == entry
            if leave == SYSTEM and entry == START:
                possible = any(a == "s" and f not in "bd" for a, f in zip(block.initials, block.faults, strict=True))
            # Deletions alone lead nowhere else; another end needs a row that stays.
            if possible and (leave in (entry, SYSTEM) or set(block.faults) - set("bd")):
                found.append((entry, leave, *search(block.initials, block.faults, entry, leave)))
    return found


RESULT = [
    ("gaps", "long"), ("blank", "long"), ("duplicate", "long"), ("truncated", "long"), ("illegal", "long"), ("cost", "long"),
    ("audit", "string"), ("repaired_sha256", "string")]
_COUNTS = "struct<blank:long,duplicate:long,truncated:long,illegal:long,low:long,high:long,turns:long,first:string,last:string>"
_EDITS = "array<struct<entry:int,leave:int,cost:long,audit:string>>"
_ROWS = "array<struct<role:string,text:string>>"
_SCHEMA = ", ".join(f"{c} {t}" for c, t in RESULT)


def _names(kinds: list[str]) -> list[pa.DataType | None]:
    return [{"long": pa.int64(), "string": pa.string(), "int": pa.int32()}.get(k) for k in kinds]


_PA_COUNTS = pa.struct([(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "low", "high", "turns")] + [
    ("first", pa.string()), ("last", pa.string())])
_PA_EDITS = pa.list_(pa.struct([("entry", pa.int32()), ("leave", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_PA_ROWS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def _batch(rows: list[tuple], key: pa.DataType, kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), t) for c, t in zip(columns, [key, *kinds], strict=True)], names)


def _in_ranges(kind: str):
    """The task function over sorted rows of a range: whole results, and blocks of conversations at its edges."""
    names = ["key", *(c for c, _ in RESULT), "range", "block", "counts", "edits", "rows"]
    kinds = [*_names([t for _, t in RESULT]), pa.int32(), pa.int32(), _PA_COUNTS, _PA_EDITS, _PA_ROWS]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId()
        done: list[tuple] = []
        now, started, edge = None, False, True
        block, number, last = Block(), 0, None
        key_type = None

        def as_part() -> None:
            nonlocal block, number
            edits = part_of(block, range(4) if edge or number else [START])
            done.append((
                now, *[None] * len(RESULT), place, number, block.counts(),
                [dict(zip(("entry", "leave", "cost", "audit"), e, strict=True)) for e in edits],
                [{"role": r, "text": t} for r, t in block.rows]))
            block, number = Block(), number + 1

        def finish(at_edge: bool) -> None:
            if number or edge or at_edge:
                as_part()
            else:
                done.append((now, *whole(block), *[None] * 5))

        for batch in batches:
            key_type = batch.schema.field(0).type
            for key, turn, role, digest, later, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not started or key != now:
                    if started:
                        finish(False)
                        edge = False
                    now, started, block, number, last = key, True, Block(), 0, None
                if role is None:
                    continue  # only says that the conversation is there
                same = (turn, role, digest)
                if later:
                    last = same
                    continue
                seen = same == last  # a copy at this turn, or a notice of an earlier one
                if len(block.rows) >= BLOCK or block.chars >= CHARS:
                    as_part()
                block.add(turn, role, text, seen)
                last = same
            if len(done) >= 500:
                yield _batch(done, key_type, kinds, names)
                done = []
        if started:
            finish(True)
            yield _batch(done, key_type, kinds, names)

    return run, f"key {kind}, {_SCHEMA}, range int, block int, counts {_COUNTS}, edits {_EDITS}, rows {_ROWS}"


def _joining(kind: str):
    """The task function over the blocks of conversations in order."""
    kinds = _names([t for _, t in RESULT])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, started, joined, key_type = None, False, Joined(), None
        done: list[tuple] = []
        for batch in batches:
            key_type = batch.schema.field(0).type
            for i in range(len(batch)):
                key, counts, edits, rows = (batch.column(c)[i].as_py() for c in (0, 3, 4, 5))
                if not started or key != now:
                    if started:
                        done.append((now, *joined.result()))
                    now, started, joined = key, True, Joined()
                joined.add(counts, [(r["role"], r["text"]) for r in rows], [tuple(e.values()) for e in edits])
            if len(done) >= 500:
                yield _batch(done, key_type, kinds, ["key", *(c for c, _ in RESULT)])
                done = []
        if started:
            done.append((now, *joined.result()))
            yield _batch(done, key_type, kinds, ["key", *(c for c, _ in RESULT)])

    return run, f"key {kind}, {_SCHEMA}"


def damaged(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``key, turn, role, text`` with seeded damage; a row that is dropped keeps its key, with a null role."""
    space = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    rows = turns.select(
        turns[key].alias("key"), turns[turn].alias("turn"), space(turns[role]).alias("role"), space(turns[text]).alias("text"))
    kind = F.crc32(F.concat(space(F.col("key")), F.lit(":"), space(F.col("turn"))).cast("binary")) % 20
    rows = rows.withColumn("kind", kind)

    def by(number: int, change: Column, column: str) -> Column:
        return F.when(F.col("kind") == number, change).otherwise(F.col(column))

    text_after = F.when(F.col("kind") == 1, F.lit("")).otherwise(by(2, F.regexp_replace("text", "[.!?]", ""), "text"))
    hit = F.col("kind") == 0
    return rows.select(
        "key", F.when(~hit, F.col("turn")).alias("turn"), F.when(~hit, by(4, F.lit("user"), "role")).alias("role"),
        F.when(~hit, text_after).alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    ).drop("col")


def repair(rows: DataFrame) -> DataFrame:
    """A row for each key of ``key, turn, role, text``: its faults and the cheapest repair.

    Rows with a null role only say that the conversation is there.
    """
    kind = dict(rows.dtypes)["key"]
    named = rows.withColumn("digest", F.md5("text"))
    distinct = named.where("role is not null").groupBy("key", "turn", "role", "digest").agg(F.lit(True).alias("later"))
    earlier = Window.partitionBy("key", "role", "digest").orderBy(F.asc_nulls_first("turn"))
    notices = distinct.withColumn("at", F.row_number().over(earlier)).where("at > 1").select(
        "key", "turn", "role", "digest", "later", F.lit(None).cast("string").alias("text"))
    dealt = named.select("key", "turn", "role", "digest", F.lit(False).alias("later"), "text").unionByName(notices)
    order = ["key", F.asc_nulls_first("turn"), "role", "digest"]
    sorted_rows = dealt.repartitionByRange(*order).sortWithinPartitions(*order, F.desc("later"))
    run, schema = _in_ranges(kind)
    found = stored(sorted_rows.mapInArrow(run, schema), "repairs")
    join, joined_schema = _joining(kind)
    parts = found.where("block is not null").select("key", "range", "block", "counts", "edits", "rows")
    joined = parts.repartition("key").sortWithinPartitions("key", "range", "block").mapInArrow(join, joined_schema)
    return found.where("block is null").select("key", *(c for c, _ in RESULT)).unionByName(joined)


ORACLE = r"""
with recursive spaced as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') id from conversations),
bits as (
  select *, flatten([[(ord(c) >> k) & 1 for k in range(0, 8)] for c in string_split(id, '')]) b from spaced),
hit as (
  select *, (xor(4294967295, list_reduce(list_prepend(4294967295::bigint, b),
    lambda c, m: xor(c >> 1, 3988292384 * xor(c & 1, m)))) % 20)::int h from bits),
after as (
  select conv_id, turn, case when h = 4 then 'user' else role end as role,
    case when h = 1 then '' when h = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, copy
  from hit, range(1, 3) s(copy) where h <> 0 and (copy = 1 or h = 3)),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(text), copy) i,
    row_number() over (partition by conv_id, role, text order by turn nulls first, copy) seen,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) signs, coalesce(role[1], '') c from after),
flawed as (
  select *, case when signs = '' then 'b' when seen > 1 then 'd' when signs[-1] not in ('.', '!', '?') then 't' else '-' end f,
    lag(c) over (partition by conv_id order by i) before from placed),
inserts(g, g2, marks, added, cost) as (values
  (0, 0, '', []::varchar[], 0), (1, 1, '', []::varchar[], 0), (2, 2, '', []::varchar[], 0), (3, 3, '', []::varchar[], 0),
  (0, 2, 'I', ['user:'], 2), (1, 2, 'I', ['user:'], 2), (2, 3, 'I', ['assistant:'], 2), (3, 2, 'I', ['user:'], 2),
  (0, 3, 'II', ['user:', 'assistant:'], 4), (1, 3, 'II', ['user:', 'assistant:'], 4),
  (2, 2, 'II', ['assistant:', 'user:'], 4), (3, 3, 'II', ['user:', 'assistant:'], 4)),
edits(e, g2, c, g3, cost) as (
  select 'D', g, null, g, 3 from range(0, 4) s(g)
  union all values ('K', 0, 's', 1, 0), ('K', 0, 'u', 2, 0), ('K', 1, 'u', 2, 0), ('K', 3, 'u', 2, 0), ('K', 2, 'a', 3, 0)
  union all values ('R', 0, null, 2, 2), ('R', 1, null, 2, 2), ('R', 2, null, 3, 2), ('R', 3, null, 2, 2)),
paths as (
  select distinct conv_id, 0::bigint i, 0 g, {'cost': 0::bigint, 'audit': '', 'out': []::varchar[]} best from conversations
  union all
  select p.conv_id, r.i, e.g3 g, min({'cost': p.best.cost + n.cost + e.cost + (e.e <> 'D' and r.f = 't')::bigint,
    'audit': p.best.audit || n.marks || e.e,
    'out': list_concat(p.best.out, n.added, case e.e when 'D' then [] when 'K' then [r.role || ':' || r.text]
      else [case e.g3 when 2 then 'user:' else 'assistant:' end || r.text] end)}) best
  from paths p join flawed r on r.conv_id is not distinct from p.conv_id and r.i = p.i + 1
  join inserts n on n.g = p.g join edits e on e.g2 = n.g2
  where (e.c is null or e.c = r.c) and (e.e = 'D' or r.f in ('t', '-'))
  group by p.conv_id, r.i, e.g3),
ends as (
  select p.conv_id, min({'cost': p.best.cost + n.cost, 'audit': p.best.audit || n.marks,
    'out': list_concat(p.best.out, n.added)}) best
  from paths p join inserts n on n.g = p.g
  where n.g2 in (0, 3) and p.i = (select count(*) from flawed r where r.conv_id is not distinct from p.conv_id)
  group by p.conv_id),
counted as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (f = 'b') blank,
    count(*) filter (f = 'd') duplicate, count(*) filter (f = 't') truncated,
    count(*) filter (i > 1 and before || c not in ('su', 'ua', 'au')) illegal
  from flawed group by conv_id)
select e.conv_id, coalesce(gaps, 0)::bigint gaps, coalesce(blank, 0)::bigint blank, coalesce(duplicate, 0)::bigint duplicate,
  coalesce(truncated, 0)::bigint truncated, coalesce(illegal, 0)::bigint illegal, e.best.cost, e.best.audit,
  sha256(array_to_string(e.best.out, chr(10))) repaired_sha256
from ends e left join counted c on c.conv_id is not distinct from e.conv_id
"""
