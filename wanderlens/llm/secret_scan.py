"""Find secrets: three patterns, and random strings told from identifiers by two Markov models.

The models are first-order character chains over ``ALPHABET``: one trained on labelled random
strings, the values that the patterns find, the other on ordinary identifiers, the long words of
texts outside those finds that are no candidates themselves. A candidate, a run of at least ``SHORTEST`` characters that holds a
letter and a digit, is a secret if its log-likelihood ratio per transition is above ``MARGIN``.

The training sample is bounded: the ``SAMPLE`` documents with a find and the ``SAMPLE`` documents
of all that come first in a seeded order. The counts that reach the driver are at most one for each
pair of characters. Scanning is one pass of built-in expressions without a shuffle.

Defined cases: a null text is an empty one; the order of rows and repeated rows do not matter to a
row's spans; an empty table, or one without finds to train on, adds no spans; other columns are
carried along in ``row``. The positions of a text's finds are running sums, computed in parts of ``PART``; of a
candidate that begins with a base match only what follows that is looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wanderlens.llm.text import first_rows, seeded_order

#: The base patterns. The longer minimum of the last two gives the same matches as
#: a plain run that is dropped if it is too short.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-="
SHORTEST = 16
CANDIDATE = r"[A-Za-z0-9+/_-]{16,}={0,2}"
ANY_BASE = "|".join(f"(?:{p})" for p in (ASSIGN, ACCESS, HEX))
#: The third group is a candidate that starts in no match of a base pattern.
ANY_OR_CANDIDATE = f"{ANY_BASE}|({CANDIDATE})"
PART = 256
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_-]{7,}"
SAMPLE = 2000
PRIOR = 5.0
MARGIN = 0.5
SEED = 7


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(numbers: Column) -> Column:
    """Running sums of an array, ``PART`` numbers at a time.

    Appending to an array copies it, so the sums of a part and the sums before the parts are kept apart:
    n numbers cost n * PART / 2 + (n / PART) ** 2 / 2 copies.
    """
    def sums(start: Column, part: Column) -> Column:
        state = F.struct(start.alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        return F.aggregate(part, state, lambda s, x: F.struct(
            (s["at"] + x).alias("at"), F.array_append(s["out"], s["at"] + x).alias("out")))["out"]

    def of_parts(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda s, x: s + x))
        before = _let(sums(F.lit(0), totals), lambda t: F.transform(parts, lambda p, i: F.when(i == 0, 0).otherwise(F.get(t, i - 1))))
        return _let(before, lambda starts: F.flatten(F.transform(parts, lambda p, i: sums(F.get(starts, i), p))))

    cut = lambda all_: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / PART).cast("int")), lambda i: F.slice(all_, i * PART + 1, F.lit(PART)))
    return _let(numbers, lambda all_: F.when(F.size(all_) > 0, _let(cut(all_), of_parts)).otherwise(F.expr("cast(array() as array<int>)")))


def _matches(text: Column, pattern: str, kind: int, extra: Column | None = None) -> Column:
    """(start, kind, end, match, value) of the leftmost matches that do not overlap, in code points."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,match:string,value:string>>)")

    def spans(m: Column) -> Column:
        widths = F.transform(m["whole"], lambda w, i: F.length(F.get(m["pieces"], i)) + F.length(w))
        return _let(_running(widths), lambda ends: F.transform(m["whole"], lambda w, i: F.struct(
            (F.get(ends, i) - F.length(w)).alias("start"), F.lit(kind).alias("kind"), F.get(ends, i).alias("end"),
            w.alias("match"), F.get(m["value"], i).alias("value"))))

    found = F.struct(F.split(text, pattern, -1).alias("pieces"), whole.alias("whole"), (extra if extra is not None else whole).alias("value"))
    return F.when(text.rlike(pattern), _let(found, spans)).otherwise(empty)


def base_spans(text: Column) -> tuple[Column, Column, Column]:
    assign = _matches(text, ASSIGN, 0, F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)))
    return (F.filter(assign, lambda m: F.length(m["value"]) >= 8), _matches(text, ACCESS, 1), _matches(text, HEX, 2))


def _pair_counts(strings: DataFrame) -> dict[tuple[str, str], int]:
    """How often one character of the alphabet follows another; at most one row for each pair."""
    at = F.sequence(F.lit(1), F.length("s") - 1)
    pairs = strings.where(F.length("s") > 1).select(
        F.explode(F.transform(at, lambda i: F.substring(F.col("s"), i, F.lit(2)))).alias("p"))
    known = pairs.where(F.col("p").rlike(f"^[{ALPHABET.replace('-', '')}-]{{2}}$"))
    return {(r["p"][0], r["p"][1]): r["n"] for r in known.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}


def _log_chain(counts: dict[tuple[str, str], int]) -> list[list[float]]:
    """log P(next | character), mixed with the share of the next among all as ``PRIOR`` more transitions."""
    ends = {b: sum(counts.get((a, b), 0) for a in ALPHABET) + 0.5 for b in ALPHABET}
    all_ends = sum(ends.values())
    table = []
    for a in ALPHABET:
        total = sum(counts.get((a, b), 0) for b in ALPHABET) + PRIOR
        table.append([math.log((counts.get((a, b), 0) + PRIOR * ends[b] / all_ends) / total) for b in ALPHABET])
    return table


def _looks_random(word: Column) -> Column:
    """What a scan would take for a candidate."""
    return (F.length(word) >= SHORTEST) & word.rlike("[0-9]") & word.rlike("[A-Za-z]")


def train(docs: DataFrame, text: str = "text", key: str = "doc_id", sample: int = SAMPLE) -> list[float] | None:
    """Log ratio of the two chains for each pair of characters; None without labelled secrets."""
    plain = docs.select(F.coalesce(docs[text], F.lit("")).alias("t"), seeded_order(docs[key], SEED).alias("o"))
    any_base = ANY_BASE
    secret = first_rows(plain, plain.where(F.col("t").rlike(any_base)), "o", "t", sample)
    values = secret.select(F.explode(F.concat(*base_spans(F.col("t")))).alias("m")).select(F.col("m.value").alias("s"))
    random = _pair_counts(values)
    if not random:
        return None
    ordinary = first_rows(plain, plain, "o", "t", sample)
    outside = F.regexp_replace("t", any_base, " ")
    words = ordinary.select(F.explode(F.regexp_extract_all(outside, F.lit(IDENTIFIER), F.lit(0))).alias("s"))
    names = _pair_counts(words.where(~_looks_random(F.col("s"))))
    pairs = zip(_log_chain(random), _log_chain(names), strict=True)
    return [r - n for rs, ns in pairs for r, n in zip(rs, ns, strict=True)]


def likelihood_ratio(string: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio of the transitions of a string over the alphabet."""
    table, width = F.lit(ratios), len(ALPHABET)
    codes = F.transform(F.split(string, "", -1), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    # The split ends with an empty string, which is no transition.
    steps = _let(codes, lambda of: F.aggregate(
        F.sequence(F.lit(1), F.length(string) - 1), F.lit(0.0), lambda s, i: s + F.get(table, F.get(of, i - 1) * width + F.get(of, i))))
    return steps / (F.length(string) - 1)


def scan(docs: DataFrame, ratios: list[float] | None, text: str = "text", margin: float = MARGIN) -> DataFrame:
    """A row for each document: ``row`` (all its columns) and ``spans``, an array of
    (start, kind, end, match, value) by start, then kind; kind counts ``KINDS`` from 0."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    body = F.coalesce(F.col(f"row.{text}"), F.lit(""))
    rows = rows.withColumn("base", F.array_sort(F.concat(*base_spans(body))))
    if ratios is None:
        return rows.withColumnRenamed("base", "spans")
    free = lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    # What a base pattern matches is passed over, so that of a list of hashes nothing is left to compare with the finds.
    runs = _matches(body, ANY_OR_CANDIDATE, 3, F.regexp_extract_all(body, F.lit(ANY_OR_CANDIDATE), F.lit(3)))
    added = F.filter(runs, lambda c: (
        _looks_random(c["value"]) & free(c)
        & (likelihood_ratio(c["match"], ratios) > margin)))
    return rows.select("row", F.array_sort(F.concat("base", added)).alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
