"""Remove repeated passages of three or more lines by overlapping three-line windows.

Every three consecutive lines are a window, known by two 64-bit hashes. Windows that occur more
than once in the whole table are found by one aggregation, which also gives their first occurrence
by (key, line number). All later occurrences are removed: the lines that their windows cover are
merged and dropped, so a passage of any length from three lines goes as a whole, also where it
overlaps itself. A line goes only if the first occurrence of its window holds the same line
earlier, so every distinct line of the corpus stays at its first place.

A window that a third of all documents share is counted on the map side, and its occurrences meet
the table of repeated windows in ``SALT`` parts.

Defined cases: a null text stays null; an empty text and one of fewer than three lines stay as they
are; rows that share a key are copies of one document and lose the same lines; an empty table gives
an empty result; other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALT = 8


def repeated_lines(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, lines``: the numbers of the lines that go, for each document that loses any."""
    lines = docs.select(docs[key].alias("key"), F.split(docs[text], "\n", -1).alias("lines"))
    count = F.greatest(F.size("lines") - 2, F.lit(0))
    three = F.arrays_zip(*[F.slice("lines", k, count).alias(f"l{k}") for k in (1, 2, 3)])
    words = [F.col(f"w.l{k}") for k in (1, 2, 3)]
    windows = lines.select("key", F.posexplode(three).alias("line", "w")).select(
        "key", "line", F.xxhash64(*words).alias("a"), F.xxhash64(F.lit("#"), *words).alias("b"))
    repeated = windows.groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "line")).alias("first")
    ).where("n > 1").select(
        F.col("a").alias("ra"), F.col("b").alias("rb"), "first",
        F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("rs"))
    salted = windows.withColumn("s", F.pmod(F.xxhash64("key"), F.lit(SALT)).cast("int"))
    later = salted.join(repeated, (F.col("a") == F.col("ra")) & (F.col("b") == F.col("rb")) & (F.col("s") == F.col("rs")))
    later = later.where(~F.struct("key", "line").eqNullSafe(F.col("first")))
    return later.groupBy("key").agg(F.collect_set("line").alias("starts")).select("key", F.array_distinct(
        F.flatten(F.transform("starts", lambda s: F.array(s, s + 1, s + 2)))).alias("lines"))


def line_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row for each document: ``row`` (all its columns), ``n_lines``, ``n_removed``, ``text`` (what stays)."""
    gone = repeated_lines(docs, text, key)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    joined = rows.join(gone, F.col(f"row.{key}").eqNullSafe(F.col("key")), "left")
    # The array of lines is a column of its own, so that it is made once and not for every line.
    joined = joined.select("row", "lines", F.split(F.col(f"row.{text}"), "\n", -1).alias("all"))
    n_lines = F.coalesce(F.size("all"), F.lit(0))
    n_removed = F.coalesce(F.size("lines"), F.lit(0))
    stay = F.array_except(F.sequence(F.lit(0), F.size("all") - 1), F.col("lines"))
    kept = F.array_join(F.transform(stay, lambda i: F.element_at("all", i + 1)), "\n")
    return joined.select(
        "row", n_lines.cast("long").alias("n_lines"), n_removed.cast("long").alias("n_removed"),
        F.when(F.col("lines").isNull(), F.col(f"row.{text}")).otherwise(kept).alias("text"))


def without_repeats(docs: DataFrame, text: str = "text", chars: str = "n_chars", key: str = "doc_id") -> DataFrame:
    """The documents with their columns, texts without the repeated passages."""
    done = line_dedup(docs, text, key)
    replaced = {text: F.col("text"), chars: F.when(
        F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col(f"row.{chars}"))}
    return done.select(*[replaced.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


ORACLE = """
with lined as (select doc_id, string_split(text, chr(10)) ls from documents where text is not null),
occ as (select doc_id, i, ls[i + 1] || chr(10) || ls[i + 2] || chr(10) || ls[i + 3] w
        from (select doc_id, ls, unnest(range(0, greatest(len(ls) - 2, 0))) i from lined)),
repeated as (select w, min(struct_pack(d := doc_id, i := i)) f from occ group by w having count(*) > 1),
later as (select distinct doc_id, i + k line from occ join repeated using (w), range(0, 3) r(k)
          where doc_id <> f.d or i <> f.i),
gone as (select doc_id, list(line) lines from later group by doc_id)
select d.doc_id, coalesce(len(l.ls), 0)::bigint n_lines, coalesce(len(g.lines), 0)::bigint n_removed,
       case when g.lines is null then d.text else
         array_to_string([l.ls[j + 1] for j in range(0, len(l.ls)) if not list_contains(g.lines, j)], chr(10)) end as text
from documents d left join lined l on d.doc_id = l.doc_id left join gone g on d.doc_id = g.doc_id
"""
