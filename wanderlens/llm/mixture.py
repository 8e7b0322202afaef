"""Mix sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Targets share ``share`` times all words by weight, and stop at ``repeat`` times the words of a
source; the excess goes to the others by weight. The words are cut into blocks of ``BLOCK`` words.
Sources get blocks by highest quotients target / (2s + 1), then the shards of a source get its
blocks by highest quotients words / (2s + 1). A shard lays its documents out in seeded order on a
circle and takes its quota of blocks from a seeded place on, going round again where the quota is
more than the circle. So a shard takes whole documents but for the two at the ends of its arc, the
quotas are whole numbers, and a rerun takes the same words.

Only sizes are shuffled. A source of any size is split into shards of about ``SHARD_WORDS`` words,
so no window holds more than one shard. Per source there is one row, and the ranking of quotients
sees about two rows for each source.

Defined cases: a null text has size 0; documents of size 0 and sources without words take nothing;
the null source is a source of its own, last in order; repeated rows are documents of their own;
an empty table gives an empty result; other columns are ignored, or carried along by ``take``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wanderlens.llm.text import n_words, seeded_order, unit_of
from wanderlens.sources.stored import stored

WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEAT = 2
BLOCK = 64
SHARD_WORDS = 1 << 18
SHARD_ROWS = 1 << 11
SEED = 20


def sainte_lague(parties: DataFrame, within: list[str], votes: str, seats: str, order: list[str]) -> DataFrame:
    """``parties`` with ``quota``: the whole-number share of ``seats`` of each group.

    Seats at a divisor are floor(votes / divisor + 1/2). Two divisors around the exact one give a
    lower and an upper number of seats for each party, about two apart; only the quotients between
    them are ranked, so the work grows with the parties and not with the seats.
    """
    group = Window.partitionBy(*within)
    total, m = F.sum(votes).over(group), F.count(F.lit(1)).over(group)
    bounds = parties.withColumns({"_total": total, "_m": m}).where(F.col(votes) > 0)

    def at(seats_wanted: Column) -> Column:
        return F.greatest(F.lit(0), F.floor(F.col(votes) * seats_wanted / F.col("_total") + 0.5)).cast("long")

    slack = F.col("_m") / 2.0 + 1.0
    bounds = bounds.withColumns({"_lo": at(F.col(seats) - slack), "_hi": at(F.col(seats) + slack)})
    bounds = bounds.withColumn("_open", F.col(seats) - F.sum("_lo").over(group))
    ranked = bounds.withColumn("_s", F.explode_outer(F.when(
        F.col("_hi") > F.col("_lo"), F.sequence("_lo", F.col("_hi") - 1)))).withColumn(
        "_rank", F.row_number().over(group.orderBy(
            F.desc(F.col(votes) / (2 * F.col("_s") + 1)), *[F.asc_nulls_last(c) for c in order])))
    won = F.count(F.when(F.col("_rank") <= F.col("_open"), F.col("_s")))
    return ranked.groupBy(*parties.columns).agg((F.first("_lo") + won).alias("quota"))


def targets(sizes: DataFrame, share: float = SHARE, repeat: int = REPEAT, weights: tuple = WEIGHTS) -> DataFrame:
    """One row for each source: ``source, source_size, n_docs, weight, target``."""
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    sources = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    sources = sources.withColumn("_place", (F.row_number().over(by_name) - 1) % len(weights)).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), F.col("_place") + 1).cast("double"))
    # Sources fill up in the order of cap / weight: with those before a source at their caps, the
    # level of the rest is known, and a source is at its cap where its ratio is not above that level.
    fill = Window.orderBy("_ratio", F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    sources = sources.withColumn("_cap", (repeat * F.col("source_size")).cast("double"))
    sources = sources.withColumn("_ratio", F.col("_cap") / F.col("weight"))
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(fill), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(fill), F.lit(0.0)))
    sources = sources.withColumn("_level", level)
    final = F.max(F.when(F.col("_ratio") > F.col("_level"), F.col("_level"))).over(everything)
    return sources.withColumn("_final", final).select(
        "source", "source_size", "n_docs", "weight",
        F.when(F.col("_ratio") > F.col("_level"), F.col("weight") * F.col("_final")).otherwise(F.col("_cap"))
        .alias("target"))


def _sharded(frame: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with the figures of their source and ``_shard``; nearly equal shards by a seeded hash."""
    per = sources.select(F.col("source").alias("_of"), "source_size", "target", F.greatest(
        F.ceil(F.col("source_size") / SHARD_WORDS), F.ceil(F.col("n_docs") / SHARD_ROWS)).cast("long").alias("_shards"))
    joined = frame.join(per, F.col("_source").eqNullSafe(F.col("_of"))).drop("_of")
    return joined.withColumn("_shard", F.floor(unit_of(F.col("_order")) * F.col("_shards")).cast("long"))


def mix(
    docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", carry: bool = False,
    share: float = SHARE, repeat: int = REPEAT, weights: tuple = WEIGHTS, block: int = BLOCK, seed: int = SEED,
) -> DataFrame:
    """A row for each document: ``row`` (its key, or with ``carry`` all its columns), ``size``,
    ``source_size``, ``target``, ``taken``, ``full`` (whole copies), ``parts`` (word ranges taken once more)."""
    kept = F.struct(*[docs[c] for c in (docs.columns if carry else [key])])
    sized = docs.select(
        kept.alias("row"), docs[source].alias("_source"), n_words(docs[text]).alias("size"),
        seeded_order(docs[key], seed).alias("_order"))
    slim = stored(sized.select("_source", "size", "_order", *([] if carry else ["row"])), "mixture")
    frame = sized if carry else slim
    sources = stored(targets(slim.withColumnRenamed("_source", "source"), share, repeat, weights), "mixture")

    blocks = sources.withColumn("_seats", F.round(F.sum("target").over(Window.partitionBy()) / block).cast("long"))
    per_source = sainte_lague(blocks, [], "target", "_seats", ["source"]).select(
        F.col("source").alias("_of"), F.col("quota").alias("_blocks"))
    shards = _sharded(slim.select("_source", "size", "_order"), sources).groupBy("_source", "_shard").agg(
        F.sum("size").cast("double").alias("_words"))
    shards = shards.join(per_source, F.col("_source").eqNullSafe(F.col("_of"))).drop("_of")
    quotas = sainte_lague(shards, ["_source"], "_words", "_blocks", ["_shard"])
    words = F.col("_words").cast("long")
    wanted = F.least(F.col("quota") * block, repeat * words)
    spin = unit_of(seeded_order(F.concat_ws(":", F.coalesce("_source", F.lit("null")), "_shard"), seed + 1))
    quotas = stored(quotas.select(
        F.col("_source").alias("_of"), F.col("_shard").alias("_in"), words.alias("_words"),
        F.floor(wanted / words).cast("long").alias("full"), (wanted % words).alias("_arc"),
        (F.floor(spin * F.ceil(words / block)) * block).cast("long").alias("_from")), "mixture")

    rows = _sharded(frame, sources)
    line = Window.partitionBy("_source", "_shard").orderBy("_order", "size").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_end", F.sum("size").over(line)).withColumn("_start", F.col("_end") - F.col("size"))
    rows = rows.join(quotas, F.col("_source").eqNullSafe(F.col("_of")) & (F.col("_shard") == F.col("_in")), "left")
    start, end, arc_from, arc_to = F.col("_start"), F.col("_end"), F.col("_from"), F.col("_from") + F.col("_arc")
    first = F.greatest(start, arc_from)
    n_first = F.greatest(F.lit(0), F.least(end, arc_to, F.col("_words")) - first)
    n_second = F.greatest(F.lit(0), F.least(end, arc_to - F.col("_words")) - start)
    none = F.lit(0).cast("long")
    rows = rows.withColumns({
        "full": F.coalesce("full", none), "_n1": F.coalesce(n_first, none), "_n2": F.coalesce(n_second, none)})
    part = lambda at, n: F.struct(at.cast("long").alias("at"), n.cast("long").alias("words"))
    return rows.select(
        "row", "size", "source_size", "target",
        (F.col("size") * F.col("full") + F.col("_n1") + F.col("_n2")).cast("long").alias("taken"), "full",
        F.filter(F.array(part(first - start, F.col("_n1")), part(F.lit(0), F.col("_n2"))), lambda p: p["words"] > 0)
        .alias("parts"))


def take(docs: DataFrame, text: str = "text", chars: str = "n_chars", **options) -> DataFrame:
    """The mix as documents: whole copies, then the ranges of words taken once more, with their white space.

    A document that the mix does not take is gone; one that it takes twice is there twice.
    """
    mixed = mix(docs, text=text, carry=True, **options)
    words = F.regexp_extract_all(F.col(f"row.{text}"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    whole = F.transform(F.array_repeat(F.lit(1), F.col("full").cast("int")), lambda _: F.col(f"row.{text}"))
    cut = F.transform("parts", lambda p: F.when(p["words"] == F.col("size"), F.col(f"row.{text}")).otherwise(
        F.array_join(F.slice(words, (p["at"] + 1).cast("int"), p["words"].cast("int")), "")))
    copies = mixed.select("row", F.explode(F.concat(whole, cut)).alias("_text"))
    replaced = {text: F.col("_text"), chars: F.length("_text").cast("long")}
    return copies.select(*[replaced.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
