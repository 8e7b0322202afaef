"""Judge URLs: host and path rules first, then a list of canonical URLs behind a blocked Bloom filter.

The filter is a table of blocks of 256 bits. A listed URL hashes to one block and sets ``PROBES``
bits in it; bits are merged by ``bit_or``. The number of blocks follows the list up to
``MAX_BLOCKS``, so the filter is at most 6 MB and may be broadcast; a longer list only
lets more URLs through to the next step. Possible hits meet the list in a hash join on the
canonical URL, which removes the false positives, so the verdict does not depend on the filter.
One URL may be asked for by a third of all pages: the hits are salted, and the list, reduced to one
row for each URL, is repeated ``SALT`` times.

Rules are a short list that is part of the query. The longest rule that fits wins.

Defined cases: a null URL or one without ``://`` has an empty host and path, no rule and no
canonical form, and is allowed; repeated rows are judged alike; an empty table gives an empty
result; other columns are carried along in ``row``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (verdict, host, path) as dealt.
RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
)
#: Host labels whose pages the query takes as its list, and query parameters without meaning.
LISTED_LABELS = ("spam-farm", "cheap-pills", "adult-x", "free-bets")
NOISE = r"^(utm_[^=]*|ref)(=|$)"

WORDS, PROBES, BITS_PER_URL = 4, 6, 16
MAX_BLOCKS = 1 << 17
SALT = 8

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, F.lit("://"))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.``, path without ``.html`` and last slashes, sorted parameters but noise, no fragment."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&", -1), lambda p: (p != "") & ~p.rlike(NOISE)))
    page = F.regexp_replace(F.regexp_replace(path(url), r"\.html$", ""), "/+$", "")
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.when(_rest(url).isNotNull(), F.concat(F.regexp_replace(host(url), r"^www\.", ""), page, tail))


def fitting(on_host: Column, on_path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for word, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((on_host == h) | on_host.endswith("." + h)) & on_path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(word)).otherwise(verdict)
    return rule, verdict


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks)).cast("int")


def _masks(url: Column) -> list[Column]:
    """The bits of a URL in each 64-bit word of its block; every probe takes eight bits of one hash."""
    bits = F.xxhash64(F.lit("bits"), url)
    places = [F.shiftrightunsigned(bits, 8 * k).bitwiseAND(F.lit(255)).cast("int") for k in range(PROBES)]
    masks = []
    for word in range(WORDS):
        mask = F.lit(0).cast("long")
        for place in places:
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), place % 64)
            mask = mask.bitwiseOR(F.when(F.shiftright(place, 6) == word, bit).otherwise(F.lit(0).cast("long")))
        masks.append(mask)
    return masks


def bloom(listed: DataFrame, n: int, column: str = "url") -> tuple[DataFrame, int]:
    """``block, w0..w3`` of the canonical URLs in ``column``, and the number of blocks for ``n`` of them."""
    blocks = min(MAX_BLOCKS, max(1, -(-n * BITS_PER_URL // (64 * WORDS))))
    masks = {f"w{i}": m for i, m in enumerate(_masks(F.col(column)))}
    rows = listed.where(F.col(column).isNotNull()).select(_block(F.col(column), blocks).alias("block"), *[
        m.alias(w) for w, m in masks.items()])
    return rows.groupBy("block").agg(*[F.bit_or(w).alias(w) for w in masks]), blocks


def possible_hits(rows: DataFrame, table: DataFrame, blocks: int, column: str) -> DataFrame:
    """``rows`` with ``possible``: true for every URL that is listed, and for few others."""
    asked = rows.withColumn("_block", _block(F.col(column), blocks))
    met = asked.join(F.broadcast(table), F.col("_block") == F.col("block"), "left")
    hit = F.lit(True)
    for i, mask in enumerate(_masks(F.col(column))):
        hit = hit & (F.col(f"w{i}").bitwiseAND(mask) == mask)
    return met.select(*[rows[c] for c in rows.columns], F.coalesce(hit, F.lit(False)).alias("possible"))


def judge(pages: DataFrame, listed: DataFrame, url: str = "url", rules: tuple = RULES) -> DataFrame:
    """A row for each page: ``row`` (its columns), ``host, path, rule, verdict, canonical``.

    ``listed`` has a column ``url`` of URLs in any form. Only pages without a rule ask the filter.
    """
    rows = pages.select(F.struct(*[pages[c] for c in pages.columns]).alias("row"))
    address = F.col(f"row.{url}")
    rows = rows.select(
        "row", host(address).alias("host"), path(address).alias("path"), canonical(address).alias("canonical"))
    rule, verdict = fitting(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "verdict": verdict}).withColumn(
        "_asked", F.when(F.col("verdict").isNull(), F.col("canonical")))
    names = listed.select(canonical(F.col("url")).alias("url")).where("url is not null").distinct()
    table, blocks = bloom(names, names.count())
    rows = possible_hits(rows, table, blocks, "_asked")

    kept = ["row", "host", "path", "rule", "verdict", "canonical"]
    clear = rows.where("not possible").withColumn("verdict", F.coalesce("verdict", F.lit("allow")))
    spread = names.select(F.col("url").alias("_url"), F.explode(
        F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_part"))
    checked = rows.where("possible").withColumn("_salt", F.pmod(F.xxhash64("row"), F.lit(SALT)).cast("int")).join(
        spread.hint("shuffle_hash"), (F.col("_asked") == F.col("_url")) & (F.col("_salt") == F.col("_part")), "left")
    checked = checked.withColumn("verdict", F.when(F.col("_url").isNull(), "allow").otherwise("block"))
    return clear.select(*kept).unionByName(checked.select(*kept))


def labelled(pages: DataFrame, url: str = "url", labels: tuple = LISTED_LABELS) -> DataFrame:
    """The list of the query: URLs of the pages on hosts with one of the labels."""
    on = F.concat(F.lit("."), host(pages[url]), F.lit("."))
    marked = F.lit(False)
    for label in labels:
        marked = marked | on.contains(f".{label}.")
    return pages.where(marked).select(pages[url].alias("url"))


ORACLE = rf"""
with split as (select page_id, url, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) end rest from pages),
parts as (select page_id, rest,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '') host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') path from split),
named as (select *, case when rest is not null then regexp_replace(host, '^www\.', '')
    || regexp_replace(regexp_replace(path, '\.html$', ''), '/+$', '') || coalesce((select '?' || string_agg(p, '&' order by p)
      from (select unnest(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&')) p)
      where p <> '' and not regexp_matches(p, '{NOISE}')), '') end canonical from parts),
rules(word, h, p) as (values {", ".join(str(r) for r in RULES)}),
fits as (select page_id, arg_max(h || p, length(h || p)) rule, arg_max(word, length(h || p)) word
    from named, rules where (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id),
listed as (select distinct canonical from named where {" or ".join(f"contains('.' || host || '.', '.{x}.')" for x in LISTED_LABELS)})
select n.page_id, n.host, n.path, f.rule,
    coalesce(f.word, case when l.canonical is null then 'allow' else 'block' end) verdict
from named n left join fits f on n.page_id = f.page_id left join listed l on n.canonical = l.canonical
"""
