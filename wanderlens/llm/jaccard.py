"""Similarity join on word shingles by grouped prefixes, without a list of all pairs.

1. A filter keeps the documents that can have a partner at all: at least three quarters of their
   shingles occur in another document. It travels as packed arrays: each task sorts the shingles of
   its documents into buckets, a bucket counts them and sends back how many of each document it has
   seen elsewhere.
2. Equal sets are one class from here on. Shingles are ordered by the number of classes that hold
   them, then by hash. Two sets that overlap enough share a shingle of their prefixes, the first
   n - ceil(3n / 4) + 1 in that order; a shingle of one class alone cannot be it.
3. Classes with identical prefix and size are one group. Only groups are posted to the shingles
   of their prefix; what a shingle brings together is filtered by size and place there, then
   groups are expanded to their classes, and every pair is verified on the full sets.
4. In the list of a shingle first all groups are paired with one only, that with the fewest
   shingles of its own. The components of the verified links then tell which lists still hold
   different components. Classes that such lists connect are compared in blocks, those outside the
   largest component with all others, by products of 0/1 matrices: blocks return links, not pairs.
   So thousands of near copies cost one pair each, and no link between components is missed.
5. All links lie within components. There every class is compared with every other in blocks of
   at most ``BLOCK`` classes, again by matrices: a block returns for each class how many documents it links
   with, not the pairs. Components of one block share tasks, larger ones are spread over their pairs of blocks.

Hashes have 64 bits. Nothing that grows with the documents is broadcast or collected but the keys of
documents that pass the filter, if there are at most ``SENT`` of them; else they are joined.

Defined cases: a null or blank text has an empty set and links with nothing, like a null key;
repeated rows are equal sets; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wanderlens.llm.components import components
from wanderlens.llm.shingles import parts, shingle_sets
from wanderlens.llm.text import unused
from wanderlens.sources.stored import stored

#: Documents packed together, at most; documents to a bucket; keys sent to every task, at most.
PACKED = 2000
PER_BUCKET = 2000
SENT = 200_000
SALT = 8
#: Classes in a block of comparisons, and columns of its matrices.
BLOCK = 512
COLUMNS = 8192
#: Shingles in a block or task that counts links, about.
SHINGLES = 1 << 21


def _press(numbers: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes."""
    planes = numbers.view(np.uint8).reshape(len(numbers), -1).T
    return zstandard.compress(planes.tobytes(), 1)


def _expand(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


SENT_SCHEMA = ("pack long, bucket int, owners binary, marks binary, "
               "keys array<bigint>, sizes array<int>, sets array<binary>, local array<int>")
BACK_SCHEMA = ("pack long, owners binary, shared binary, "
               "keys array<bigint>, sizes array<int>, sets array<binary>, local array<int>")
NOBODY = np.uint16(65535)


def _pack(number: int, part: pd.DataFrame, buckets: int, bits: int) -> pd.DataFrame:
    """One row for each bucket with shingles of these documents, and one with the documents."""
    sets = list(shingle_sets(part["text"]))
    sizes = [len(s) for s in sets]
    marks = np.concatenate(sets) >> np.uint64(64 - bits)
    owner = np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
    order = np.argsort(marks, kind="stable")
    marks, owner = marks[order], owner[order]
    # What two documents of the pack share is counted here and sent once, without an owner.
    first = np.concatenate([[True], marks[1:] != marks[:-1]]) if len(marks) else np.empty(0, bool)
    last = np.concatenate([first[1:], [True]]) if len(marks) else first
    alone = first & last
    local = np.bincount(owner[~alone], minlength=len(sets))
    marks, owner = marks[first], np.where(alone, owner, NOBODY)[first]
    of = (marks % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    marks, owner = marks[order], owner[order]
    cuts = np.searchsorted(of[order], np.arange(buckets + 1))
    rows = [(number, int(b), _press(owner[cuts[b] : cuts[b + 1]]),
             _press(np.diff(marks[cuts[b] : cuts[b + 1]], prepend=np.uint64(0))), None, None, None, None)
            for b in np.flatnonzero(np.diff(cuts))]
    rows.append((number, number % buckets, None, None, part["key"].tolist(), sizes,
                 [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], local.tolist()))
    return pd.DataFrame(rows, columns=["pack", "bucket", "owners", "marks", "keys", "sizes", "sets", "local"])


def _count_bucket(bucket: pd.DataFrame) -> pd.DataFrame:
    """Sends back, for each pack, the owners of shingles that other packs have too. Documents pass through."""
    through = bucket[bucket["marks"].isna()].assign(shared=None)
    sent = bucket[bucket["marks"].notna()]
    columns = ["pack", "owners", "shared", "keys", "sizes", "sets", "local"]
    rows = []
    if len(sent):
        marks = [np.cumsum(_expand(m, "<u8"), dtype=np.uint64) for m in sent["marks"]]
        _, back, count = np.unique(np.concatenate(marks), return_inverse=True, return_counts=True)
        elsewhere = np.split(count[back] > 1, np.cumsum([len(m) for m in marks])[:-1])
        for pack, owners, both in zip(sent["pack"], sent["owners"], elsewhere, strict=True):
            owner = _expand(owners, "<u2")[both]
            who, times = np.unique(owner[owner != NOBODY], return_counts=True)
            rows.append((pack, who.astype("<u2").tobytes(), times.astype("<u4").tobytes(), None, None, None, None))
    return pd.concat([through[columns], pd.DataFrame(rows, columns=columns)])


def _sum_pack(pack: pd.DataFrame) -> pd.DataFrame:
    own = pack[pack["keys"].notna()].iloc[0]
    shared = np.array(own["local"], np.int64)
    for who, times in pack.loc[pack["shared"].notna(), ["owners", "shared"]].itertuples(index=False):
        shared[np.frombuffer(who, "<u2")] += np.frombuffer(times, "<u4")
    return pd.DataFrame({"key": own["keys"], "n": own["sizes"], "same": own["sets"], "shared": shared})


def fingerprints(docs: DataFrame) -> DataFrame:
    """From ``key, text`` of every document: ``key, n, same, shared``.

    ``n`` is the size of its set, ``same`` a digest of it, ``shared`` the number of its shingles that
    other documents have as well, by hashes of fewer bits: it may be too large, never too small.
    """
    count = docs.count()
    buckets = max(8, -(-count // PER_BUCKET))
    bits = min(60, max(36, 20 + count.bit_length()))

    def send(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in parts([len(t or "") for t in batch["text"]], PACKED):
                yield _pack(number, batch.iloc[part], buckets, bits)
                number += 1

    packed = docs.mapInPandas(send, SENT_SCHEMA)
    counted = packed.groupBy("bucket").applyInPandas(_count_bucket, BACK_SCHEMA)
    return counted.groupBy("pack").applyInPandas(_sum_pack, "key long, n int, same binary, shared long")


def _sets(docs: DataFrame, keys: DataFrame, n_keys: int) -> DataFrame:
    """``id, n, shingles`` of the documents that ``keys`` names, from ``key, text``."""

    def hash_all(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in parts([len(t or "") for t in batch["text"]], 200):
                sets = [s.view(np.int64) for s in shingle_sets(batch["text"].iloc[part])]
                yield pd.DataFrame({
                    "id": batch["key"].iloc[part].to_numpy(), "n": [len(s) for s in sets], "shingles": sets})

    named = F.broadcast(keys) if n_keys <= SENT else keys
    rows = docs.join(named, docs["key"] == named["id"], "left_semi")
    return rows.mapInPandas(hash_all, "id long, n int, shingles array<bigint>").dropDuplicates(["id"])


def _prefixes(sets: DataFrame) -> DataFrame:
    """``id, n, alone, tokens``: the part of each prefix that other sets hold too, ``alone`` places from its start."""
    rows = sets.select("id", "n", F.explode("shingles").alias("token"))
    often = rows.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    known = rows.join(often, "token").groupBy("id", "n").agg(
        F.sort_array(F.collect_list(F.struct("df", "token"))).alias("order"))
    alone = F.col("n") - F.size("order")
    length = F.col("n") - F.floor((3 * F.col("n") + 3) / 4).cast("int") + 1
    return known.withColumns({"alone": alone, "here": length - alone}).where("here > 0").select(
        "id", "n", "alone", F.slice(F.col("order.token"), F.lit(1), F.least("here", F.size("order"))).alias("tokens"))


def _may_link(n1: str, at1: str, n2: str, at2: str):
    """Size filter, and place filter: what is left of both after a common token must be enough."""
    a, b = F.col(n1), F.col(n2)
    left = F.least(a - F.col(at1), b - F.col(at2))
    return (4 * F.least(a, b) >= 3 * F.greatest(a, b)) & (7 * left >= 3 * (a + b))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets have a Jaccard similarity of 0.75 or more."""
    left = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(left, "a").join(right, "b").where(
        100 * both >= 75 * (F.col("na") + F.col("nb") - both)).select("a", "b")


def _labels(ids: DataFrame, links: DataFrame) -> DataFrame:
    """``id, label`` of each of the ids."""
    return ids.join(components(links), F.col("id") == F.col("node"), "left").select(
        "id", F.coalesce("label", "id").alias("label"))


def _links(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Which sets of the one list link with which of the other.

    Overlaps are products of 0/1 matrices over the shingles that both lists hold.
    """
    vocabulary = np.intersect1d(np.concatenate(left), np.concatenate(right))
    both = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(vocabulary), COLUMNS):
        part = vocabulary[at : at + COLUMNS]

        def matrix(sets: list[np.ndarray]) -> np.ndarray:
            found = np.zeros((len(sets), len(part)), np.float32)
            for i, own in enumerate(sets):
                place = np.minimum(np.searchsorted(part, own), len(part) - 1)
                found[i, place[part[place] == own]] = 1
            return found

        both += matrix(left) @ matrix(right).T
    overlap = both.astype(np.int64)
    union = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :] - overlap
    return 100 * overlap >= 75 * union


def _linked(minor: list, others: list) -> list[tuple[int, int]]:
    """Links between classes of different labels, one for each of ``minor`` and label of the others.

    Both hold (id, n, label, shingles).
    """
    found = _links([x[3] for x in minor], [x[3] for x in others])
    apart = np.array([x[2] for x in minor])[:, None] != np.array([x[2] for x in others])[None, :]
    links = {}
    for i, j in zip(*np.nonzero(found & apart), strict=True):
        links.setdefault((minor[i][0], others[j][2]), (minor[i][0], others[j][0]))
    return list(links.values())


def _compare(block: pd.DataFrame) -> pd.DataFrame:
    links = []
    for _, rows in block.groupby("family"):
        minor, others = ([(r.id, r.n, r.label, np.array(r.shingles)) for r in rows[rows["minor"] == side].itertuples()]
                         for side in (True, False))
        if minor and others:
            links += _linked(minor, others)
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def _rest(open_rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between components that a list of ``open_rows`` (id, label, token) still holds apart."""
    heads = open_rows.groupBy("token").agg(F.min("id").alias("b"))
    families = components(open_rows.join(heads, "token").select(F.col("id").alias("a"), "b").distinct())
    members = open_rows.select("id", "label").distinct().join(
        families.select(F.col("node").alias("id"), F.col("label").alias("family")), "id")
    members = stored(members, "members")
    sizes = members.groupBy("family", "label").agg(F.count(F.lit(1)).alias("m")).groupBy("family").agg(
        F.sum("m").alias("all"), F.max("m").alias("most"), F.max_by("label", F.struct("m", "label")).alias("top"))
    placed = members.join(sizes, "family").join(sets, "id").withColumns({
        "blocks": F.ceil(F.col("all") / BLOCK).cast("int"),
        "minors": F.greatest(F.lit(1), F.ceil((F.col("all") - F.col("most")) / BLOCK)).cast("int")})
    # Small families share a task; a large one is spread over its pairs of blocks.
    tasks = F.lit(max(1, members.count() // (2 * BLOCK)))
    placed = placed.withColumn("task", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("family"), tasks)).otherwise(F.col("family")))
    spin = F.xxhash64("id")
    every = F.sequence(F.lit(0), F.col("blocks") - 1), F.sequence(F.lit(0), F.col("minors") - 1)
    columns = ["task", "blocks", "family", "id", "n", "label", "shingles"]
    others = placed.select(*columns, F.lit(False).alias("minor"), F.pmod(spin, "blocks").cast("int").alias("x"), F.explode(every[1]).alias("y"))
    minor = placed.where("label <> top").select(
        *columns, F.lit(True).alias("minor"), F.explode(every[0]).alias("x"), F.pmod(spin, "minors").cast("int").alias("y"))
    return others.unionByName(minor).groupBy("task", "blocks", "x", "y").applyInPandas(_compare, "a long, b long")


def link_classes(sets: DataFrame) -> DataFrame:
    """``id, label`` of classes from their ``id, n, shingles``: the smallest id that links reach."""
    prefixes = stored(_prefixes(sets).withColumn("group", F.xxhash64("n", "alone", "tokens")), "prefixes")
    members = prefixes.select("group", "id")
    groups = prefixes.groupBy("group", "n", "alone", "tokens").agg(F.min("id").alias("id"))
    posted = stored(groups.select("group", "id", "n", "alone", F.posexplode("tokens").alias("at", "token")).select(
        "group", "id", "n", "alone", "token", (F.col("at") + F.col("alone")).alias("at")), "posted")

    pivots = posted.groupBy("token").agg(
        F.count(F.lit(1)).alias("m"), F.min(F.struct("alone", "id", "n", "at")).alias("p")).where("m > 1").select(
        "token", F.col("p.id").alias("b"), F.col("p.n").alias("pn"), F.col("p.at").alias("pat"))
    across = posted.join(pivots, "token").where((F.col("id") != F.col("b")) & _may_link("n", "at", "pn", "pat")).select(
        F.col("id").alias("a"), "b")
    heads = groups.select(F.col("group").alias("of"), F.col("id").alias("b"))
    within = members.join(heads, F.col("group") == F.col("of")).where("id <> b").select(F.col("id").alias("a"), "b")
    links = stored(_verified(across.unionByName(within).distinct(), sets), "links")

    ids = members.select("id")
    labels = stored(_labels(ids, links), "labels")
    expanded = stored(posted.select("group", "token").join(members, "group").join(labels, "id").select(
        "id", "token", "label"), "expanded")
    held_apart = expanded.groupBy("token").agg(
        F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("token")
    more = stored(_rest(expanded.join(held_apart, "token", "left_semi"), sets), "links")
    if more.isEmpty():
        return labels
    return _labels(ids, links.unionByName(more))


def _count_links(block: pd.DataFrame) -> pd.DataFrame:
    """For each class the number of documents in classes that it links with, in this pair of blocks."""
    found = []
    for _, rows in block.groupby("label"):
        left, right = rows[rows["side"] == 0], rows[rows["side"] == 1]
        alone = not len(right)  # a block with itself
        right = left if alone else right
        if not len(left) or (alone and len(left) < 2):
            continue
        links = _links(list(map(np.asarray, left["shingles"])), list(map(np.asarray, right["shingles"])))
        if alone:
            np.fill_diagonal(links, False)
        found.append(pd.DataFrame({"id": left["id"].to_numpy(), "linked": links @ right["m"].to_numpy()}))
        if not alone:
            found.append(pd.DataFrame({"id": right["id"].to_numpy(), "linked": links.T @ left["m"].to_numpy()}))
    return pd.concat(found) if found else pd.DataFrame({"id": [], "linked": []}, dtype="int64")


def link_counts(sets: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """``id, linked`` of classes that link with others: how many documents (``m`` of a class) those hold."""
    named = labels.join(classes.select("id", "m"), "id").join(sets.select("id", "n"), "id")
    sizes = named.groupBy("label").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("all")).where("k > 1")
    blocks = F.ceil(F.greatest(F.col("k") / BLOCK, F.col("all") / SHINGLES)).cast("int")
    members = stored(named.join(sizes, "label").withColumn("blocks", blocks), "linked")
    tasks = F.lit(max(1, (members.agg(F.sum("n")).first()[0] or 0) // SHINGLES))
    own = F.pmod(F.xxhash64("id"), "blocks").cast("int")
    # A block meets itself and those after it as the left side, those before it as the right one.
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(
        F.least("own", other).alias("x"), F.greatest("own", other).alias("y"), (other < F.col("own")).cast("int").alias("side")))
    placed = members.withColumn("own", own).join(sets.select("id", "shingles"), "id").select(
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("label"), tasks)).otherwise(F.col("label")).alias("task"),
        "blocks", "label", "id", "m", "shingles", F.inline(meets))
    found = placed.groupBy("task", "blocks", "x", "y").applyInPandas(_count_links, "id long, linked long")
    return found.groupBy("id").agg(F.sum("linked").alias("linked"))


def join(docs: DataFrame, text: str = "text", key: str = "doc_id", count: bool = True) -> DataFrame:
    """``key, n_shingles, component_id, n_links`` of every document; the key is a whole number.

    ``n_links`` counts the rows that the document links with, copies of it included; it is left out
    if ``count`` is false.
    """
    rows = docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text"))
    prints = stored(fingerprints(rows), "prints")
    can = prints.where((F.col("n") > 0) & F.col("key").isNotNull() & (4 * F.col("shared") >= 3 * F.col("n")))
    classes = stored(can.groupBy("same").agg(F.min("key").alias("id"), F.count(F.lit(1)).alias("m")), "classes")
    sets = stored(_sets(rows, classes.select("id"), classes.count()), "sets")
    labels = link_classes(sets)
    counts = link_counts(sets, classes, labels) if count else labels.select("id", F.lit(0).alias("linked"))
    counts = counts.withColumnRenamed("id", "_linked")
    named = classes.join(labels.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left").join(
        counts, F.col("id") == F.col("_linked"), "left").select(
        F.col("same").alias("of"), F.coalesce("label", "id").alias("label"),
        (F.coalesce("linked", F.lit(0)) + F.col("m") - 1).alias("links"),
        F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("part"))
    asked = prints.withColumns({
        "set": F.when((F.col("n") > 0) & F.col("key").isNotNull(), F.col("same")),
        "salt": F.pmod(F.xxhash64("key"), F.lit(SALT)).cast("int")})
    return asked.join(named, (F.col("set") == F.col("of")) & (F.col("salt") == F.col("part")), "left").select(
        "key", F.col("n").cast("long").alias("n_shingles"), F.coalesce("label", "key").alias("component_id"),
        *[F.coalesce("links", F.lit(0)).alias("n_links")] * count)


def one_each(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents with their columns, one of each component: that of its name."""
    joined, name = join(docs, text, key, count=False), unused(docs, "_key")
    gone = joined.where("key <> component_id").select(F.col("key").alias(name)).distinct()
    kept = docs.join(gone, docs[key] == F.col(name), "left_anti")
    linked = (F.col("n_shingles") > 0) & F.col("key").isNotNull()
    heads = joined.where(linked).groupBy(F.col("key").alias(name)).count().where("count > 1").select(name)
    if heads.isEmpty():
        return kept
    repeated = kept.join(heads, kept[key] == F.col(name), "left_semi").dropDuplicates([key])
    return kept.join(heads, kept[key] == F.col(name), "left_anti").unionByName(repeated)
