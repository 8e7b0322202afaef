"""Mine phrase collocations with stripes.

A stripe belongs to a prefix of words and counts, for each word that follows it, how often it does;
one more counter holds all that follows but is not told apart (a rare word, the end of a piece).
So a stripe's entries are the prefix's extensions, its sum is the number of the prefix's
occurrences, its largest entry tells whether an extension subsumes the prefix, and an entry of the
stripe of ``w q`` tells the same of ``q`` and the word that follows. All results are read from the
merged stripes.

Tasks build stripes over whole texts in four passes: the empty prefix (words), prefixes of one word
(pairs), of two (triples), and of three and more. A word, pair or triple that occurs less than
``min_count`` times starts or extends no stripe of a later pass, as no phrase with it can be frequent.
Tasks know the frequent ones by a Bloom filter of at most ``MOST_BITS`` bits, sent to each executor.
Its false positives are counted like the others and fall out by their exact counts; when it is full it
only prunes less. The stripes of a task are packed as text, bundled in buckets by prefix (a few for
each shuffle partition), shuffled by bucket and merged elementwise. A prefix whose first words are more
than one in ``HOT`` of the table has its stripe split into ``SPREAD`` parts by the next word, each in a
bucket of its own, and so has the empty one.

Defined cases: a null text is an empty one, a null language is ``und``; repeated rows count each; an
empty table or one without frequent phrases gives an empty result; ties are ordered by the phrase's
bytes; other columns are ignored. Words are kept as bytes of UTF-8, so no character is changed but
A-Z. A very long text is cut into words by and by; ``FLUSH`` words at a time are counted together,
with a text kept whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wanderlens.sources.stored import stored

MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2000
SCALE = 1000
SHARE = 100
#: A prefix is hot from one of so many words of the table on: no more than HOT prefixes of one length are.
HOT = 1000
SPREAD = 256
MOST_BITS = 1 << 28
PER_TASK = 4
FLUSH = 2_000_000
VOCABULARY = 200_000
SLICE = 1 << 22

#: The stripes of a bucket: their prefixes, and of all their entries the stripe's number, next word and
#: count, each joined by blanks. An empty word stands for all that is not told apart.
BUNDLE = "lang string, words int, bucket int, prefix array<string>, stripe string, next string, n string"
#: Upper case, separators of pieces (to the full stop), tab (to blank).
_TABLE = bytes.maketrans(
    bytes(range(65, 91)) + b",;:!?\n\x0b\x0c\r\t", bytes(range(97, 123)) + b"." * 9 + b" ")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _ODD
    return h ^ (h >> np.uint64(29))


def word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, xxhash.xxh32_intdigest(lang.encode()))


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return _mixed(first * np.uint64(3) + _mixed(second))


class Filter:
    """A Bloom filter over 64-bit hashes, three bits each, in an array of 64-bit words."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def size(n: int) -> int:
        """Bits for ``n`` entries: a power of two, sixteen an entry or more, but not above ``MOST_BITS``."""
        return min(MOST_BITS, max(1 << 10, 1 << (16 * n - 1).bit_length()))

    @staticmethod
    def places(h: np.ndarray, size: int) -> list[np.ndarray]:
        mask = np.uint64(size - 1)
        return [h & mask, (h >> np.uint64(32)) & mask, (_mixed(h) >> np.uint64(20)) & mask]

    def holds(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), bool)
        for at in self.places(h, 64 * len(self.bits)):
            found &= (self.bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0
        return found


class Words(dict):
    """Numbers of the words of one language as they come up, from 1; the end of a piece is 0."""

    def __init__(self, lang: str):
        super().__init__({b".": 0})
        self.lang, self.names, self.hashes = lang, [b""], [0]

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self.names)
        self.names.append(word)
        self.hashes.append(word_hash(self.lang, word))
        return found

    def numbers(self, texts: list[bytes]) -> list[np.ndarray]:
        """The numbers of the texts' words, with a 0 after each piece."""
        body = b".".join([*texts, b""]).translate(_TABLE)
        found, at = [], 0
        while at < len(body):
            end = len(body) if len(body) - at <= SLICE else body.rfind(b" ", at, at + SLICE)
            if end <= at:
                end = body.find(b" ", at + SLICE)
                end = len(body) if end < 0 else end
            tokens = body[at:end].replace(b".", b" . ").split()
            found.append(np.fromiter(map(self.__getitem__, tokens), np.int32, len(tokens)))
            at = end
        return found


def _bundles(
    words: Words, terms: np.ndarray, code: np.ndarray, n: np.ndarray, apart: np.ndarray, buckets: int,
) -> pa.RecordBatch:
    """Stripes from ``code`` (row of ``terms`` times the vocabulary, plus next word) and counts, a row for each bucket."""
    width, size = len(words.names), terms.shape[1]
    hashes = np.array(words.hashes, np.uint64)
    prefix, after = code // width, (code % width).astype(np.int64)
    own = np.zeros(len(terms), np.uint64)
    for i in range(size):
        own = pair_hash(own, hashes[terms[:, i]])
    part = np.where(apart[prefix], _mixed(hashes[after]) % np.uint64(SPREAD), np.uint64(0))
    bucket = (pair_hash(own[prefix], part) >> np.uint64(7)) % np.uint64(buckets)
    order = np.lexsort((part, prefix, bucket))
    prefix, after, part, bucket, n = (x[order] for x in (prefix, after, part, bucket, n))
    change = (np.diff(prefix) != 0) | (np.diff(part) != 0) | (np.diff(bucket) != 0)
    starts = np.flatnonzero(np.append(True, change)) if len(code) else np.array([], np.int64)
    names = pa.array(words.names, pa.binary()).cast(pa.string())
    columns = [names.take(pa.array(terms[prefix[starts], i])) for i in range(size)]
    texts = pc.binary_join_element_wise(*columns, " ") if size > 1 else columns[0] if size else pa.array([""] * len(starts), pa.string())
    own_bucket = bucket[starts]
    firsts = np.flatnonzero(np.append(True, np.diff(own_bucket) != 0)) if len(starts) else np.array([], np.int64)
    # The number of each entry's stripe in its bundle, and where the bundles' entries end.
    number = np.arange(len(starts)) - np.repeat(firsts, np.diff(np.append(firsts, len(starts))))
    number = np.repeat(number, np.diff(np.append(starts, len(code))))
    ends = pa.array(np.append(starts[firsts], len(code)).astype(np.int32))
    values = pa.array(number).cast(pa.string()), names.take(pa.array(after)), pa.array(n).cast(pa.string())
    return pa.RecordBatch.from_arrays([
        pa.array([words.lang] * len(firsts), pa.string()), pa.array(np.full(len(firsts), size, np.int32)),
        pa.array(own_bucket[firsts].astype(np.int32)),
        pa.ListArray.from_arrays(pa.array(np.append(firsts, len(starts)).astype(np.int32)), texts),
        *(pc.binary_join(pa.ListArray.from_arrays(ends, x), " ") for x in values)],
        ["lang", "words", "bucket", "prefix", "stripe", "next", "n"])


def _counted(
    words: Words, a: np.ndarray, known: Filter | None, hot: np.ndarray, sizes: range, buckets: int,
) -> Iterator[pa.RecordBatch]:
    """The stripes of the prefixes of ``sizes`` words in ``a``."""
    width = np.int64(len(words.names))
    if sizes[0] == 0:
        code, n = np.unique(a[a > 0].astype(np.int64), return_counts=True)
        yield _bundles(words, np.empty((1, 0), np.int64), code, n, np.array([True]), buckets)
        return
    hashes, start = np.array(words.hashes, np.uint64), sizes[0]
    # Whether the ``start`` words from each place on are one of the known, within a piece.
    last = np.append(a, np.zeros(start, np.int32))
    at = np.flatnonzero(np.logical_and.reduce([last[i : i + len(a)] > 0 for i in range(start)]))
    if start == 1:
        passed = known.holds(hashes)[a[at]]
    else:
        gram = hashes[a[at]]
        for i in range(1, start):
            gram = pair_hash(gram, hashes[last[at + i]])
        passed = known.holds(gram)
    at = at[passed]
    link = np.zeros(len(a) + 1, bool)
    link[at] = True
    # Each place has the row of its prefix in ``terms``.
    rank, terms = a[at].astype(np.int64), np.arange(width)[:, None]
    for i in range(1, start):
        code, rank = np.unique(rank * width + last[at + i], return_inverse=True)
        terms = np.column_stack([terms[code // width], code % width])
    gram = hashes[terms[:, 0]]
    for i in range(1, start):
        gram = pair_hash(gram, hashes[terms[:, i]])
    apart = np.isin(gram, hot)
    for size in sizes:
        # What follows is told apart if the last words up to it are known too.
        after = np.where(link[at + size - start + 1], last[at + size], 0)
        found = rank * width + after
        code, n = np.unique(found, return_counts=True)
        yield _bundles(words, terms, code, n, apart, buckets)
        if size < sizes[-1]:
            code = code[code % width > 0]
            at, rank = at[after > 0], np.searchsorted(code, found[after > 0])
            terms, apart = np.column_stack([terms[code // width], code % width]), apart[code // width]


def stripes(docs: DataFrame, known: np.ndarray | None, hot: np.ndarray, sizes: range, text: str, lang: str) -> DataFrame:
    """The stripes that each task has counted, prefixes of ``sizes`` words."""
    spark = docs.sparkSession
    sent = None if known is None else spark.sparkContext.broadcast(known)
    buckets = PER_TASK * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Words] = {}
        held: dict[str, list[np.ndarray]] = {}
        keep = None if sent is None else Filter(sent.value)

        def flush() -> Iterator[pa.RecordBatch]:
            for name in list(held):
                yield from _counted(words[name], np.concatenate(held.pop(name)), keep, hot, sizes, buckets)
                if len(words[name]) > VOCABULARY:
                    del words[name]

        waiting = 0
        for batch in (batch.slice(at, 500) for batch in batches for at in range(0, len(batch), 500)):
            texts: dict[str, list[bytes]] = {}
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                texts.setdefault(name, []).append(body)
            for name, bodies in texts.items():
                found = words.setdefault(name, Words(name)).numbers(bodies)
                held.setdefault(name, []).extend(found)
                waiting += sum(map(len, found))
            if waiting >= FLUSH or sum(map(len, words.values())) > 2 * VOCABULARY:
                yield from flush()
                waiting = 0
        yield from flush()

    rows = docs.where(docs[text].isNotNull()).select(
        F.coalesce(docs[lang], F.lit("und")).alias("lang"), docs[text].cast("binary").alias("text"))
    return rows.mapInArrow(count, BUNDLE)


def merged(parts: DataFrame, min_count: int) -> DataFrame:
    """Stripes merged elementwise: ``lang, words, prefix, next, n``; rare words are one entry without a ``next``.

    The stripes are shuffled once; their entries are summed where their bucket is.
    """
    bucket = ["lang", "words", "bucket"]
    numbers = lambda c: F.split(c, " ").cast("array<long>")
    unpacked = F.arrays_zip(numbers("stripe").alias("stripe"), F.split("next", " ").alias("next"), numbers("n").alias("n"))
    entries = parts.repartition(*bucket).select(*bucket, F.col("prefix").alias("all"), F.inline(unpacked)).select(
        *bucket, F.element_at("all", F.col("stripe").cast("int") + 1).alias("prefix"), "next", "n")
    sums = entries.groupBy(*bucket, "prefix", "next").agg(F.sum("n").alias("n")).withColumn("next", F.expr("nullif(next, '')"))
    rare = F.when(F.col("n") >= min_count, F.col("next"))
    return sums.withColumn("next", rare).groupBy(*bucket, "prefix", "next").agg(F.sum("n").alias("n")).drop("bucket")


def _hashed(frequent: DataFrame) -> DataFrame:
    """``h, n`` of each frequent word, pair or triple, hashed as the tasks do."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, prefix, after, n = (c.to_pylist() for c in batch.columns)
            grams = [f"{p} {w}".split(" ") if p else [w] for p, w in zip(prefix, after, strict=True)]
            h = np.zeros(len(grams), np.uint64)
            for i in range(max(map(len, grams), default=0)):
                own = np.array([word_hash(g, ws[i].encode()) for g, ws in zip(lang, grams, strict=True)], np.uint64)
                h = pair_hash(h, own) if i else own
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], ["h", "n"])

    return frequent.select("lang", "prefix", "next", "n").mapInArrow(run, "h long, n long")


def known_and_hot(frequent: DataFrame, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The filter of the frequent words, pairs or triples, and the hashes of the hot ones (at most ``HOT``)."""
    hashed = stored(_hashed(frequent), "hashes")
    size = Filter.size(max(1, hashed.count()))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            at = np.concatenate(Filter.places(h, size))
            bit = np.left_shift(np.uint64(1), at & np.uint64(63))
            yield pa.RecordBatch.from_arrays(
                [pa.array((at >> np.uint64(6)).view(np.int64)), pa.array(bit.view(np.int64))], ["at", "bit"])

    filled = hashed.select("h").mapInArrow(place, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bit")).toPandas()
    bits = np.zeros(size // 64, np.uint64)
    bits[filled["at"].to_numpy(np.int64)] = filled["bit"].to_numpy(np.int64).view(np.uint64)
    hot = hashed.where(F.col("n") * HOT > n_words).toPandas()["h"].to_numpy(np.int64)
    return bits, hot.view(np.uint64)


def all_stripes(
    docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, text: str = "text", lang: str = "lang",
) -> DataFrame:
    """The merged stripes of all frequent prefixes, the empty one first."""
    none = np.array([], np.uint64)
    words = stored(merged(stripes(docs, None, none, range(0, 1), text, lang), min_count), "stripes")
    n_words = words.agg(F.sum("n")).first()[0] or 0
    found = words
    for sizes in (range(1, min(2, max_words)), range(2, min(3, max_words)), range(3, max_words)):
        if sizes:
            known, hot = known_and_hot(words.where("next is not null"), n_words)
            words = stored(merged(stripes(docs, known, hot, sizes, text, lang), min_count), "stripes")
            found = found.unionByName(words)
    return found


def collocations(
    docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP, scale: int = SCALE,
    share: int = SHARE, text: str = "text", lang: str = "lang",
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's ``top`` phrases.

    A phrase of two to ``max_words`` words occurs ``a`` times. Its score is that of its worst cut into
    two phrases of ``l`` and ``r`` occurrences: the floor of ``scale * a * n / (l * r)``. A phrase goes
    that a longer frequent one holds and has ``share`` percent of its occurrences.
    """
    return ranked(all_stripes(docs, min_count, max_words, text, lang), top, scale, share)


def ranked(found: DataFrame, top: int = TOP, scale: int = SCALE, share: int = SHARE) -> DataFrame:
    """The best phrases of merged stripes.

    The longer phrases that matter have one word more: whatever holds them is not more frequent.
    """
    total = found.where("words = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    sums = found.where("words > 0").groupBy("lang", F.col("prefix").alias("phrase")).agg(F.sum("n").alias("f"))
    entries = found.where("words > 0 and next is not null").select(
        "lang", "prefix", F.concat_ws(" ", "prefix", "next").alias("phrase"), F.col("n").alias("a"))
    parts = F.split("phrase", " ")
    longer = entries.select("lang", F.col("prefix").alias("phrase"), F.col("a").alias("most")).unionByName(
        entries.select("lang", F.array_join(F.slice(parts, 2, F.size(parts)), " ").alias("phrase"), F.col("a").alias("most")))
    longer = longer.where("instr(phrase, ' ') > 0").groupBy("lang", "phrase").agg(F.max("most").alias("most"))
    kept = entries.join(longer, ["lang", "phrase"], "left").where(
        F.expr(f"most is null or 100 * most < {share} * a")).select("lang", "phrase", "a")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.size(parts) - 1))).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice(parts, F.lit(1), F.col("k")), " ").alias("head"),
        F.array_join(F.slice(parts, F.col("k") + 1, F.size(parts)), " ").alias("tail"))
    heads = sums.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = sums.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    scored = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(total, "lang")
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    score = F.expr(f"({scale} * ({wide('a')} * {wide('n')})) div ({wide('l')} * {wide('r')})")
    worst = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    best = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    return worst.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


ORACLE = r"""
with pieces as (
  select coalesce(lang, 'und') lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) p from documents where text is not null),
worded as (select lang, regexp_extract_all(p, '[^\x20\x09]+') w from pieces),
grams as (
  select lang, k, array_to_string(w[i:i + k - 1], ' ') phrase
  from worded, range(1, 6) s(k), lateral (select unnest(range(1, len(w) - k + 2)) i)),
counted as (select lang, k, phrase, count(*) f from grams group by all),
total as (select lang, sum(f)::bigint n from counted where k = 1 group by lang),
candidates as (select lang, k, phrase, f a, string_split(phrase, ' ') w from counted where k > 1 and f >= 100),
kept as (
  select * from candidates c where not exists (
    select 1 from candidates d where d.lang = c.lang and d.k > c.k and 100 * d.a >= 100 * c.a
      and contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' '))),
cuts as (
  select c.lang, c.phrase, c.a, t.n, j, x.f l, y.f r,
    ((1000::hugeint * c.a * t.n) // (x.f::hugeint * y.f))::bigint score
  from kept c join total t using (lang), range(1, 5) s(j), counted x, counted y
  where j < c.k and x.lang = c.lang and x.phrase = array_to_string(c.w[1:j], ' ')
    and y.lang = c.lang and y.phrase = array_to_string(c.w[j + 1:], ' ')),
worst as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, j) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank,
  phrase, a, l, r, n, score
from worst qualify row_number() over (partition by lang order by score desc, a desc, phrase) <= 2000
"""
