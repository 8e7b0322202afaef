"""Quality rules: counts over words, then language-specific bands of n-gram perplexity.

The language model is a modified Kneser-Ney model (Chen and Goodman 1999) of order ``ORDER`` over
characters folded to ``CLASSES`` classes, one model for each language. Characters, because word
n-grams of order three would take more disk than the input. Spark counts the n-grams of the top
order over all documents, summed in each task before the shuffle; the lower orders and the three
discounts of each order follow from that table by further aggregation. A model is stored as sorted
arrays of 64-bit hashes with log probabilities and back-off weights beside them.

Its size is bounded by the classes: an order n has at most ``CLASSES`` ** n entries of 16 bytes for
a language, about 270 MB for order four, while languages with an alphabet use one or two percent
of that. The models go to the tasks in turns
of languages, ``MODEL_ROWS`` n-grams or one language a turn.

The bands come from all documents that pass the base rules, each distinct text once, as copies would
draw the band together around themselves: the median of the mean log probability in each language, and
the median distance from it times the root of the length, as means scatter by one over that root. A
deviation is at least that of a mean of independent characters by the model's own variance, and never
zero. A band is ``WIDE`` such deviations to either side, wider for short texts.
Texts below the lower end repeat themselves, texts above the upper end are noise; both are rejected.

There is a band at every size: a language with n such texts has the share n / (n + ``FEW``) in its log
probabilities, centre and scatter, the rest comes from one model and one band of all languages
together. As languages differ, that part of the band is at least as wide as all texts are apart.

Defined cases: a null text is an empty one, with no words, and fails the base rules, also where a
language has no other; the null language is a language of its own; repeated rows count each time; an empty table gives an empty
result; other columns are carried along by ``accepted`` and ignored otherwise.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wanderlens.llm.text import unused
from wanderlens.sources.stored import stored

ORDER = 4
CLASSES = 64
FEWEST_WORDS = 10
MOST_REPEATED = 20
WIDE = 5.0
LEAST = 1e-3
SIGMA = 1.4826
FEW = 50
MODEL_ROWS = 4_000_000
CHUNK = 1_000_000

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
#: The class of a character: letters a to z, then blank, marks and digits, each of the symbols, and
#: other letters by their code.
_PLAIN = "abcdefghijklmnopqrstuvwxyz .,!?-'\"/:0" + SYMBOLS
_OTHERS = CLASSES - len(_PLAIN)


def _class_table() -> np.ndarray:
    """Class of each code point below 0x250; those above are dealt by code."""
    table = np.array([len(_PLAIN) + c % _OTHERS for c in range(0x250)], np.uint8)
    for code in range(0x250):
        letter = chr(code).lower()
        if letter in BLANKS:
            letter = " "
        elif letter.isdecimal():
            letter = "0"
        if letter in _PLAIN:
            table[code] = _PLAIN.index(letter)
        elif len(letter) == 1:
            table[code] = len(_PLAIN) + ord(letter) % _OTHERS
    return table


TABLE = _class_table()


def classes(text: str) -> np.ndarray:
    """Classes of the characters of a text behind ``ORDER - 1`` blanks, runs of blanks as one."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    found = np.where(codes < 0x250, TABLE[np.minimum(codes, 0x24F)], len(_PLAIN) + codes % _OTHERS).astype(np.uint32)
    blank = found == _PLAIN.index(" ")
    found = found[~(blank & np.concatenate([[False], blank[:-1]]))] if len(found) else found
    return np.concatenate([np.full(ORDER - 1, _PLAIN.index(" "), np.uint32), found])


def grams(symbols: np.ndarray, order: int) -> np.ndarray:
    """Codes of the n-grams that end at each character after the leading blanks."""
    count = len(symbols) - ORDER + 1
    code = np.zeros(count, np.uint32)
    for k in range(order):
        at = ORDER - order + k
        code = code * np.uint32(CLASSES) + symbols[at : at + count]
    return code


def hashed(codes: np.ndarray) -> np.ndarray:
    """A mixing of codes into 64 bits, one to one."""
    with np.errstate(over="ignore"):
        x = codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = text.encode("utf-8", "surrogatepass").split()
    word_chars = len(text) - sum(map(text.count, BLANKS))
    n_symbols = sum(map(text.count, SYMBOLS))
    lines, seen, n_dup_lines = text.split("\n"), set(), 0
    if len(lines) > 1:
        for line in lines:
            if line in seen:
                n_dup_lines += 1
            elif line.strip(BLANKS):
                seen.add(line)
    return len(words), word_chars, n_symbols, n_dup_lines, repeated_words(words)


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of ``width`` words that the text holds at least twice."""
    count = len(words) - width + 1
    if count < 2:
        return 0
    first: dict[bytes, int] = {}
    ids = np.array([first.setdefault(w, len(first)) for w in words], np.uint64)
    key = ids[:count].copy()
    for k in range(1, width):
        # Pairs (previous key, next word) are numbered anew at each step, so equal keys mean equal windows.
        key = np.unique(key * np.uint64(len(first)) + ids[k : k + count], return_inverse=True)[1].astype(np.uint64)
    twice = np.bincount(key.astype(np.int64))[key.astype(np.int64)] > 1
    if not twice.any():
        return 0
    edges = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + width, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def _chunks(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Parts of a batch of about ``CHUNK`` characters, one text at least."""
    sizes = batch["text"].str.len().fillna(0).cumsum().to_numpy()
    part = (sizes // CHUNK).astype(np.int64)
    for at in np.split(np.arange(len(batch)), np.flatnonzero(np.diff(part)) + 1):
        yield batch.iloc[at]


def count_grams(docs: DataFrame) -> DataFrame:
    """``lang, code, n`` of the n-grams of the top order, from ``lang, text``."""

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str | None, list] = {}

        def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
            codes, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return codes, np.bincount(where, np.concatenate([p[1] for p in parts])).astype(np.int64)

        for batch in batches:
            for part in _chunks(batch):
                for lang, texts in part.groupby("lang", dropna=False)["text"]:
                    codes = np.concatenate([grams(classes(t), ORDER) for t in texts.fillna("")])
                    lang = None if pd.isna(lang) else lang
                    held.setdefault(lang, []).append(np.unique(codes, return_counts=True))
                    if len(held[lang]) > 16:
                        held[lang] = [merged(held[lang])]
        for lang, parts in held.items():
            codes, n = merged(parts)
            yield pd.DataFrame({"lang": pd.Series([lang] * len(codes), dtype=object), "code": codes.astype(np.int64), "n": n})

    counted = docs.select("lang", "text").mapInPandas(count, "lang string, code long, n long")
    return counted.groupBy("lang", "code").agg(F.sum("n").alias("n"))


def _of_all_orders(counted: DataFrame) -> DataFrame:
    """``lang, ord, code, n`` of each language, ``marked``, and of all together, ``POOLED``, from counts of the top order.

    Below the top, ``n`` is the number of distinct characters before an n-gram, which are bits of a long, as there
    are no more than 64 classes. So one shuffle, combined on the map side, counts all orders.
    """
    marked = F.coalesce(F.concat(F.lit(MARK), "lang"), F.lit(UNNAMED))
    suffixes = F.array(*[F.named_struct(
        F.lit("ord"), F.lit(k), F.lit("code"), F.col("code") % CLASSES**k,
        F.lit("before"), (F.expr(f"code div {CLASSES**k}") % CLASSES).cast("int")) for k in range(1, ORDER + 1)])
    rows = counted.select(F.explode(F.array(marked, F.lit(POOLED))).alias("lang"), "n", suffixes.alias("suffixes")).select(
        "lang", "n", F.inline("suffixes"))
    found = rows.groupBy("lang", "ord", "code").agg(F.sum("n").alias("_n"), F.bit_or(F.expr("shiftleft(1L, before)")).alias("_before"))
    return found.select("lang", "ord", "code", F.when(F.col("ord") == ORDER, F.col("_n")).otherwise(F.bit_count("_before")).alias("n"))


def _shares(counts: DataFrame) -> DataFrame:
    """``lang, ord, code, context, share, weight``: the discounted share of an n-gram in its context, and what that leaves.

    What modified Kneser-Ney takes off a count follows from the counts of counts of the language and order, which
    are a row for each and go to every task; the driver has the languages anyway, to deal them into turns.
    A context has ``CLASSES`` n-grams at most, so the windows are small.
    """
    few = lambda k: F.sum(F.when(F.col("n") == k, 1).otherwise(0))
    of = counts.groupBy("lang", "ord").agg(*[few(k).alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1))
    cuts = [F.greatest(F.lit(0.0), F.least(F.lit(k - 0.05), F.when(F.col(f"n{k}") > 0, k - (k + 1) * y * F.col(
        f"n{k + 1}") / F.greatest(F.col(f"n{k}"), F.lit(1))).otherwise(0.5))) for k in (1, 2, 3)]
    of = of.select("lang", "ord", *[c.alias(f"d{k + 1}") for k, c in enumerate(cuts)])
    cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    # Not shuffled by language and order: the windows would then stay with those few keys.
    rows = counts.join(F.broadcast(of), ["lang", "ord"]).select(
        "lang", "ord", "code", F.expr(f"code div {CLASSES}").alias("context"), "n", cut.alias("cut"))
    beside = Window.partitionBy("lang", "ord", "context")
    rows = rows.withColumns({"_total": F.sum("n").over(beside), "_free": F.sum("cut").over(beside)})
    return rows.select("lang", "ord", "code", "context", ((F.col("n") - F.col("cut")) / F.col("_total")).alias("share"),
                       (F.col("_free") / F.col("_total")).alias("weight"))


def train(docs: DataFrame) -> DataFrame:
    """The model of each language and order, from ``lang, text``: a stored table of ``MODEL_SCHEMA``.

    The counts of a lower order are the numbers of distinct characters before its n-grams. The
    interpolated probability of an n-gram is its discounted share plus the back-off of its context
    times the probability of the n-gram without its first character. One more model, ``pooled``, is
    that of all languages together; inside, a language is named behind a mark to tell it from that.

    All orders share their steps but the last, as each statement takes memory of the driver.
    """
    shares = stored(_shares(stored(_of_all_orders(stored(count_grams(docs), "grams")), "counts")), "shares")
    # The weight of a context is kept with the context, as an entry of the order below.
    entries = shares.select("lang", (F.col("ord") - 1).alias("ord"), F.col("context").alias("code"),
                            F.lit(None).cast("double").alias("logp"), F.log("weight").alias("backoff"))
    lower = None
    for order in range(1, ORDER + 1):
        here, below = shares.where(F.col("ord") == order), F.lit(1.0 / CLASSES)
        if lower is not None:
            under = lower.select(F.col("lang").alias("_u"), F.col("code").alias("_k"), F.col("p").alias("_p"))
            here = here.join(under, (F.col("lang") == F.col("_u")) & (F.col("code") % CLASSES ** (order - 1) == F.col("_k")))
            below = F.col("_p")
        lower = here.select("lang", "code", (F.col("share") + F.col("weight") * below).alias("p"))
        if 1 < order < ORDER:
            lower = stored(lower, "probable")
        entries = entries.unionByName(lower.select(
            "lang", F.lit(order).alias("ord"), "code", F.log("p").alias("logp"), F.lit(None).cast("double").alias("backoff")))
    entries = entries.groupBy("lang", "ord", "code").agg(F.max("logp").alias("logp"), F.max("backoff").alias("backoff"))
    arrays = entries.groupBy("lang", "ord").applyInPandas(_sorted_arrays, MODEL_SCHEMA)
    named = F.when(F.col("lang").startswith(MARK), F.expr(f"substring(lang, {len(MARK) + 1})"))
    return stored(arrays.select(
        named.alias("lang"), (F.col("lang") == POOLED).alias("pooled"), "ord", "n", "hashes", "logp", "backoff"), "model")


#: Names inside a model: languages stand behind a mark, the null language has none.
MARK = "="
UNNAMED = "-"
POOLED = "*"
MODEL_SCHEMA = "lang string, ord int, n long, hashes binary, logp binary, backoff binary"


def _sorted_arrays(entries: pd.DataFrame) -> pd.DataFrame:
    """One order of one language as arrays in the order of the hashes."""
    keys = hashed(entries["code"].to_numpy(np.uint64))
    by = np.argsort(keys)
    values = [entries[c].fillna(fill).to_numpy("<f4")[by].tobytes() for c, fill in (("logp", np.nan), ("backoff", 0.0))]
    first = entries.iloc[0]
    return pd.DataFrame([(first["lang"], first["ord"], len(by), keys[by].tobytes(), *values)], columns=[c.split()[0] for c in MODEL_SCHEMA.split(", ")])


class Model:
    """One language's sorted hash arrays for each order, and the lookup of log probabilities."""

    def __init__(self, orders: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.orders = orders

    @classmethod
    def of(cls, rows: pd.DataFrame) -> Model:
        return cls({int(r.ord): (np.frombuffer(r.hashes, "<u8"), np.frombuffer(r.logp, "<f4"), np.frombuffer(r.backoff, "<f4"))
                    for r in rows.itertuples()})

    def _find(self, order: int, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = self.orders[order][0]
        wanted = hashed(codes)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    def log_probability(self, codes: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Of n-grams of an order, with back-off where they were not seen."""
        if order == 0 or order not in self.orders:
            return np.full(len(codes), -np.log(CLASSES))
        at, seen = self._find(order, codes)
        found = self.orders[order][1][at].astype(np.float64)
        seen &= ~np.isnan(found)  # some contexts were never seen as n-grams
        if not seen.all():
            missed = codes[~seen]
            lower = self.log_probability(missed % np.uint32(CLASSES ** (order - 1)), order - 1)
            if order - 1 in self.orders:
                place, known = self._find(order - 1, missed // np.uint32(CLASSES))
                lower += np.where(known, self.orders[order - 1][2][place], 0.0)
            found[~seen] = lower
        return found



def moments(text: str, own: Model, pooled: Model) -> tuple[float, float, float, int]:
    """Mean and variance of the log probabilities of the characters of a text, the mean by the pooled model, their number."""
    codes = grams(classes(text), ORDER)
    if not len(codes):
        return 0.0, 0.0, 0.0, 0
    found = own.log_probability(codes)
    return float(found.mean()), float(found.var()), float(pooled.log_probability(codes).mean()), len(found)


SCORED = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "mean double, variance double, pooled double, n long")


def _turns(model: DataFrame) -> list[list[str | None]]:
    """Languages in turns whose models together stay within ``MODEL_ROWS`` n-grams, or one language."""
    turns, room = [], 0
    for r in model.where("not pooled").groupBy("lang").agg(F.sum("n").alias("n")).collect():
        if not turns or r["n"] > room:
            turns.append([])
            room = MODEL_ROWS
        turns[-1].append(r["lang"])
        room -= r["n"]
    return turns


def score(docs: DataFrame, model: DataFrame) -> DataFrame:
    """The rows of ``docs``, which have ``lang`` and ``text``, without the text and with ``SCORED``."""
    others = [c for c in docs.columns if c != "text"]
    schema = ", ".join(f"{c} {t}" for c, t in docs.dtypes if c != "text") + ", " + SCORED
    spark = docs.sparkSession

    def among(languages: list[str | None]) -> Column:
        here = F.coalesce(F.col("lang").isin([x for x in languages if x is not None]), F.lit(False))
        return here | F.col("lang").isNull() if None in languages else here

    everyone = spark.sparkContext.broadcast(Model.of(model.where("pooled").toPandas()).orders)

    def scorer(turn: list[str | None], here: Column) -> DataFrame:
        rows = model.where(~F.col("pooled") & among(turn)).toPandas()
        sent = spark.sparkContext.broadcast({
            None if pd.isna(lang) else lang: Model.of(part).orders for lang, part in rows.groupby("lang", dropna=False)})

        def rate(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            models = {lang: Model(orders) for lang, orders in sent.value.items()}
            pooled = Model(everyone.value)
            for batch in batches:
                found = []
                for lang, text in zip(batch["lang"], batch["text"], strict=True):
                    text = text or ""
                    own = models.get(None if pd.isna(lang) else lang, Model({}))
                    found.append((*base_counts(text), *moments(text, own, pooled)))
                names = [c.split()[0] for c in SCORED.split(", ")]
                scores = pd.DataFrame(found, columns=names, index=batch.index)
                yield pd.concat([batch[others], scores], axis=1)

        return docs.where(here).mapInPandas(rate, schema)

    # The first turn also takes the languages that have no model, as all their texts are empty.
    turns = _turns(model) or [[]]
    whole = scorer(turns[0], ~among([lang for turn in turns[1:] for lang in turn]))
    for turn in turns[1:]:
        whole = whole.unionByName(scorer(turn, among(turn)))
    return whole


def verdicts(scored: DataFrame) -> DataFrame:
    """``scored`` with ``base_failed``, ``perplexity``, ``low``, ``high`` and ``kept``."""
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    scored = scored.withColumn("base_failed", failed)
    # A text counts once for the band, however many copies it has.
    passed = stored(scored.where("not base_failed").groupBy("lang", "print").agg(
        *[F.first(c).alias(c) for c in ("mean", "variance", "pooled", "n")]), "passed")
    middle = lambda c: F.percentile_approx(c, 0.5, 10000)
    centre = passed.groupBy(F.col("lang").alias("_lang")).agg(
        middle("mean").alias("_mid"), F.avg("variance").alias("_own"), F.count(F.lit(1)).alias("_n"))
    off = F.abs(F.col("mean") - F.col("_mid")) * F.sqrt("n")
    bands = passed.join(centre, F.col("lang").eqNullSafe(F.col("_lang"))).groupBy("_lang", "_mid", "_own", "_n").agg(
        (middle(off) * SIGMA).alias("_scatter"))
    # A few numbers that are the same for all languages; null if nothing passed.
    all_mid, all_own = passed.agg(middle("pooled"), F.avg("variance")).first()
    apart = F.abs(F.col("pooled") - F.lit(all_mid).cast("double"))
    all_scatter, all_spread = passed.agg(middle(apart * F.sqrt("n")) * SIGMA, middle(apart) * SIGMA).first()

    share = F.coalesce(F.col("_n") / (F.col("_n") + FEW), F.lit(0.0))
    mixed = lambda own, of_all: F.coalesce(share * F.col(own), F.lit(0.0)) + (1 - share) * of_all
    constant = lambda value: F.lit(value).cast("double")
    long = F.sqrt(F.greatest(F.col("n"), F.lit(1)))
    scatter = F.greatest(mixed("_scatter", constant(all_scatter)), F.sqrt(mixed("_own", constant(all_own))), F.lit(LEAST))
    joined = scored.join(bands, F.col("lang").eqNullSafe(F.col("_lang")), "left").withColumns({
        "_mean": mixed("mean", F.col("pooled")), "_centre": mixed("_mid", constant(all_mid)),
        "_slack": WIDE * F.greatest(scatter / long, (1 - share) * constant(all_spread))})
    # A high probability is a low perplexity.
    joined = joined.withColumns({
        "perplexity": F.exp(-F.col("_mean")), "low": F.exp(-F.col("_centre") - F.col("_slack")), "high": F.exp(-F.col("_centre") + F.col("_slack"))})
    within = F.coalesce(F.col("perplexity").between(F.col("low"), F.col("high")), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & within).drop(
        *bands.columns, "_mean", "_centre", "_slack", "mean", "variance", "pooled", "n")


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """``key, print, lang`` and the columns of ``verdicts`` for each document; ``print`` is a hash of its text."""
    rows = docs.select(docs[key].alias("key"), F.xxhash64(docs[text]).alias("print"), docs[lang].alias("lang"), docs[text].alias("text"))
    model = train(rows.select("lang", "text"))
    return verdicts(stored(score(rows, model), "scored"))


def accepted(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """The documents that are kept, with their columns."""
    name, print_, of = (unused(docs, c) for c in ("_key", "_print", "_lang"))
    rejected = judge(docs, text, lang, key).where("not kept").select(
        F.col("key").alias(name), F.col("print").alias(print_), F.col("lang").alias(of)).distinct()
    same = docs[key].eqNullSafe(F.col(name)) & (F.xxhash64(docs[text]) == F.col(print_)) & docs[lang].eqNullSafe(F.col(of))
    return docs.join(rejected, same, "left_anti")
