"""Mixing, line dedup, secrets and quality rules against plain versions, on odd and on ordinary rows."""

import random
import time
import re
from collections import Counter

import numpy as np
import pytest
from llm_rows import DOCS, corpus, docs, no_docs, prose, words  # noqa: F401
from pyspark.sql import functions as F

from wanderlens.llm import line_dedup, mixture, perplexity, secret_scan
from wanderlens.sources.stored import n_stored


# --- mixing ---


def plain_targets(sizes, share=1.5, repeat=2, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), {}
    while True:
        left = [s for s in names if s not in full]
        rest = total - sum(full.values())
        level = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if level[s] > repeat * sizes[s]]
        if not over:
            return {**full, **level}
        full |= {s: float(repeat * sizes[s]) for s in over}


def test_mix_takes_the_targets(docs):
    rows = mixture.mix(docs, block=8).select(
        "row.doc_id", "size", "source_size", "target", "taken", "full", "parts").collect()
    assert len(rows) == len(corpus())
    size, source = Counter(), {}
    for r in corpus():
        size[r[3]] += len(words(r[1]))
        source[r[0]] = r[3]
    expected = plain_targets(size)
    taken = Counter()
    for r in rows:
        assert r.source_size == size[source[r.doc_id]]
        assert r.target == pytest.approx(expected[source[r.doc_id]])
        assert 0 <= r.taken <= 2 * r.size
        assert r.taken == r.full * r.size + sum(p.words for p in r.parts)
        taken[source[r.doc_id]] += r.taken
    for s, target in expected.items():
        assert abs(taken[s] - target) <= 16


def test_mix_agrees_with_itself_and_takes_the_words_it_says(docs):
    first = sorted(map(str, mixture.mix(docs.coalesce(1)).collect()))
    assert first == sorted(map(str, mixture.mix(docs.repartition(7)).select("row", "size", "source_size", "target", "taken", "full", "parts").collect()))
    said = mixture.mix(docs).agg(F.sum("taken")).first()[0]
    taken = mixture.take(docs)
    assert taken.columns == docs.columns
    assert sum(len(words(r.text)) for r in taken.collect()) == said


def test_sainte_lague_equals_the_highest_quotients(spark):
    rng = random.Random(4)
    rows = [(g, p, float(rng.randint(1, 1000)), rng.choice([1, 7, 40, 333])) for g in range(12) for p in range(rng.randint(1, 9))]
    seats = {g: s for g, _, _, s in rows}
    rows = [(g, p, v, seats[g]) for g, p, v, _ in rows]
    frame = spark.createDataFrame(rows, "g int, p int, votes double, seats long")
    for r in mixture.sainte_lague(frame, ["g"], "votes", "seats", ["p"]).collect():
        quotients = sorted(((-v / (2 * s + 1), p) for g, p, v, _ in rows if g == r.g for s in range(r.seats)))[: r.seats]
        assert r.quota == sum(p == r.p for _, p in quotients)


def test_mix_of_nothing(no_docs, spark):
    assert mixture.mix(no_docs).count() == 0
    blank = spark.createDataFrame([(1, None, "en", None, 0, *"abcdef"), (2, " ", "en", "s", 1, *"abcdef")], DOCS)
    assert [r.taken for r in mixture.mix(blank).collect()] == [0, 0]
    assert mixture.take(blank).count() == 0


# --- lines ---


def plain_line_dedup(rows):
    first, texts = {}, {}
    for key, text in sorted(((r[0], r[1]) for r in rows if r[1] is not None), key=lambda x: (x[0] is not None, x[0])):
        texts[key] = lines = text.split("\n")
        for i in range(len(lines) - 2):
            first.setdefault(tuple(lines[i : i + 3]), (key, i))
    kept = {}
    for key, lines in texts.items():
        gone = set()
        for i in range(len(lines) - 2):
            if first[tuple(lines[i : i + 3])] != (key, i):
                gone |= {i, i + 1, i + 2}
        kept[key] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return kept


def test_line_dedup_equals_the_plain_version(docs, spark):
    rows = corpus()
    passage = "\n".join(f"a shared line {i}" for i in range(6))
    rows += [(100 + i, f"own {i}\n{passage}\nend {i}", "en", "a", 0, *"xk9rln") for i in range(40)]
    rows += [(200, "r\nr\nr\nr\nr\nr", "en", "a", 0, *"xk9rln"), (201, "p\nq\np\nq\np\nq\np", "en", "a", 0, *"xk9rln")]
    frame = spark.createDataFrame(rows, DOCS).repartition(5)
    expected = plain_line_dedup(rows)
    found = line_dedup.line_dedup(frame).select("row.doc_id", "n_lines", "n_removed", "text").collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.text == expected.get(r.doc_id)
    assert {r.doc_id: r.n_removed for r in found}[139] == 6
    kept = line_dedup.without_repeats(frame)
    assert kept.dtypes == frame.dtypes and kept.count() == len(rows)
    assert all(r.n_chars == len(r.text) for r in kept.where("doc_id = 139").collect())


def test_line_dedup_keeps_every_line_once(spark):
    rng = random.Random(1)
    rows = [(i, "\n".join(rng.choice("abcd") for _ in range(rng.randint(1, 30))), "en", "a", 0, *"xk9rln") for i in range(60)]
    found = line_dedup.line_dedup(spark.createDataFrame(rows, DOCS)).select("text").collect()
    assert {x for r in found for x in r.text.split("\n")} >= {x for r in rows for x in r[1].split("\n")}


def test_line_dedup_of_nothing(no_docs):
    assert line_dedup.line_dedup(no_docs).count() == 0


# --- secrets ---

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))


def secret_rows():
    rng = random.Random(9)
    odd = ["token:api_key=\"abcdefgh12\"", "password = short", "PassWord=' x'", "apikey: 'abcdefgh'", "é\U0001f600 secret=12345678",
           "AKIA" + "A1" * 6, "AKIAAKIA" + "B" * 8, "AKIA123", "f" * 32, "f" * 31, "token=token=abcdefgh", "x" * 50, "deadbeef" * 4 + " " + "0" * 40]
    rows = [(i, t, None, None, 0, *"xk9rln") for i, t in enumerate(odd)]
    for i in range(60):
        name = "_".join(rng.choice(["user", "count", "table", "index", "value", "handler2"]) for _ in range(3))
        mixed = "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghjkmnpqrstuvwxyz0123456789") for _ in range(36))
        rows.append((100 + i, f"the {name} then token: {mixed} and later", None, None, 0, *"xk9rln"))
    rows.append((900, "see " + "".join(rng.choice("QWRTPSDFGHJKLZXCVBNMqwrtpsdfghj0123456789") for _ in range(40)) + " and user_count_table_index2_value", None, None, 0, *"xk9rln"))
    return rows


def test_secret_base_spans_equal_the_plain_version(docs, spark):
    rows = secret_rows() + corpus()
    frame = spark.createDataFrame(rows, DOCS).repartition(4)
    found = secret_scan.scan(frame, None).select("row.doc_id", "row.text", secret_scan.listed(F.col("spans")).alias("s")).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.s == plain_spans(r.text)


def test_markov_models_tell_random_strings_from_names(spark):
    frame = spark.createDataFrame(secret_rows(), DOCS)
    ratios = secret_scan.train(frame)
    found = {r.doc_id: r for r in secret_scan.scan(frame, ratios).select("row.doc_id", "row.text", "spans").collect()}
    added = [found[900].text[s.start : s.end] for s in found[900].spans if s.kind == 3]
    assert len(added) == 1 and len(added[0]) == 40
    for r in found.values():
        base = [(s.start, s.kind, s.end) for s in r.spans if s.kind < 3]
        assert ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in base) == plain_spans(r.text)
        assert [s.start for s in r.spans] == sorted(s.start for s in r.spans)
    assert ratios == secret_scan.train(frame.repartition(9))


def test_likelihood_ratio_equals_the_plain_sum(spark):
    ratios = [float(i % 7) - 3 for i in range(len(secret_scan.ALPHABET) ** 2)]
    text = "Ab9+zz_-="
    got = spark.range(1).select(secret_scan.likelihood_ratio(F.lit(text), ratios)).first()[0]
    code = secret_scan.ALPHABET.index
    want = sum(ratios[code(a) * len(secret_scan.ALPHABET) + code(b)] for a, b in zip(text, text[1:], strict=False)) / (len(text) - 1)
    assert got == pytest.approx(want)


def test_secrets_of_nothing(no_docs):
    assert secret_scan.train(no_docs) is None
    assert secret_scan.scan(no_docs, None).count() == 0


# --- quality ---


def plain_base(text):
    text = text or ""
    found = words(text)
    windows = [tuple(found[i : i + 5]) for i in range(len(found) - 4)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered |= set(range(i, i + 5))
    lines, seen, same = text.split("\n"), set(), 0
    for line in lines:
        if words(line):
            same += line in seen
            seen.add(line)
    return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), same, len(covered)


def test_base_counts_equal_the_plain_version():
    odd = ["a b c d e a b c d e", "x " * 40, "p\n\np\n \np", "a|b <c> #\n#\n#", "a b c d e f a b c d e f a"]
    for text in [r[1] for r in corpus()] + odd:
        assert perplexity.base_counts(text or "") == plain_base(text)


def plain_probability(texts):
    """Modified Kneser-Ney by its definition: from counts of n-grams to interpolated probabilities."""
    top = Counter()
    for t in texts:
        s = perplexity.classes(t).tolist()
        for i in range(perplexity.ORDER - 1, len(s)):
            top[tuple(s[i - perplexity.ORDER + 1 : i + 1])] += 1
    counts = {perplexity.ORDER: top}
    for n in range(perplexity.ORDER - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])

    def discounts(table):
        n = [0] + [sum(c == k for c in table.values()) for k in (1, 2, 3, 4)]
        y = n[1] / max(1, n[1] + 2 * n[2])
        return [0] + [min(k - 0.05, max(0.0, k - (k + 1) * y * n[k + 1] / n[k])) if n[k] else 0.5 for k in (1, 2, 3)]

    cut = {n: discounts(t) for n, t in counts.items()}

    def p(gram):
        n = len(gram)
        if n == 0:
            return 1 / perplexity.CLASSES
        after = {g: c for g, c in counts[n].items() if g[:-1] == gram[:-1]}
        if not after:
            return p(gram[1:])
        total = sum(after.values())
        own = after.get(gram, 0)
        free = sum(cut[n][min(c, 3)] for c in after.values())
        return (own - cut[n][min(own, 3)] if own else 0.0) / total + free / total * p(gram[1:])

    return p


def test_model_equals_modified_kneser_ney(spark):
    texts = ["the cat sat on the mat.", "the dog sat on the log, the end", "cats & dogs 12", ""]
    frame = spark.createDataFrame([("en", t) for t in texts] + [("de", "etwas anderes")], "lang string, text string")
    rows = perplexity.train(frame).toPandas()
    model = perplexity.Model.of(rows[rows.lang == "en"])
    p = plain_probability(texts)
    for text in ["the cat", "dogs sat!", "qqq zz", "中文", "the mat the"]:
        s = perplexity.classes(text)
        want = [np.log(p(tuple(s[i - 3 : i + 1].tolist()))) for i in range(3, len(s))]
        got = model.log_probability(perplexity.grams(s, perplexity.ORDER))
        assert got == pytest.approx(want, abs=1e-4)
    assert all(np.all(np.diff(keys.astype(object)) > 0) for keys, _, _ in model.orders.values())


def test_model_takes_few_statements(spark):
    """Each statement takes memory of the driver; a step for each order and part of its formula were 18 tables."""
    texts = [("en", "the cat sat on the mat."), (None, "the cat sat"), ("*", "a dog"), ("-", "zz")]
    before = n_stored()
    found = perplexity.train(spark.createDataFrame(texts, "lang string, text string")).toPandas()
    assert n_stored() - before <= 6
    # The null language, languages named like the marks inside, and all together are different models.
    own = {(None if row.lang != row.lang else row.lang, row.pooled) for row in found.itertuples()}
    assert own == {("en", False), (None, False), ("*", False), ("-", False), (None, True)}
    p = plain_probability([t for _, t in texts])
    model = perplexity.Model.of(found[found.pooled])
    s = perplexity.classes("the mat")
    want = [np.log(p(tuple(s[i - 3 : i + 1].tolist()))) for i in range(3, len(s))]
    assert model.log_probability(perplexity.grams(s, perplexity.ORDER)) == pytest.approx(want, abs=1e-4)


def test_quality_keeps_prose_and_rejects_noise(spark):
    rows = [(i, prose(i, 150), "en", "a", 0, *"xk9rln") for i in range(120)]
    rng = random.Random(3)
    noise = "".join(rng.choice("#@!~^{}[]qxzjk中文ÿ0123456789 ") for _ in range(4000))
    rows += [(900, noise, "en", "a", 0, *"xk9rln"), (901, "word " * 200, "en", "a", 0, *"xk9rln")]
    frame = spark.createDataFrame(rows, DOCS)
    found = {r.key: r for r in perplexity.judge(frame).collect()}
    assert sum(found[i].kept for i in range(120)) >= 119
    assert not found[900].kept and not found[900].base_failed
    assert found[901].base_failed and not found[901].kept
    kept = perplexity.accepted(frame)
    assert kept.dtypes == frame.dtypes
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k, r in found.items() if r.kept)


def test_quality_of_odd_rows(docs, no_docs):
    found = perplexity.judge(docs).collect()
    assert len(found) == len(corpus())
    text = {r[0]: r[1] for r in corpus()}
    for r in found:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_base(text[r.key])
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert perplexity.judge(no_docs).count() == 0
    assert perplexity.accepted(no_docs).count() == 0


def test_copies_do_not_narrow_the_band(spark):
    rows = [(i, prose(i, 150), "en", "a", 0, *"xk9rln") for i in range(60)]
    rows += [(1000 + i, prose(500, 150), "en", "a", 0, *"xk9rln") for i in range(140)]
    found = perplexity.judge(spark.createDataFrame(rows, DOCS)).collect()
    assert all(r.low < r.high for r in found)
    assert sum(r.kept for r in found if r.key < 1000) >= 58
    assert all(r.kept for r in found if r.key >= 1000)


@pytest.mark.parametrize("room", [perplexity.MODEL_ROWS, 1])
def test_languages_without_text_keep_their_rows(spark, monkeypatch, room):
    monkeypatch.setattr(perplexity, "MODEL_ROWS", room)
    rows = [(i, prose(i, 30), ("en", "de")[i % 2], "a", 0, *"xk9rln") for i in range(8)]
    rows += [(100, None, "fr", "a", 0, *"xk9rln"), (101, "", "fr", "a", 0, *"xk9rln"), (102, None, None, "a", 0, *"xk9rln")]
    frame = spark.createDataFrame(rows, DOCS)
    found = {r.key: r for r in perplexity.judge(frame).collect()}
    assert sorted(found) == sorted(r[0] for r in rows)
    assert all(found[k].base_failed and not found[k].kept and found[k].n_words == 0 for k in (100, 101, 102))
    assert not {100, 101, 102} & {r.doc_id for r in perplexity.accepted(frame).collect()}


def test_rare_languages_and_small_tables_are_judged(spark):
    rng = random.Random(8)
    noise = lambda: "".join(rng.choice("#@!~^{}[]qxzjk中文ÿ0123456789 ") for _ in range(4000))
    rows = [(i, prose(i, 150), "en", "a", 0, *"xk9rln") for i in range(80)]
    rows += [(100 + i, prose(100 + i, 150), (None, "de")[i % 2], "a", 0, *"xk9rln") for i in range(6)]
    rows += [(200, noise(), None, "a", 0, *"xk9rln"), (201, noise(), "de", "a", 0, *"xk9rln"), (202, noise(), "fr", "a", 0, *"xk9rln")]
    found = perplexity.judge(spark.createDataFrame(rows, DOCS)).collect()
    assert all(r.low < r.high for r in found)
    assert not any(r.kept or r.base_failed for r in found if r.key >= 200)
    assert sum(r.kept for r in found if r.key < 200) >= 85
    small = [(i, prose(i, 150), "en", "a", 0, *"xk9rln") for i in range(12)] + [(200, noise(), "en", "a", 0, *"xk9rln")]
    found = {r.key: r for r in perplexity.judge(spark.createDataFrame(small, DOCS)).collect()}
    assert not found[200].kept and not found[200].base_failed and sum(found[i].kept for i in range(12)) >= 11


def test_secrets_of_texts_with_very_many_finds_and_very_long_runs(spark):
    """Time that grows with the square of a text's finds or of a run's length would not end here."""
    rng = random.Random(31)
    hashes = [f"{rng.getrandbits(128):032x}" for _ in range(60_000)]
    tokens = [f"token={rng.getrandbits(60):015x}" for _ in range(20_000)]
    run = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(1_000_000))
    frame = spark.createDataFrame([(1, " ".join(hashes)), (2, "é " + "\n".join(tokens)), (3, run)], "doc_id long, text string")
    start = time.time()
    got = {r.row.doc_id: r.spans for r in secret_scan.scan(frame.repartition(3, "doc_id"), [0.1] * len(secret_scan.ALPHABET) ** 2, margin=0.05).collect()}
    assert time.time() - start < 120
    assert [(s.start, s.end) for s in got[1]] == [(33 * i, 33 * i + 32) for i in range(60_000)]
    assert [(s.start, s.end) for s in got[2]] == [(2 + 22 * i, 2 + 22 * i + 21) for i in range(20_000)]
    assert [(s.kind, s.start, s.end) for s in got[3]] == [(3, 0, 1_000_000)]
