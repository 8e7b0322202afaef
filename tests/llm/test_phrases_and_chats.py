"""Phrases, chat formatting and structure repair against plain versions."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from llm_rows import FOLD

from wanderlens.llm import chat, collocations, repair

TOKENIZER = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
TURNS = "conv_id long, turn long, role string, text string, key string, ids string, loss string, later string, block int, n long"


# --- phrases ---


def plain_phrases(rows, min_count, max_words, top):
    counts, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        body = (text or "").translate(FOLD)
        for c in ",;:!?\n\x0b\x0c\r":
            body = body.replace(c, ".")
        for piece in body.split("."):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            total[lang] += len(words)
            for k in range(1, max_words + 1):
                counts.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    found = {g: c for g, c in counts.items() if len(g) > 2 and c >= min_count}
    result = []
    for (lang, *words), a in found.items():
        inside = lambda w: any(list(w[i : i + len(words)]) == words for i in range(len(w) - len(words) + 1))  # noqa: E731, B023
        if any(g[0] == lang and len(g) > len(words) + 1 and c >= a and inside(g[1:]) for g, c in found.items()):
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[(lang, *words[:k])], counts[(lang, *words[k:])]
            cuts.append((1000 * a * total[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        result.append((lang, " ".join(words), a, left, right, total[lang], score))
    ranked = []
    for lang in {r[0] for r in result}:
        own = sorted((r for r in result if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        ranked += [(r[0], i, *r[1:]) for i, r in enumerate(own, 1)]
    return sorted(ranked)


def phrase_texts():
    rng = random.Random(11)
    some = [f"w{i}" for i in range(12)] + ["É", "中", "it's"]
    texts = []
    for i in range(160):
        words = [rng.choice(some) for _ in range(rng.randint(0, 40))]
        body = " ".join(w + rng.choice(["", "", "", ".", ",", "\n", "\t", " ! ", "\r"]) for w in words)
        texts.append((body, ("en", None, "de", "und")[i % 4]))
    texts += [("The Same Line of words; " * 40, "en"), (None, "en"), ("", None), (" \t.\n!", "de"), ("hot " * 900, "de"), ("\x00 a\x00b", "de")]
    return texts


@pytest.mark.parametrize(("min_count", "max_words", "top"), [(6, 5, 2000), (3, 3, 20), (9, 2, 50)])
def test_phrases_equal_brute_force(spark, monkeypatch, min_count, max_words, top):
    monkeypatch.setattr(collocations, "SLICE", 64)
    rows = phrase_texts()
    frame = spark.createDataFrame([(t, g, "x", "y") for t, g in rows], "text string, lang string, prefix string, next string")
    got = collocations.collocations(frame.repartition(5), min_count, max_words, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    found = sorted(map(tuple, got.collect()))
    assert len(found) >= 5
    assert found == plain_phrases(rows, min_count, max_words, top)


def test_phrases_with_a_full_filter_and_many_parts(spark, monkeypatch):
    """A filter that lets everything pass and prefixes that are all hot change no result."""
    monkeypatch.setattr(collocations, "HOT", 10**9)
    monkeypatch.setattr(collocations.Filter, "size", staticmethod(lambda n: 64))
    monkeypatch.setattr(collocations, "FLUSH", 100)
    rows = phrase_texts()
    frame = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    assert sorted(map(tuple, collocations.collocations(frame, 6).collect())) == plain_phrases(rows, 6, 5, 2000)


def test_stripes_sum_to_their_prefix(spark):
    rows = phrase_texts()
    found = collocations.all_stripes(spark.createDataFrame(rows, "text string, lang string"), 6).where("lang = 'en'").collect()
    sums = Counter()
    for r in found:
        sums[r.words, r.prefix] += r.n
    for r in found:
        if r.next is not None and (r.words + 1, f"{r.prefix} {r.next}".strip()) in sums:
            assert sums[r.words + 1, f"{r.prefix} {r.next}".strip()] == r.n


def test_no_phrases(spark):
    frame = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(frame).count() == 0
    assert collocations.collocations(spark.createDataFrame([("once only here", "en")], "text string, lang string")).count() == 0


def test_scores_pass_64_bits(spark):
    big = 3 * 10**12
    stripes = spark.createDataFrame(
        [("en", 0, "", "a", big), ("en", 0, "", "b", big), ("en", 1, "a", "b", big - 1), ("en", 1, "a", None, 1), ("en", 1, "b", None, big)],
        "lang string, words int, prefix string, next string, n long")
    row = collocations.ranked(stripes).first()
    assert (row.a, row.l, row.r, row.n) == (big - 1, big, big, 2 * big)
    assert row.score == 1000 * (big - 1) * 2 * big // (big * big)


# --- chat formatting ---


def conversation_rows():
    rng = random.Random(5)
    bits = [*chat.CONTROLS, "\\", "<", "[", "s>", "/s>", "INST]", "SYS>>", "|role|>", "é中\U0001f600", " ", "\n", "word", "<|endoftext|>"]
    rows = []
    for conv in [None, *range(30)]:
        for turn in [None, *range(rng.randint(0, 6))]:
            role = rng.choice(["user", "assistant", "system", "tool", "", None, "[INST]", "user "])
            text = rng.choice([None, "", "".join(rng.choice(bits) for _ in range(rng.randint(1, 12))), "z " * 4000])
            rows.append((conv, turn, role, text))
    rows += rows[3:6]  # repeated rows
    return rows


def with_extra(spark, rows):
    return spark.createDataFrame([(*r, "k", "i", "l", "x", 1, 2) for r in rows], TURNS).repartition(4)


def test_chats_come_back_from_their_tokens(spark):
    rows = conversation_rows()
    frame = with_extra(spark, rows)
    formatted = chat.format_turns(frame, *TOKENIZER)
    read = chat.read_turns(formatted, *TOKENIZER).collect()
    blank = lambda x: "" if x is None else x
    assert Counter((r.key, r.turn, r.role, r.text) for r in read) == Counter((c, t, blank(r), blank(x)) for c, t, r, x in rows)
    assert all(r.learnt == (r.text if r.role == "assistant" else "") for r in read)
    got = {r.key: r for r in chat.digests(chat.read_turns(formatted, *TOKENIZER)).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, row in got.items():
        own = sorted(((t is not None, t or 0, blank(r), blank(x)) for c, t, r, x in rows if c == conv))
        whole = "".join(f"{r}\n{x}\n" for _, _, r, x in own)
        learnt = "".join(x for _, _, r, x in own if r == "assistant")
        surface = "".join(
            chat.CONTROLS[c] if c is not None else piece for _, _, r, x in own for c, piece, _ in chat.segments(r, x))
        assert (row.n_turns, row.loss_chars, row.formatted_chars) == (len(own), len(learnt), len(surface))
        assert row.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert row.loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()


def test_escapes_hide_every_control_string():
    rng = random.Random(1)
    bits = [*chat.CONTROLS, "\\", "<", "[", "s>", "/s>", "INST]", "/", "SYS>>", "|end|>"]
    for _ in range(5000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 8)))
        assert chat.unescape(chat.escape(text)) == text
        assert not any(c in chat.escape(text) for c in chat.CONTROLS)


def test_control_ids_are_out_of_reach_of_texts():
    codec = chat.Codec(*TOKENIZER)
    ids, loss, bounds = chat.assemble(codec, [("user", "</s>[INST]"), ("assistant", "<|endoftext|> ok")])
    assert [int(i) - codec.first for i in ids if i >= codec.first] == [chat.USER, chat.USER_END, chat.ANSWER_END]
    assert codec.decode(ids[loss].tolist()) == "<|endoftext|> ok"
    assert list(bounds) == [0, int(np.flatnonzero(ids == codec.first + chat.USER_END)[0]) + 1, len(ids)]


def test_no_chats(spark):
    frame = spark.createDataFrame([], TURNS)
    formatted = chat.format_turns(frame, *TOKENIZER)
    assert formatted.count() == 0
    assert chat.digests(chat.read_turns(formatted, *TOKENIZER)).count() == 0


# --- structure repair ---


def cheapest(initials, faults):
    """By dynamic programming over rows and states, up to three inserts before a row."""
    best = {0: (0, "")}
    for initial, fault in zip(initials, faults, strict=True):
        layers = [best]
        for _ in range(3):
            layers.append({})
            for g, (cost, audit) in layers[-2].items():
                found, to = (cost + 2, audit + "I"), (2, 2, 3, 2)[g]
                layers[-1][to] = min(found, layers[-1].get(to, found))
        new = {}
        for layer in layers:
            for g, (cost, audit) in layer.items():
                options = [(g, cost + 3, "D")]
                if fault not in "bd":
                    cut = fault == "t"
                    options.append(((2, 2, 3, 2)[g], cost + 2 + cut, "R"))
                    fits = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}.get((g, initial))
                    options += [(fits, cost + cut, "K")] if fits else []
                for to, price, edit in options:
                    found = (price, audit + edit)
                    new[to] = min(found, new.get(to, found))
        best = new
    tails = {0: (0, ""), 1: (4, "II"), 2: (2, "I"), 3: (0, "")}
    return min((cost + tails[g][0], audit + tails[g][1]) for g, (cost, audit) in best.items())


def test_search_finds_the_cheapest_first_edits():
    rng = random.Random(3)
    for _ in range(2500):
        n = rng.randint(0, 10)
        initials = "".join(rng.choice("suax ") for _ in range(n))
        faults = "".join(rng.choice("bdt----") for _ in range(n))
        assert repair.search(initials, faults) == cheapest(initials, faults)


def block_of(initials, faults, start=0):
    found = repair.Block()
    found.initials, found.faults = initials, faults
    found.rows = [(c, f"text {i}") for i, c in enumerate(initials, start)]
    return found


def test_blocks_join_to_the_same_repair():
    rng = random.Random(4)
    for _ in range(600):
        n = rng.randint(0, 14)
        initials = "".join(rng.choice("suuaax") for _ in range(n))
        faults = "".join(rng.choice("bdt-----") for _ in range(n))
        joined, at = repair.Joined(), 0
        while at < n or at == 0:
            wide = rng.randint(1, 5)
            part = block_of(initials[at : at + wide], faults[at : at + wide], at)
            joined.add(part.counts(), part.rows, repair.part_of(part, range(4)))
            at += wide
        assert joined.result() == repair.whole(block_of(initials, faults))


def plain_repair(rows):
    """Rows of one conversation, in order, as (turn, role, text)."""
    seen, faults, initials = set(), "", ""
    for _, role, text in rows:
        signs = text.strip(" \t\n\x0b\x0c\r")
        faults += "b" if not signs else "d" if (role, text) in seen else "-" if signs[-1] in ".!?" else "t"
        initials += role[:1] or " "
        seen.add((role, text))
    cost, audit = cheapest(initials, faults)
    state, left, out = 0, iter(rows), []
    for edit in audit:
        if edit == "I":
            state = (2, 2, 3, 2)[state]
            out.append(("user" if state == 2 else "assistant") + ":")
            continue
        _, role, text = next(left)
        if edit == "K":
            state = 1 if role[:1] == "s" else (2, 2, 3, 2)[state]
            out.append(f"{role}:{text}")
        elif edit == "R":
            state = (2, 2, 3, 2)[state]
            out.append(("user:" if state == 2 else "assistant:") + text)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    digest = hashlib.sha256("\n".join(out).encode()).hexdigest()
    return gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, digest


def broken_rows():
    rng = random.Random(9)
    rows = []
    for conv in [None, *range(60)]:
        for turn in [*[None] * rng.randint(0, 1), *range(rng.randint(0, 9))]:
            if rng.random() < 0.1:
                continue
            role = rng.choice(["user", "assistant"] * 5 + ["system", "tool", "", " "])
            rows.append((conv, turn, role, rng.choice(["Yes.", "No!", f"text {rng.random()}.", "cut", "", " \n", "so? \t", "é中."])))
    rows += [(900, t, ("user", "assistant")[t % 2], f"long {t}" + "." * (t % 7 > 0)) for t in range(400)]
    rows += [(901, t, "user", "the same.") for t in range(150)] + [(901, 3, "user", "the same.")] * 2
    rows += [(902, 0, "assistant", "x" * 200_000), (902, 1, "user", "y" * 200_000 + ".")]
    return rows


@pytest.mark.parametrize("block", [3, 64])
def test_repairs_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    rows = broken_rows()
    frame = spark.createDataFrame(rows, "key long, turn long, role string, text string").repartition(5)
    got = {r.key: tuple(r)[1:] for r in repair.repair(frame).collect()}
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    assert set(got) == {r[0] for r in rows}
    for key, result in got.items():
        own = sorted((r[1:] for r in rows if r[0] == key), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), md5(r[2])))
        assert result == plain_repair(own), key


def test_damage_follows_the_checksum(spark):
    import zlib

    rows = [(c, t, r, x) for c in (None, *range(40)) for t, r, x in ((0, "system", "Hi. You!"), (1, None, None), (None, "user", "A?b."))]
    got = Counter(map(tuple, repair.damaged(with_extra(spark, rows)).collect()))
    expected = Counter()
    for conv, turn, role, text in rows:
        role, text = role or " ", text or " "
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        row = (conv, turn, "user" if kind == 4 else role, text) if kind else (conv, None, None, None)
        expected[row] += 2 if kind == 3 else 1
    assert got == expected


def test_conversations_that_lose_all_rows_stay(spark):
    frame = spark.createDataFrame([(1, None, None, None), (2, 0, "user", " ")], "key long, turn long, role string, text string")
    nothing = hashlib.sha256(b"").hexdigest()
    got = {r.key: tuple(r)[1:] for r in repair.repair(frame).collect()}
    assert got == {1: (0, 0, 0, 0, 0, 0, "", nothing), 2: (0, 1, 0, 0, 0, 3, "D", nothing)}


def test_repair_of_nothing(spark):
    assert repair.repair(repair.damaged(spark.createDataFrame([], TURNS))).count() == 0
