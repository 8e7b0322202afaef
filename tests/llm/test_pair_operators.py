"""The similarity join, components and packing against plain versions."""

import bisect
import pathlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from llm_rows import DOCS, FOLD, corpus, docs, near, no_docs, prose, words  # noqa: F401
from tokenizers import Tokenizer

from wanderlens.llm import jaccard, packing
from wanderlens.llm.components import components
from wanderlens.llm.shingles import parts, shingle_sets

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


# --- similarity join ---


def plain_set(text):
    found = words((text or "").translate(FOLD))
    if len(found) < 5:
        return frozenset({tuple(found)} if found else ())
    return frozenset(tuple(found[i : i + 5]) for i in range(len(found) - 4))


class Forest:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def plain_join(rows):
    """Every pair of different sets is looked at."""
    sets = {r[0]: plain_set(r[1]) for r in rows if r[0] is not None}
    forest = Forest()
    keys = [k for k, s in sorted(sets.items()) if s]
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                forest.join(a, b)
    return {k: (len(s), forest.find(k)) for k, s in sets.items()}


def plain_links(rows):
    """For each key the number of other rows that it links with, copies included."""
    sets = [(r[0], plain_set(r[1])) for r in rows if r[0] is not None]
    linked = Counter()
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                linked.update((a, b))
    copies = Counter(k for k, _ in sets)
    return {k: linked[k] // copies[k] for k in copies}


def check_join(spark, rows, parts=4):
    found = jaccard.join(spark.createDataFrame(rows, DOCS).repartition(parts)).collect()
    expected, links = plain_join(rows), plain_links(rows)
    assert Counter(r.key for r in found) == Counter(r[0] for r in rows)
    for r in found:
        if r.key is None:
            assert r.component_id is None and r.n_links == 0
        else:
            assert (r.n_shingles, r.component_id) == expected[r.key]
            assert r.n_links == links[r.key]


def test_shingles_are_distinct_word_windows():
    texts = [r[1] for r in corpus()]
    hashed = list(shingle_sets(texts))
    plain = [plain_set(t) for t in texts]
    assert [len(h) for h in hashed] == [len(p) for p in plain]
    for i in range(len(texts)):
        for j in range(i):
            assert len(np.intersect1d(hashed[i], hashed[j])) == len(plain[i] & plain[j])


def test_parts_hold_every_text_once():
    rng = random.Random(6)
    for _ in range(50):
        lengths = [rng.choice([0, 1, 5, 90, 1000]) for _ in range(rng.randint(0, 40))]
        found = list(parts(lengths, 7, 100))
        assert [i for p in found for i in range(len(lengths))[p]] == list(range(len(lengths)))
        assert all(len(lengths[p]) <= 7 and (len(lengths[p]) == 1 or sum(lengths[p]) <= 100) for p in found)


def test_join_of_odd_rows(spark):
    check_join(spark, corpus())


def test_links_of_a_large_component_are_counted_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    monkeypatch.setattr(jaccard, "SHINGLES", 900)
    rng, base = random.Random(15), prose(700, 150, 5000)
    rows = [(i, near(base, 7000 + i, rng.randint(0, 5)), "en", "a", 0, *"xk9rln") for i in range(50)]
    rows += [(100 + i, rows[i % 4][1], "en", "a", 0, *"xk9rln") for i in range(9)]
    rows += [(200 + i, prose(800 + i // 3, 40, 5000), "en", "a", 0, *"xk9rln") for i in range(12)]
    check_join(spark, rows, 3)


def test_join_of_copies_near_copies_and_shared_passages(spark):
    rng = random.Random(5)
    rows, base = [], prose(500, 260, 5000)
    add = lambda text: rows.append((len(rows), text, "en", "a", 0, *"xk9rln"))
    for i in range(60):  # near copies of one text, at many distances, some of them linked by others only
        add(near(base, 1000 + i, rng.randint(0, 14)))
    for _ in range(20):
        add(base)
    chain = prose(501, 120, 5000)
    for i in range(12):  # each is like the next, the ends are not alike
        add(chain)
        chain = near(chain, 2000 + i, 3)
    passage = prose(502, 60, 5000)
    for i in range(60):  # a long passage in common, around the threshold
        add(passage + "\n" + prose(3000 + i, rng.randint(1, 40), 5000))
    for i in range(30):
        add(prose(4000 + i, rng.randint(5, 12), 30))
    check_join(spark, rows, 5)


def test_join_at_the_threshold(spark):
    numbered = [f"n{i}" for i in range(200)]
    rows = []
    for n in (8, 11, 20, 32, 47, 104):  # prefixes of one sequence have a similarity of n over m windows
        for m in {n, -(-3 * (n - 4) // 4) + 3, -(-3 * (n - 4) // 4) + 4, -(-3 * (n - 4) // 4) + 5}:
            rows.append((len(rows), " ".join(f"{n}{w}" for w in numbered[:m]), "en", "a", 0, *"xk9rln"))
    check_join(spark, rows, 2)


def test_one_of_each_component_stays(spark, no_docs):
    rows = corpus()
    frame = spark.createDataFrame(rows, DOCS)
    kept = jaccard.one_each(frame)
    assert kept.dtypes == frame.dtypes
    expected = plain_join(rows)
    wanted = Counter(r[0] for r in rows if r[0] is None or expected[r[0]][0] == 0 or expected[r[0]][1] == r[0])
    wanted[7] = 1  # the repeated row
    assert Counter(r.doc_id for r in kept.collect()) == wanted
    assert jaccard.join(no_docs).count() == 0 and jaccard.one_each(no_docs).count() == 0


def test_components_of_random_graphs(spark):
    rng = random.Random(2)
    path = [(i, i + 1) for i in range(1000, 1090)]
    edges = path + [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(5, 5)]
    forest = Forest()
    for a, b in edges:
        forest.join(a, b)
    found = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: forest.find(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- packing ---


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths.tolist(), reverse=True):
        at = bisect.bisect_left(gaps, n)
        gap = gaps.pop(at) if at < len(gaps) else capacity
        bisect.insort(gaps, gap - n)
    return len(gaps)


@pytest.mark.parametrize("capacity", [10, 64, 4096])
def test_best_two_fit_packs_every_piece_once(capacity):
    rng = np.random.default_rng(capacity)
    middling = rng.integers(capacity // 5 + 1, capacity // 2, 2000)
    for lengths in (rng.integers(1, capacity + 1, 700), rng.integers(1, capacity // 3 + 1, 3000), middling, np.array([capacity] * 3), np.array([1])):
        sequence, place = packing.best_two_fit(lengths, capacity)
        filled = np.bincount(sequence, lengths)
        assert filled.max() <= capacity
        for s in range(len(filled)):
            own = np.flatnonzero(sequence == s)
            own = own[np.argsort(place[own])]
            assert place[own].tolist() == np.concatenate([[0], np.cumsum(lengths[own])[:-1]]).tolist()
        assert len(filled) <= best_fit_decreasing(lengths, capacity) + 1


def test_two_pieces_replace_the_smallest():
    sequence, _ = packing.best_two_fit(np.array([60, 30, 21, 19]), 100)
    assert len({sequence[0], sequence[2], sequence[3]}) == 1 and sequence[1] != sequence[0]


def test_ids_equal_the_tokenizer():
    encode = packing.WordIds(VOCABULARY)
    plain = Tokenizer.from_file(VOCABULARY)
    odd = ["ab\x00cd", "a\x7fb \x01", "x<|ENDOFTEXT|>", "<|endoftext|><|endoftext|>", "ΑΣ. ΣΣ", "don't stop", "a\u00a0b\u2003c\x1cd\x85e", "e\u0301 \u212b ΑΣ ΣΑΣ İI ß", "x<|endoftext|>y <|startoftext|>", "1234 ½ ² ٣ a_b-c...!!", "\U0001f600\U0001f468\u200d\U0001f469 中文", "it'S we'LL 's", "\ufeffx\u200by\u180ez"]
    for text in odd + [r[1] or "" for r in corpus()]:
        assert np.frombuffer(encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_every_token_is_made_by_its_own_merge():
    """What ``word_merger`` relies on: of each token the tokens before it leave the two parts of its merge."""
    import json

    spec = json.loads(pathlib.Path(VOCABULARY).read_text())["model"]
    ranks = spec["vocab"]
    ids = []
    for merge in spec["merges"]:
        first, second = merge.split(" ") if isinstance(merge, str) else merge
        ids.append(ranks[first + second])
        whole = first + second
        body, end = (whole[:-4], "</w>") if whole.endswith("</w>") else (whole, "")
        parts = [*body[:-1], body[-1] + end]
        while True:
            found = [(r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1], ids[-1])) < ids[-1]]
            if not found:
                break
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert parts == [first, second]
    assert ids == sorted(set(ids)) and ids[0] == 512


def test_ids_of_every_character_equal_the_tokenizer(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 5000)  # words are forgotten and met again
    encode, plain = packing.WordIds(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    codes = [c for c in (*range(0x30000), *range(0xE0000, 0xE0200)) if not 0xD800 <= c <= 0xDFFF]
    for at in range(0, len(codes), 5000):
        texts = [f"ab{chr(c)}cd {chr(c)} x{chr(c)}{chr(c)}9" for c in codes[at : at + 5000]]
        for text, found in zip(texts, plain.encode_batch(texts, add_special_tokens=False), strict=True):
            assert np.frombuffer(encode(text), "<u4").tolist() == found.ids, hex(ord(text[2]))


@pytest.mark.parametrize("capacity", [64, 4096])
def test_pack_places_all_pieces(docs, capacity):
    rows = packing.pack(docs, VOCABULARY, capacity=capacity, keep_ids=True).toPandas()
    plain = Tokenizer.from_file(VOCABULARY)
    expected = Counter()
    for r in corpus():
        ids = np.array([*plain.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        for piece, start in enumerate(range(0, len(ids), capacity)):
            own = ids[start : start + capacity]
            expected[(r[0] if r[0] is not None else -1, piece, start, len(own), zlib.crc32(own.tobytes()))] += 1
    found = Counter(zip(rows.key.fillna(-1).astype(int), rows.piece, rows.start, rows.length, rows.ids_crc32, strict=True))
    assert found == expected
    assert all(zlib.crc32(np.array(i, "<u4").tobytes()) == c for i, c in zip(rows.ids, rows.ids_crc32, strict=True))
    filled = rows.groupby("sequence_id").length.sum()
    assert filled.max() <= capacity
    assert len(filled) <= 1.02 * -(-filled.sum() // capacity) + 1
    for _, own in rows.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]]


def test_pack_of_nothing(no_docs):
    assert packing.pack(no_docs, VOCABULARY).count() == 0
