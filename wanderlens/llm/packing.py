"""Pack token pieces into sequences of fixed capacity by best-two-fit.

A document is its tokens and an end token. Only documents longer than the capacity are cut. The
pieces are dealt at random to groups of about ``GROUP`` pieces; only their lengths are looked at
there, so a group is a few MB whatever the texts are. In a group a sequence is filled greedily with
the longest piece that still fits; then its smallest piece gives way to two unpacked pieces that
fit the widened gap more tightly, where there are such. A group leaves one or two sequences
partly filled, out of thousands.

Texts are read once, in place, and never shuffled: each task keeps the ids of the words it has met
lately, about twice ``CACHE`` of them, which saves most of the merging work and changes no id.

Defined cases: a null text is an empty one, a sequence of the end token alone; repeated rows are
packed each; control characters and special tokens in a text are what the library makes of them; ties
between equal lengths fall as they come; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
import zlib
from array import array
from bisect import bisect_right, insort
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wanderlens.sources.stored import stored

CAPACITY = 4096
END = 1
GROUP = 1 << 15
CACHE = 200_000


#: Marks the end of a word; no UTF-8 text holds this byte.
END_OF_WORD = b"\xff"


def word_merger(tokenizer, letters: dict[int, int], special: list[str]) -> Callable[[bytes], list[int]]:
    """From the bytes of a word and ``END_OF_WORD`` to its ids, by the vocabulary's merges.

    Ids are in the order of the merges, so the pair with the smallest id is merged first, as in the library. Pairs
    are known by the token they make. That is the same as by their two parts if every token, merged by
    itself with the tokens before it, ends as the two parts of its own merge; tests check each of them.
    """
    import tiktoken

    of_letter = {chr(letter): byte for byte, letter in letters.items()}
    ranks = {END_OF_WORD: 1 << 30}
    for token, rank in tokenizer.get_vocab().items():
        if token not in special:
            body, end = (token[:-4], END_OF_WORD) if token.endswith("</w>") else (token, b"")
            ranks[bytes(of_letter.get(c, ord(c)) for c in body) + end] = rank
    return tiktoken.Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={})._encode_single_piece


class WordIds:
    """Ids of whole texts, put together from the ids of their words.

    For vocabularies that fold case and drop white space: no token crosses white space there, so a
    text's ids are those of its words. Unseen words are cut into the pieces that the library cuts them
    into, and those are merged. Texts with special tokens, with characters that are not
    assigned or may count as white space, or for a tokenizer of another make, go to the library as they are.
    Words that were not met for ``CACHE`` others are forgotten.
    """

    #: Fixed value: how this vocabulary's file splits a word.
    SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    #: Not assigned yet to the one library, maybe so to the other.
    UNASSIGNED = regex.compile(r"\p{Cn}")
    #: Characters that only Python takes for white space.
    SEPARATORS = "\x1c\x1d\x1e\x1f"

    #: The letters that byte-level vocabularies write for bytes that do not print, in order of the bytes.
    LETTERS = {b: 256 + i for i, b in enumerate([*range(33), *range(127, 161), 173])}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.plain = "NFC" in str(self.tokenizer.normalizer) and "Lowercase" in str(self.tokenizer.normalizer)
        self.merge = word_merger(self.tokenizer, self.LETTERS, self.special) if self.plain else None

    def _pieces(self, word: str) -> list[str]:
        if word[-1] in ".,;:!?" and word[:-1].isalpha():
            return [word[:-1], word[-1]]
        return self.SPLIT.findall(word)

    def _piece(self, piece: str) -> bytes:
        found = self.known.get(piece) or self.before.get(piece)
        return array("I", self.merge(piece.encode() + END_OF_WORD)).tobytes() if found is None else found

    def _learn(self, words: set[str]) -> None:
        """Remember the ids of words that are not known; those that only the library can judge are left out."""
        known, before = self.known, self.before
        for word in words:
            found = before.get(word)
            if found is None:
                if word.isascii():
                    folded = word.lower()
                elif word.isprintable() and not self.UNASSIGNED.search(word):
                    folded = unicodedata.normalize("NFC", word).replace("Σ", "σ").lower()
                else:
                    continue
                if folded.isalpha():
                    found = self._piece(folded)
                else:
                    parts = self._pieces(folded)
                    found = known[parts[0]] = self._piece(parts[0])  # mostly the word without its mark
                    if len(parts) > 1:
                        found = b"".join([found, *map(self._piece, parts[1:])])
            known[word] = found

    def __call__(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit numbers."""
        if not self.plain or any(c in text for c in self.SEPARATORS) or any(t in text for t in self.special):
            return self._by_library(text)
        if len(self.known) > CACHE:
            self.before, self.known = self.known, {}
        words = text.split()
        ids = [*map(self.known.get, words)]
        if None in ids:
            self._learn({w for w, found in zip(words, ids, strict=True) if found is None})
            ids = [*map(self.known.get, words)]
        return self._by_library(text) if None in ids else b"".join(ids)

    def _by_library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence of each piece and its place there.

    Where no piece is short, trading one for two can use up the pieces that later sequences need;
    the greedy filling alone is kept if it takes fewer sequences.
    """
    traded, plain = _fill(lengths, capacity, True), _fill(lengths, capacity, False)
    return plain if plain[0].max(initial=0) < traded[0].max(initial=0) else traded


def _fill(lengths: np.ndarray, capacity: int, trade: bool) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(lengths, kind="stable")
    sizes, starts = np.unique(lengths[order], return_index=True)
    left = {int(n): list(part) for n, part in zip(sizes, np.split(order, starts[1:]), strict=True)}
    open_sizes = sorted(left)
    as_array: np.ndarray | None = None
    sequence, place = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)

    def pop(n: int) -> int:
        nonlocal as_array
        item = left[n].pop()
        if not left[n]:
            del left[n]
            open_sizes.remove(n)
            as_array = None
        return item

    def tighter_pair(gap: int, than: int) -> tuple[int, int] | None:
        """Two open lengths with the largest sum above ``than`` and up to ``gap``."""
        nonlocal as_array
        if as_array is None:
            as_array = np.array(open_sizes, np.int64)
        firsts = as_array[: np.searchsorted(as_array, gap // 2, "right")]
        if not len(firsts):
            return None
        at = np.searchsorted(as_array, gap - firsts, "right") - 1
        seconds = as_array[at]
        for i in np.flatnonzero(seconds <= firsts):  # the same length twice takes two pieces of it
            a = int(firsts[i])
            seconds[i] = a if len(left[a]) > 1 else -gap
        best = int(np.argmax(firsts + seconds))
        a, b = int(firsts[best]), int(seconds[best])
        return (a, b) if than < a + b <= gap else None

    number = 0
    while open_sizes:
        gap, chosen = capacity, []
        while (at := bisect_right(open_sizes, gap)) > 0:
            n = open_sizes[at - 1]
            chosen.append((n, pop(n)))
            gap -= n
            if not open_sizes:
                break
        if trade and gap and open_sizes and len(chosen) > 1 and (pair := tighter_pair(gap + chosen[-1][0], chosen[-1][0])):
            n, item = chosen.pop()
            chosen += [(m, pop(m)) for m in pair]
            if n not in left:
                insort(open_sizes, n)
                as_array = None
            left.setdefault(n, []).append(item)
        offset = 0
        for n, item in chosen:
            sequence[item], place[item] = number, offset
            offset += n
        number += 1
    return sequence, place


def pieces(
    docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY,
    end: int = END, keep_ids: bool = False,
) -> DataFrame:
    """``key, piece, start, length, ids_crc32, lot`` and, if asked, the ``ids``, for each piece of each document."""

    def cut(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, task, number = WordIds(tokenizer), TaskContext.get().partitionId(), 0
        last = np.array([end], "<u4").tobytes()
        for batch in batches:
            for at in range(0, len(batch), 500):
                rows = []
                part = batch.iloc[at : at + 500]
                for name, body in zip(part["key"], part["text"], strict=True):
                    ids = encode(body or "") + last
                    for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[start : start + 4 * capacity]
                        lot = zlib.crc32(f"{task}:{number}".encode())
                        number += 1
                        row = (name, piece, start // 4, len(own) // 4, zlib.crc32(own), lot)
                        rows.append((*row, np.frombuffer(own, "<u4").astype(np.int32)) if keep_ids else row)
                names = ["key", "piece", "start", "length", "ids_crc32", "lot", *["ids"] * keep_ids]
                yield pd.DataFrame(rows, columns=names).astype({"key": object})

    kind = dict(docs.dtypes)[key]
    schema = f"key {kind}, piece int, start long, length long, ids_crc32 long, lot long"
    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInPandas(
        cut, schema + ", ids array<int>" * keep_ids)


def pack(
    docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY,
    end: int = END, keep_ids: bool = False,
) -> DataFrame:
    """Each piece with ``sequence_id`` and its ``offset`` there."""
    cuts = stored(pieces(docs, tokenizer, text, key, capacity, end, keep_ids), "pieces")
    groups = max(1, -(-cuts.count() // GROUP))

    def place(group: pd.DataFrame) -> pd.DataFrame:
        sequence, offset = best_two_fit(group["length"].to_numpy(), capacity)
        base = int(group["_group"].iloc[0]) << 32
        return group.drop(columns=["lot", "_group"]).assign(sequence_id=base + sequence, offset=offset)

    columns = [(c, t) for c, t in cuts.dtypes if c != "lot"]
    schema = ", ".join(f"{c} {t}" for c, t in columns) + ", sequence_id long, offset long"
    dealt = cuts.withColumn("_group", F.pmod("lot", F.lit(groups)))
    return dealt.groupBy("_group").applyInPandas(place, schema)
