"""Substring deduplication with repeated-phrase automata.

1. Candidates: of the word 8-grams of each window of 20 words the smallest hash is kept; a window that recurs
   shares it, so only windows whose smallest 8-gram recurs go on.
2. Confirmation: 128-bit hashes of those windows meet in shards, which find the windows that recur and the
   place where each starts first in the corpus.
3. Location: each block of documents compiles the passages that recur, as strings of one code point for each
   distinct word, into an Aho-Corasick automaton of anchors (10 words, every 11 words, so that each window holds
   a whole one) and streams its documents through it.  Hits are extended word by word; whatever is covered by a
   window that starts earlier elsewhere is removed.

The automata are sharded by block: a block's automaton holds the recurring passages that occur in that block,
so documents are streamed once, however many passages the corpus has.

Defined cases: null and empty texts have no words; a null doc_id sorts after every id; of rows with the same
doc_id neither is earlier than the other at the same word, so both keep it; documents of fewer than 20 words are
never cut; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import blocks as B
from graphloom.llm.common import NO_ID, roll, table, word_hashes
from graphloom.llm.decontamination import sliding

WINDOW, GRAM = 20, 8
RESULT = "doc_id long, n_words long, n_removed long, kept string"


class Words:
    """The words of a block's documents in one row; windows that cross documents don't count."""

    def __init__(self, data: bytes):
        self.ids, texts = B.unpack_docs(data)
        self.each = [t.encode("utf-8", "surrogatepass").split() for t in texts]
        self.bounds = np.r_[0, np.cumsum([len(w) for w in self.each])].astype(np.int64)
        self.words = [x for w in self.each for x in w]
        self.keys = np.array([NO_ID if i is None else i for i in self.ids], np.int64)

    def hashes(self) -> np.ndarray:
        return word_hashes(self.words)

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, at, "right") - 1

    def whole(self, width: int) -> np.ndarray:
        """Whether the window that starts at a word ends in the same document."""
        ends = np.repeat(self.bounds[1:], np.diff(self.bounds))
        return (np.arange(len(self.words)) + width <= ends)[: max(0, len(self.words) - width + 1)]


def least_grams(w: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows, and the smallest 8-gram of each."""
    grams = roll(hashes, GRAM)
    if len(grams) < WINDOW - GRAM + 1:
        return np.empty(0, np.int64), grams[:0]
    starts = np.flatnonzero(w.whole(WINDOW))
    return starts, sliding(grams, WINDOW - GRAM + 1)[starts]


def least_places(w: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct smallest 8-grams, sorted, and whether each stands at more than one place of the block."""
    grams = roll(hashes, GRAM)
    width = WINDOW - GRAM + 1
    if len(grams) < width:
        return grams[:0], np.zeros(0, bool)
    least = sliding(grams, width)
    least[~w.whole(WINDOW)] = 0  # the largest of a gram's windows then is the gram only if a whole window chose it
    edge = np.zeros(width - 1, np.uint64)
    picked = np.sort(grams[(sliding(np.concatenate([edge, least, edge]), width, np.maximum) == grams)])
    first = np.r_[True, picked[1:] != picked[:-1]] if len(picked) else np.zeros(0, bool)
    return picked[first], np.diff(np.r_[np.flatnonzero(first), len(picked)]) > 1


def propose(shards: int):
    def make(block: int, ids: list, texts: list) -> Iterable[B.Part]:
        data = B.pack_docs(ids, texts)
        w = Words(data)
        grams, many = least_places(w, w.hashes())
        yield block, B.PAYLOAD, len(texts), data
        for s, at in B.by_shard(grams, shards):
            yield block, s, len(grams[at]), B.press(grams[at].tobytes() + np.packbits(many[at]).tobytes())

    return make


def recurring(shard: int, pdf: pd.DataFrame) -> Iterable[B.Part]:
    """For each block a bit for each of its 8-grams: whether it recurs in the corpus."""
    raw = [B.unpress(d) for d in pdf.data]
    grams = [np.frombuffer(r, np.uint64, n) for r, n in zip(raw, pdf["size"], strict=True)]
    many = [np.unpackbits(np.frombuffer(r, np.uint8, offset=8 * n), count=n).astype(bool) for r, n in zip(raw, pdf["size"], strict=True)]
    keys, back, count = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    again = count > 1
    again[back[np.concatenate(many)]] = True
    for block, own in zip(pdf.block, np.split(again[back], np.cumsum([len(g) for g in grams])[:-1]), strict=True):
        yield block, shard, len(own), B.press(np.packbits(own).tobytes() + b"\0")


def confirm(shards: int):
    def finish(block: int, data: bytes, answers: dict[int, tuple[int, bytes]], _) -> pd.DataFrame:
        """Sends each shard the block's first place of each candidate window; keeps the places as a note."""
        w = Words(data)
        hashes = w.hashes()
        grams, _many = least_places(w, hashes)
        again = np.zeros(len(grams), bool)
        for s, at in B.by_shard(grams, shards):
            again[at] = np.unpackbits(np.frombuffer(B.unpress(answers[s][1]), np.uint8), count=at.stop - at.start).astype(bool)
        known = grams[again]
        starts, least = least_grams(w, hashes)
        starts = starts[np.isin(least, known)] if len(known) else starts[:0]
        one, two = roll(hashes, WINDOW), roll(hashes, WINDOW, base=0xC2B2AE3D27D4EB4F)
        one, two = one[starts], two[starts]
        order = np.lexsort((starts, two, one))
        one, two, starts = one[order], two[order], starts[order]
        first = np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])] if len(one) else np.zeros(0, bool)
        many = np.diff(np.r_[np.flatnonzero(first), len(one)]) > 1
        one, two, starts = one[first], two[first], starts[first]
        docs = w.doc_of(starts)
        rows = [(block, B.NOTE, len(starts), B.press(np.r_[starts, many].astype(np.int64)))]
        for s, at in B.by_shard(one, shards):
            packed = b"".join(x[at].tobytes() for x in (one, two, w.keys[docs], starts - w.bounds[docs]))
            rows.append((block, s, at.stop - at.start, B.press(packed + np.packbits(many[at]).tobytes())))
        return pd.DataFrame(rows, columns=["block", "shard", "size", "data"])

    return finish


def first_places(shard: int, pdf: pd.DataFrame) -> Iterable[B.Part]:
    """For each block two bits for each of its windows: whether it recurs, and whether its first place is the corpus's."""
    columns: list[list[np.ndarray]] = [[], [], [], [], []]
    for d, n in zip(pdf.data, pdf["size"], strict=True):
        raw = B.unpress(d)
        for k, kind in enumerate((np.uint64, np.uint64, np.int64, np.int64)):
            columns[k].append(np.frombuffer(raw, kind, n, offset=8 * n * k))
        columns[4].append(np.unpackbits(np.frombuffer(raw, np.uint8, offset=32 * n), count=n).astype(bool))
    one, two, doc, at, many = (np.concatenate(c) for c in columns)
    order = np.lexsort((at, doc, two, one))
    o, t, d, p = one[order], two[order], doc[order], at[order]
    new = np.r_[True, (o[1:] != o[:-1]) | (t[1:] != t[:-1])]
    group = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    size = np.diff(np.r_[heads, len(o)])
    again, first = np.empty(len(o), bool), np.empty(len(o), bool)
    again[order] = ((size > 1) | np.bitwise_or.reduceat(many[order], heads))[group]
    first[order] = (d == d[heads][group]) & (p == p[heads][group])
    edges = np.cumsum(pdf["size"].to_numpy())[:-1]
    for block, a, f in zip(pdf.block, np.split(again, edges), np.split(first, edges), strict=True):
        yield block, shard, len(a), B.press(np.packbits(np.r_[a, f]).tobytes() + b"\0")


def as_characters(words: list[bytes], bounds: np.ndarray) -> str:
    """A string with one code point for each distinct word, and U+0000 behind each document."""
    known: defaultdict[bytes, int] = defaultdict()
    known.default_factory = lambda: len(known) + 1
    codes = np.fromiter(map(known.__getitem__, words), np.uint32, len(words))
    codes = np.where(codes >= 0xD800, codes + 0x800, codes)  # not the surrogates
    if len(known) + 0x800 > 0x10FFFF:
        raise ValueError("a block has more distinct words than there are code points")
    return np.insert(codes, bounds[1:], 0).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def spelled(codes: np.ndarray, digits: int) -> str:
    """Each code as so many letters of 32, with other letters for each place: a node of the automaton has few children."""
    places = np.arange(digits - 1, -1, -1)
    return ((codes[:, None] >> (5 * places)) % 32 + 32 * places).astype(np.uint8).tobytes().decode("latin-1")


class Passages:
    """Runs of windows that recur, as an automaton of anchors over a block's own text."""

    def __init__(self, text: str, starts: np.ndarray, anchor: int = WINDOW // 2):
        """starts: sorted places in text at which a recurring window starts first in the block."""
        self.text, self.anchor = text, anchor
        cut = np.flatnonzero(np.diff(starts) != 1) + 1
        self.runs = [(int(r[0]), int(r[-1]) + WINDOW) for r in np.split(starts, cut)] if len(starts) else []
        self.automaton = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = {}
        for k, (a, b) in enumerate(self.runs):
            for p in range(a, b - anchor + 1, WINDOW - anchor + 1):
                places.setdefault(text[p : p + anchor], []).append((k, p))
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        self.digits = max(1, -(-int(codes.max(initial=1)).bit_length() // 5))
        if self.digits > 8:
            raise ValueError("a block has too many distinct words")
        self.stream = spelled(codes, self.digits)
        for at in places.values():
            p = at[0][1]
            self.automaton.add_word(self.stream[p * self.digits : (p + anchor) * self.digits], at)
        self.automaton.make_automaton()

    def occurrences(self) -> Iterable[tuple[int, int, int]]:
        """(start, end, shift): text[start:end] equals what stands shift earlier or later in a passage, and is as long as it gets."""
        text, done, width = self.text, {}, self.anchor
        if not self.runs:
            return
        for last, found in self.automaton.iter(self.stream):
            at = (last + 1) // self.digits - width
            for k, p in found:
                shift = at - p
                if shift == 0 or done.get((k, shift), -1) > at:
                    continue
                a, b = self.runs[k]
                x, y = p, p + width
                while x - width >= a and text[x - width : x] == text[x + shift - width : x + shift]:
                    x -= width
                while x > a and text[x - 1] == text[x - 1 + shift]:
                    x -= 1
                while y + width <= b and text[y : y + width] == text[y + shift : y + shift + width]:
                    y += width
                while y < b and text[y] == text[y + shift]:  # the text ends with a sign that is in no passage
                    y += 1
                done[k, shift] = y + shift
                if y - x >= WINDOW:
                    yield x + shift, y + shift, shift


def covered(w: Words, starts: np.ndarray, many: np.ndarray, again: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which words of the block a window covers that starts earlier in the corpus."""
    text = as_characters(w.words, w.bounds)
    docs = w.doc_of(starts)
    places = starts + docs  # in text, where each document has one more character
    change = np.zeros(len(text) + WINDOW + 1, np.int64)
    away = places[again & ~first]
    np.add.at(change, away, 1)
    np.add.at(change, away + WINDOW, -1)
    stays = np.zeros(len(text) + 1, bool)
    stays[places[first]] = True
    begin = w.bounds[:-1] + np.arange(len(w.each))  # of each document in text
    wanted = np.sort(places[again & (many | ~first)])
    for a, b, shift in Passages(text, wanted).occurrences():
        one, two = np.searchsorted(begin, (a, a - shift), "right") - 1
        if w.keys[one] == w.keys[two] and a - begin[one] == a - shift - begin[two]:  # the same place of a repeated row
            at = np.arange(a, b - WINDOW + 1)
            at = at[~stays[at - shift]]
            np.add.at(change, at, 1)
            np.add.at(change, at + WINDOW, -1)
        else:
            change[a] += 1
            change[b] -= 1
    mask = np.cumsum(change)[: len(text)] > 0
    return np.delete(mask, w.bounds[1:] + np.arange(len(w.each)))


def cut(block: int, data: bytes, answers: dict[int, tuple[int, bytes]], notes: pd.DataFrame) -> pd.DataFrame:
    w = Words(data)
    starts, many = np.split(B.unpress(notes.data.iloc[0], np.int64), 2)
    again, first = [np.zeros(0, bool)], [np.zeros(0, bool)]
    for s in sorted(answers):  # shards are ranges, so this is the order in which the windows were sent
        n, bits = answers[s]
        both = np.unpackbits(np.frombuffer(B.unpress(bits), np.uint8), count=2 * n).astype(bool)
        again.append(both[:n])
        first.append(both[n:])
    gone = covered(w, starts, many.astype(bool), np.concatenate(again), np.concatenate(first))
    kept, removed = [], []
    for words, mask in zip(w.each, np.split(gone, w.bounds[1:-1]), strict=True):
        removed.append(int(mask.sum()))
        kept.append((b" ".join(words) if not removed[-1] else b" ".join(x for x, m in zip(words, mask.tolist(), strict=True) if not m)).decode("utf-8", "surrogatepass"))
    return pd.DataFrame({"doc_id": pd.array(w.ids, "Int64"), "n_words": np.diff(w.bounds), "n_removed": removed, "kept": kept})


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space) of each row of docs."""
    shards = B.shard_count(docs)
    rows = B.blocks_of(docs, propose(shards))
    texts = B.payloads(rows)
    candidates = B.stored(B.per_block(texts.unionByName(B.per_shard(B.parts(rows), recurring)), confirm(shards), B.PARTS), "windows")
    B.drop_parts(rows)
    answers = B.parts(B.stored(B.per_shard(B.parts(candidates), first_places), "places"))
    B.drop_parts(candidates)
    return B.per_block(texts.unionByName(answers).unionByName(B.notes(candidates)), cut, RESULT)


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
