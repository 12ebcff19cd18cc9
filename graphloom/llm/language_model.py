"""Language-model scores by logistic context mixing.

A text is coded as words, each word as its bytes and an end sign, each byte as eight binary decisions.  Several
predictors guess every bit from hashed contexts: the last one, two and three bytes of the running text (those of the
previous word too), the word so far, and the word so far with the kind of sign the previous word ended with.  Their
counters hold all training text of the corpus: what the first two bytes of a word see of the previous one is counted
and scored by (its last two bytes, these bytes), the rest by (kind, word), which gives the sums of the running text.
The logistic mixer adds the predictions in the logit domain with weights that a gate selects (how often the word
so far was seen, and the place in the word), and an adaptive probability map refines the sum; mixer and map are
learnt online, step after step, from every bit of all training texts: each distinct (kind, word) of the corpus weighs
as often as it occurs, each token left out of its own counts; groups of words are learnt apart, then joined by curvature.

A second mixer joins four predictors of the whole word: its spelling by the bits, its corpus count, its corpus count after
the previous word, and a word cache of the text so far, which starts empty.  Its weights are a softmax that a gate selects
(how often the previous word was seen, and how long the text has been); they are updated online, after every word of the
text that is coded, by the gradient of the word's cost, and every text starts from the weights that all training texts of
the block have taught, each word left out of its own counts.  A predictor that knows nothing (a previous word
that was never seen, an empty cache) takes no part, so all words together have probability 1.  The sum over all words,
divided by the bytes, gives bits per byte.

Counts of words and of word pairs grow with the corpus and stay distributed: blocks of documents exchange them with
hash shards (blocks.py); pairs go as 48-bit hashes.  The counters are tables of fixed size (2**16 to 2**20 slots), summed piece by piece.

Defined cases: null and empty texts are one end token; a null doc_id counts as empty text when folds are dealt;
words over 64 bytes are coded in pieces; without training texts all counts are 0; rows are scored one by one,
whatever repeats; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import pickle
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import blocks as B
from graphloom.llm.common import fold, mix, table, word_hashes

FOLDS, BLOCK_BYTES, PIECE = 10, 12 << 20, 64
FIRST_WORDS, FIRST_SHARE, STEP_WORDS = 200, 1 / 256, 50_000  # distinct words of a mixer's first step (at least; as a share); of any step at most
RIDGE, MOST_STEP = 50.0, 0.5  # bounds what little evidence moves, and what one step moves
SIZES = (16, 18, 20, 20, 18)  # log2 of each context's slots
OFFSETS = np.r_[0, np.cumsum([1 << s for s in SIZES])].astype(np.int64)
CHUNK = 1 << 17  # counters in a piece
RESULT = "doc_id long, n_tokens long, n_known long, base_score double, score double, bits_per_byte double"
KINDS = 4  # text start; the previous word ended with a full stop or the like; with a letter; else
_KIND = np.full(256, 3, np.int64)
_KIND[[*b"abcdefghijklmnopqrstuvwxyz", *range(128, 256)]] = 2
_KIND[[*b".!?"]] = 1
START = 1 << 16  # instead of the last two bytes of a previous word
EXPERTS, GATES, WORD_RATE, TEACH, ROUNDS = 4, 12, 0.25, 64, 2  # TEACH: one in so many of a block's training texts gives the weights from which all of them teach the second mixer
PIECE_TOKENS = 1 << 18  # that the second mixer takes side by side
SURE = np.log([0.15, 0.05, 0.6, 0.2])  # its weights before anything is learnt: spelling, count, count after the previous word, cache


def trained_on(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS != 0


def tokens(text: str | None) -> list[bytes]:
    """Words with A-Z lowered, and the end token, which is empty."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), b""]


def laid_out(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, a blank before and after each word; where each word begins, and its length."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    return np.frombuffer(b" ".join([b"", *words, b""]), np.uint8), np.cumsum(size + 1) - size, size


def tails(words: list[bytes]) -> np.ndarray:
    """The last two bytes of each word, with the blank before it where it is shorter."""
    raw, begin, size = laid_out(words)
    last = raw[begin + size - 1].astype(np.int64)
    return np.where(size > 0, raw[np.maximum(begin + size - 2, 0)].astype(np.int64) << 8 | last, START)


def before(words: list[bytes]) -> np.ndarray:
    """The tail that each token of a text follows."""
    return np.r_[START, tails(words[:-1])]


def kind_of(tail: np.ndarray) -> np.ndarray:
    return np.where(tail == START, 0, _KIND[tail & 255])


def leads(words: list[bytes]) -> np.ndarray:
    """The first two bytes of each word and its end sign; 256 where there is one only."""
    raw, begin, size = laid_out(words)
    return raw[begin].astype(np.int64) << 9 | np.where(size > 0, raw[np.minimum(begin + 1, len(raw) - 1)].astype(np.int64), 256)


def unpacked_leads(keys: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Bytes, and the tail before them, of tail << 17 | lead."""
    return [bytes([k >> 9 & 255]) if k & 511 == 256 else bytes([k >> 9 & 255, k & 255]) for k in keys.tolist()], keys >> 17


class Bits:
    """All binary decisions of (kind, word) pairs, bit position by bit position, with their counters' slots.

    tail: what the word follows, else its history is empty.  part: "lead" takes words as they are, without an end
    sign; "rest" leaves out the first two bytes.  once: words that begin alike have the same decisions in the same
    contexts up to where they part, so that each beginning comes once, as a row that stands for all words that have it
    (summed, spread)."""

    def __init__(self, words: list[bytes], kind: np.ndarray, tail: np.ndarray | None = None, part: str = "all", once: bool = False):
        end = b"" if part == "lead" else b" "
        rows, owner, first = [w + end for w in words], np.arange(len(words)), kind.astype(np.uint64)
        past = np.zeros((len(words), 3), np.uint64)
        if tail is not None:
            there = np.flatnonzero(tail != START)
            past[there] = np.stack([tail[there] >> 8, tail[there] & 255, np.full(len(there), 32)], 1)
        elif part == "rest":
            past[:, 2] = np.where(kind != 0, 32, 0)  # the third byte sees the blank
        size = np.fromiter(map(len, rows), np.int64, len(rows))
        if len(long := np.flatnonzero(size > PIECE)):
            cut = [(i, rows[i][q : q + PIECE], list(rows[i][q - 3 : q])) for i in long.tolist() for q in range(PIECE, len(rows[i]), PIECE)]
            for i in long.tolist():
                rows[i] = rows[i][:PIECE]
            rows += [r for _, r, _ in cut]
            owner, first = np.r_[owner, [i for i, *_ in cut]], np.r_[first, np.full(len(cut), KINDS, np.uint64)]
            past = np.concatenate([past, np.array([h for *_, h in cut], np.uint64)])
            size = np.fromiter(map(len, rows), np.int64, len(rows))
        width = int(size.max()) if len(rows) else 0
        spelt = np.zeros((len(rows), max(width, 8)), np.uint8)
        spelt[np.arange(spelt.shape[1]) < size[:, None]] = np.frombuffer(b"".join(rows), np.uint8)
        same = np.zeros(len(rows), np.int64)  # bytes that a row has in common with the row before
        if once and len(rows):
            history = first << np.uint64(24) | past[:, 0] << np.uint64(16) | past[:, 1] << np.uint64(8) | past[:, 2]
            order = np.lexsort((spelt[:, :8].copy().view(">u8")[:, 0].astype(np.uint64), history))
            spelt, size, history = spelt[order], size[order], history[order]
            other = np.column_stack([spelt[1:] != spelt[:-1], np.ones(len(rows) - 1, bool)]).argmax(1)
            same[1:] = np.where(history[1:] == history[:-1], np.minimum(other, np.minimum(size[1:], size[:-1])), 0)
            owner, first, past = owner[order], first[order], past[order]
        self.size, self.owner, self.kind, self.past, self.same = size, owner, first, past, same
        self.bytes = np.ascontiguousarray(spelt.T[:width])  # byte position, row
        self.skip = 2 if part == "rest" else 0

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray], int, np.ndarray]]:
        """rows, bit, slots of each context, byte position, partial byte."""
        three, two, one = self.past.T
        prefix = np.where(self.kind == KINDS, np.uint64(77), np.uint64(5))
        here = np.arange(len(self.size))
        for j in range(len(self.bytes)):
            if not (stay := self.size[here] > j).all():
                here, one, two, three, prefix = (x[stay] for x in (here, one, two, three, prefix))
            symbol = self.bytes[j].take(here).astype(np.uint64)
            new = self.same.take(here) <= j
            if j < self.skip:
                coded = self.kind[here] == KINDS
                new &= coded
                self.all = here[coded]
                self.first = np.flatnonzero(new[coded])
            else:
                self.all, self.first = here, np.flatnonzero(new)
            if len(self.first):
                at = np.flatnonzero(new)
                yield from self._byte(here[at], j, symbol[at], one[at], two[at], three[at], prefix[at])
            with np.errstate(over="ignore"):
                prefix = (prefix ^ symbol + np.uint64(1)) * np.uint64(0x100000001B3)
                prefix = prefix ^ prefix >> np.uint64(29)
            one, two, three = symbol, one, two

    def summed(self, weight: np.ndarray) -> np.ndarray:
        """The weight of all words that each of the rows stands for."""
        return np.add.reduceat(weight[self.owner[self.all]], self.first)

    def spread(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All that the rows stand for, and the value of each."""
        return self.all, np.repeat(values, np.diff(np.r_[self.first, len(self.all)]))

    def _byte(self, rows, j: int, symbol, one, two, three, prefix):
        with np.errstate(over="ignore"):
            seeds = [
                one << np.uint64(8),
                ((one << np.uint64(8) | two) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15),
                ((one << np.uint64(16) | two << np.uint64(8) | three) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93),
                prefix * np.uint64(0xC2B2AE3D27D4EB4F),
                (prefix + (self.kind[rows] + np.uint64(1)) * np.uint64(0x165667B19E3779F9)) * np.uint64(0x27D4EB2F165667C5),
            ]
            node = np.ones(len(symbol), np.uint64)
            for k in range(7, -1, -1):
                bit = symbol >> np.uint64(k) & np.uint64(1)
                slots = [(seeds[0] | node).view(np.int64)]
                spread = node * np.uint64(0x9FB21C651E98DF25)
                for s, bits, offset in zip(seeds[1:], SIZES[1:], OFFSETS[1:], strict=False):
                    key = s ^ spread
                    key *= np.uint64(0xFF51AFD7ED558CCD)
                    key >>= np.uint64(64 - bits)
                    key += np.uint64(offset)
                    slots.append(key.view(np.int64))
                yield rows, bit, slots, j, node
                node = node << np.uint64(1) | bit


Heads = tuple[np.ndarray, np.ndarray]  # keys (tail << 17 | lead), and how often each starts a word


def count_contexts(words: list[bytes], counts: np.ndarray, heads: Heads | None = None, out: np.ndarray | None = None) -> np.ndarray:
    """Counters (slot, bit) of words that occur counts[word, kind] times, added to out.

    heads: what starts the words; else words have an empty history."""
    out = np.zeros((OFFSETS[-1], 2)) if out is None else out
    flat = out.reshape(-1)

    def add(bits: Bits, weight: np.ndarray) -> None:
        for _, bit, slots, _, node in bits:
            if node[0] == 1:
                w = bits.summed(weight)
            one = bit.astype(np.int64)
            for s in slots:
                np.add.at(flat, s << 1 | one, w)

    at, kind = np.nonzero(counts)
    weight = counts[at, kind].astype(np.float64)
    for lo in range(0, len(at), 100_000):
        hi = lo + 100_000
        add(Bits([words[i] for i in at[lo:hi]], kind[lo:hi], part="all" if heads is None else "rest", once=True), weight[lo:hi])
    if heads is not None:
        for lo in range(0, len(heads[0]), 100_000):
            texts, tail = unpacked_leads(heads[0][lo : lo + 100_000])
            add(Bits(texts, kind_of(tail), tail, "lead", once=True), heads[1][lo : lo + 100_000].astype(np.float64))
    return out


def gate(seen: np.ndarray, position: int) -> np.ndarray:
    return np.minimum(np.log2(1 + seen).astype(np.int64), 7) * 3 + min(position, 2)


@dataclass
class Mixer:
    weights: np.ndarray  # gate, context (and one for the bias)
    refined: np.ndarray  # partial byte, bucket of the logit
    logits: np.ndarray  # of each slot
    gates: np.ndarray  # of each slot of the fourth context, at position 0

    @staticmethod
    def spread(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pos = (np.clip(x, -11.99, 11.99) + 12) * (32 / 24)
        low = pos.astype(np.int64)
        return low, pos - low.astype(pos.dtype)

    def probability(self, st: list[np.ndarray], g: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of a 1 bit; and the mixed logit."""
        w = np.ascontiguousarray(self.weights.T, np.float32)
        x = w[-1].take(g)
        for i, s in enumerate(st):
            part = w[i].take(g)
            part *= s
            x += part
        np.clip(x, -14, 14, out=x)
        low, part = self.spread(x)
        table, at = self.refined.reshape(-1).astype(np.float32), node.astype(np.int64) * 33 + low
        y = table[at] * (1 - part) + table[at + 1] * part
        return (1 / (1 + np.exp(-x)) + 1 / (1 + np.exp(-y))) / 2, x

    def word_log10(self, words: list[bytes], kind: np.ndarray, tail: np.ndarray | None = None, part: str = "all") -> np.ndarray:
        """log10 of the probability of each (kind, word), or of the part of it that Bits takes."""
        total = np.zeros(len(words))
        alike = np.lexsort((np.array(words, "S8"), kind)) if len(words) else np.zeros(0, np.int64)  # words that begin alike come together
        for lo in range(0, len(words), 50_000):
            some = alike[lo : lo + 50_000]
            bits = Bits([words[i] for i in some.tolist()], kind[some], None if tail is None else tail[some], part, once=True)
            piece = np.zeros(len(bits.size))
            for _, bit, slots, j, node in bits:
                p, _ = self.probability([self.logits.take(s) for s in slots], self.gates.take(slots[3] - OFFSETS[3]) + min(j, 2), node)
                p = np.maximum(np.where(bit == 1, p, 1 - p), 1e-7)
                byte = p if node[0] == 1 else byte * p
                if node[0] >= 128:
                    rows, logs = bits.spread(np.log10(byte))
                    piece[rows] += logs
            np.add.at(total, some[bits.owner], piece)
        return total


PRIOR = 0.4


def started(counters: np.ndarray) -> Mixer:
    """A mixer that has learnt nothing yet."""
    logits = np.log((counters[:, 1] + PRIOR) / (counters[:, 0] + PRIOR)).astype(np.float32)
    seen = counters[OFFSETS[3] : OFFSETS[4]].sum(1)
    mixer = Mixer(np.full((24, len(SIZES) + 1), 0.3), np.tile(np.linspace(-12, 12, 33), (256, 1)), logits, gate(seen, 0).astype(np.int8))
    mixer.weights[:, -1] = 0
    return mixer


@dataclass
class Learnt:
    """What has moved a mixer: its weights and the curvature (gate, input, input) behind them, its map and the curvature of each entry."""

    weights: np.ndarray
    bend: np.ndarray
    refined: np.ndarray
    mass: np.ndarray


Vocabulary = tuple[list[bytes], np.ndarray, Heads | None]  # words, counts (word, kind), what starts the words


def sample_size(n: int) -> int:
    """Of n distinct words, those that are learnt before the weights move for the first time; each step takes twice as many as the one before."""
    return max(FIRST_WORDS, int(n * FIRST_SHARE))


def fit(mixer: Mixer, counters: np.ndarray, vocabulary: Iterable[Vocabulary]) -> Learnt:
    """Mixer and map, learnt from every bit of every word as often as the word occurs, and each time left out of the counts
    that predict it.

    All occurrences of a (kind, word) have the same bits in the same contexts, so they are one row with a weight.  After
    each step the weights move by the step's gradient over all curvature so far (stochastic Newton), so that a word
    that is met early or late counts the same."""
    n0, n1 = counters[:, 0], counters[:, 1]
    less = np.stack([(n1 + PRIOR) / (np.maximum(n0 - 1, 0) + PRIOR), (np.maximum(n1 - 1, 0) + PRIOR) / (n0 + PRIOR)], 1)
    logits = np.log(less, out=less).astype(np.float32).reshape(-1)  # of slot * 2 + the bit that is left out
    seen = gate(np.maximum((n0 + n1)[OFFSETS[3] : OFFSETS[4]] - 1, 0), 0).astype(np.int8)
    del less, n0, n1
    inputs, entries = len(SIZES) + 1, mixer.refined.size
    weights, refined = mixer.weights.copy(), mixer.refined.reshape(-1).copy()
    bend, mass = np.zeros((len(weights), inputs, inputs)), np.zeros(entries)

    def steps(words: list[bytes], counts: np.ndarray, heads: Heads | None) -> Iterator[list[tuple[Bits, np.ndarray]]]:
        nonlocal size
        at, kind = np.nonzero(counts)
        times = counts[at, kind]
        size = size or sample_size(len(at))
        lo, h = 0, 0
        while lo < len(at):
            hi = min(lo + size, len(at))
            parts = [(Bits([words[i] for i in at[lo:hi]], kind[lo:hi], part="all" if heads is None else "rest", once=True), times[lo:hi])]
            if heads is not None:
                last, h = h, len(heads[0]) * hi // len(at)
                texts, tail = unpacked_leads(heads[0][last:h])
                parts.append((Bits(texts, kind_of(tail), tail, "lead", once=True), heads[1][last:h]))
            yield parts
            lo, size = hi, min(size * 2, STEP_WORDS)

    size = 0
    for parts in (x for v in vocabulary for x in steps(*v)):
        slope, more = np.zeros((len(weights), inputs)), np.zeros_like(bend)
        pull, grown = np.zeros(entries + 1), np.zeros(entries + 1)
        held, map_ = np.ascontiguousarray(weights.T, np.float32), refined.astype(np.float32)
        for bits, times in parts:
            for _, bit, slots, j, node in bits:
                if (k := int(node[0]).bit_length() - 1) == 0:  # a new byte: its eight bits are learnt together
                    n = len(node)
                    st, g, b, key = np.ones((inputs, 8, n), np.float32), np.empty((8, n), np.int8), np.empty((8, n), np.float32), np.empty((8, n), np.int64)
                one = bit.astype(np.int64)
                for i, s in enumerate(slots):
                    logits.take(s << 1 | one, out=st[i, k], mode="clip")
                seen.take(slots[3] - OFFSETS[3], out=g[k], mode="clip")
                b[k] = bit
                key[k] = node
                if k < 7:
                    continue
                g += min(j, 2)
                order = np.argsort(g.reshape(-1), kind="stable")
                ends = np.r_[0, np.cumsum(np.bincount(g.reshape(-1), minlength=len(weights)))].tolist()
                st = st.reshape(inputs, -1)[:, order]
                b, key, w = b.reshape(-1)[order], key.reshape(-1)[order], np.tile(bits.summed(times).astype(np.float32), 8)[order]
                x = np.empty(len(b), np.float32)
                used = [(v, slice(lo, hi)) for v, (lo, hi) in enumerate(zip(ends, ends[1:])) if hi > lo]
                for v, at in used:
                    np.matmul(held[:, v], st[:, at], out=x[at])
                np.clip(x, -14, 14, out=x)
                p = 1 / (1 + np.exp(-x))
                e, c = (b - p) * w, p * (1 - p) * w
                for v, at in used:
                    own = st[:, at]
                    slope[v] += own @ e[at]
                    more[v] += (own * c[at]) @ own.T
                low, part = mixer.spread(x)
                key *= 33
                key += low
                y = map_.take(key)
                q = 1 / (1 + np.exp(-(y + (map_.take(key + 1) - y) * part)))
                e, c = (b - q) * w, np.maximum(q * (1 - q), np.float32(0.01)) * w
                for to, what in ((pull, e), (grown, c)):
                    upper = what * part
                    to += np.bincount(key, what - upper, entries + 1)
                    to[1:] += np.bincount(key, upper, entries)
        bend += more
        mass += grown[:entries]
        weights += np.clip(np.linalg.solve(bend + RIDGE * np.eye(inputs), slope[..., None])[..., 0], -MOST_STEP, MOST_STEP)
        refined += np.clip(pull[:entries] / (mass + RIDGE), -MOST_STEP, MOST_STEP)
    return Learnt(weights, bend, refined.reshape(mixer.refined.shape), mass.reshape(mixer.refined.shape))


def averaged(mixer: Mixer, pieces: list[Learnt]) -> Mixer:
    """The mixer with what pieces of the vocabulary have learnt, each by its curvature."""
    if pieces:
        ridge = 1e-6 * np.eye(mixer.weights.shape[1])
        pulled = sum((x.bend + ridge) @ x.weights[..., None] for x in pieces)
        mixer.weights = np.linalg.solve(sum(x.bend + ridge for x in pieces), pulled)[..., 0]
        mass = sum(x.mass for x in pieces)
        mixer.refined = np.where(mass > 0, sum(x.refined * x.mass for x in pieces) / np.maximum(mass, 1e-9), mixer.refined)
    return mixer


def learn(counters: np.ndarray, texts: list[list[bytes]], n_train: int) -> Mixer:
    """The mixer that some texts teach."""
    counted: dict[bytes, np.ndarray] = {}
    for t in texts:
        for w, k in zip(t, kind_of(before(t)).tolist(), strict=True):
            counted.setdefault(w, np.zeros(KINDS, np.int64))[k] += 1
    mixer = started(counters)
    return averaged(mixer, [fit(mixer, counters, [(list(counted), np.array(list(counted.values())).reshape(-1, KINDS), None)])])


def learnt(vocabulary: DataFrame, table_: np.ndarray, groups: int) -> Mixer:
    """The mixer, learnt from all training words: every group learns from its own, then what they learnt is joined."""
    held = vocabulary.sparkSession.sparkContext.broadcast(table_.astype(np.float32))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["block", "size"])
        words = ((w, c, (heads, n_heads)) for n, d in zip(pdf["size"], pdf.data, strict=True) for c, w, heads, n_heads, *_ in [sent(n, d)])
        found = fit(started(held.value), held.value, words)
        return pd.DataFrame({"group": pdf.group[:1], "data": [pickle.dumps(found)]})

    found = grouped(vocabulary, groups).groupBy("group").applyInPandas(one, "group long, data binary").collect()
    held.unpersist()
    return averaged(started(table_), [pickle.loads(bytes(r["data"])) for r in sorted(found, key=lambda r: r["group"])])


def follows(at: np.ndarray, starts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """48-bit hash of (previous word, word) of each token."""
    with np.errstate(over="ignore"):
        key = hashes[at] * np.uint64(0x9E3779B97F4A7C15)
        key[1:] += hashes[at[:-1]]
        key[starts] = hashes[at[starts]] * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)
    for p in pieces_of(len(key)):
        key[p] = mix(key[p]) >> np.uint64(16)
    return key


def pieces_of(n: int) -> Iterator[slice]:
    """Tokens piece by piece, so that what is computed of them and not kept takes little memory."""
    for lo in range(0, n, PIECE_TOKENS):
        yield slice(lo, min(lo + PIECE_TOKENS, n))


def distinct(keys: np.ndarray) -> np.ndarray:
    """The sorted distinct keys."""
    keys = np.sort(keys)
    return keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys


def by_rank(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each key the value at its place among the sorted distinct keys."""
    order = np.argsort(keys)
    out = np.empty(len(keys), values.dtype)
    rank, last = -1, None
    for p in pieces_of(len(keys)):
        some = keys[order[p]]
        ranks = rank + np.cumsum(np.r_[some[0] != last, some[1:] != some[:-1]])
        out[order[p]] = values[ranks]
        rank, last = ranks[-1], some[-1]
    return out


def word_gates(had: np.ndarray, age: np.ndarray) -> np.ndarray:
    """The gate of each word, by what is known before it: how often the previous word was seen, and how long the text has been."""
    return np.searchsorted([1, 10, 100], had, "right") * 3 + np.searchsorted([20, 200], age, "right")


def word_mix(experts: np.ndarray, there: np.ndarray, gates: np.ndarray, starts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probability of each word of some texts, side by side and word after word; what their weights were in the end, summed
    over the texts that used a gate, and the number of these.

    experts, there: (word, expert).  starts: of the texts, and the end.  first: (gate, expert), the weights that all start from."""
    length = np.diff(starts)
    texts, order = len(length), np.argsort(-length, kind="stable")
    begin = starts[:-1][order]
    lane = np.empty(texts, np.int64)
    lane[order] = np.arange(texts)
    own = np.repeat(lane * GATES, length) + gates  # where each word's weights are
    length = length[order]
    held = np.repeat(first.T.astype(experts.dtype)[:, None], texts, 1).reshape(-1)  # expert, text, gate
    out = np.empty(len(experts), experts.dtype)
    side = np.searchsorted(-length, -np.arange(length[0] if texts else 0), "left")  # texts that have a word at each step
    t = 0
    while t < len(side):
        steps = np.arange(t, min(t + max(1, PIECE_TOKENS // side[t]), len(side)))[:, None]
        at = (begin[: side[t]] + steps)[length[: side[t]] > steps]  # step after step, texts side by side
        x, know = experts.T.take(at, 1), there.T.take(at, 1).astype(experts.dtype)
        here = own[at] + (np.arange(EXPERTS) * (texts * GATES))[:, None]
        sums = np.empty((2, len(at)), experts.dtype)  # of the weights as they are, and with the predictors
        hi = 0
        for m in side[t : t + len(steps)].tolist():
            lo, hi = hi, hi + m
            place = here[:, lo:hi]
            z = held.take(place)
            parts = np.empty((2, EXPERTS, m), z.dtype)
            w, part = parts
            np.multiply(np.exp(z), know[:, lo:hi], w)
            np.multiply(w, x[:, lo:hi], part)
            parts *= (WORD_RATE / np.add.reduce(parts, 1, None, sums[:, lo:hi]))[:, None]
            part -= w
            z += part
            held[place] = np.minimum(np.maximum(z, -8, z), 8, z)
        out[at] = sums[1] / sums[0]
        t += len(steps)
    used = np.zeros(texts * GATES, bool)
    used[own] = True
    mask = used.reshape(texts, GATES)
    return out, np.einsum("kng,ng->gk", held.reshape(EXPERTS, texts, GATES), mask), mask.sum(0)


def taught(experts: np.ndarray, there: np.ndarray, gates: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The weights that texts teach, round by round from the mean of what they ended with; a gate that few used stays near SURE."""
    first = np.tile(SURE, (GATES, 1))
    for _ in range(ROUNDS if len(starts) > 1 else 0):
        _, total, n = word_mix(experts, there, gates, starts, first)
        first = (total + 5 * first) / (n + 5)[:, None]
    return first


def side_by_side(texts: np.ndarray, length: np.ndarray) -> Iterator[np.ndarray]:
    """Texts in pieces of about PIECE_TOKENS, those of like length together."""
    texts = texts[np.argsort(-length[texts], kind="stable")]
    piece = np.cumsum(length[texts]) // PIECE_TOKENS
    yield from np.split(texts, np.flatnonzero(np.diff(piece)) + 1) if len(texts) else ()


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted 48-bit keys as steps, byte by byte, so that their upper bytes are mostly 0."""
    return np.ascontiguousarray(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes()


def unpacked_keys(data: memoryview, n: int) -> np.ndarray:
    steps = np.zeros((n, 8), np.uint8)
    steps[:, :6] = np.frombuffer(data, np.uint8, 6 * n).reshape(6, n).T
    return np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64)


def past_tails(words: list[bytes], at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The tail that each token follows."""
    out = np.empty(len(at), np.int32)
    out[1:] = tails(words).astype(np.int32)[at[:-1]]
    out[starts] = START
    return out.astype(np.int64)


def numbering() -> defaultdict[bytes, int]:
    """A number for each word that is looked up, in the order in which they come."""
    known: defaultdict[bytes, int] = defaultdict()
    known.default_factory = known.__len__
    return known


def numbered(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes], list[int]]:
    """The number of each token of the texts (as tokens() has them), tokens of each text, what is numbered, and bytes of each text."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    # Of a text that begins with a word and ends with a blank, the split has the words and an empty end.
    ready = pa.array([t + b" " if t else t for t in (t.lower().strip() for t in raw)], pa.large_binary()).view(pa.large_string())
    split = pc.ascii_split_whitespace(ready)
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.view(pa.large_binary()).to_pylist()
    return coded.indices.to_numpy(), pc.list_value_length(split).to_numpy().astype(np.int64), words, list(map(len, raw))


def propose(shards: int):
    def make(block: int, ids: list, texts: list) -> Iterable[B.Part]:
        at, lengths, words, sizes = numbered(texts)
        hashes = word_hashes(words)
        order = np.argsort(hashes, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        words, hashes = [words[i] for i in order], hashes[order]
        at, ends = rank[at], np.cumsum(lengths)
        starts = np.r_[0, ends[:-1]]
        train = np.repeat([trained_on(i) for i in ids], lengths)
        tail, lead = past_tails(words, at, starts), leads(words)
        counts = np.zeros(len(words) * KINDS, np.int64)
        for p in pieces_of(len(at)):
            counts += np.bincount((at[p].astype(np.int64) * KINDS + kind_of(tail[p]))[train[p]], minlength=len(counts))
        counts = counts.reshape(-1, KINDS)
        heads, n_heads = np.unique((tail << 17 | lead[at])[train], return_counts=True)
        del tail
        keys = follows(at, starts, hashes)
        pairs = distinct(keys)
        n_pairs = np.zeros(len(pairs), np.int32)
        keys, n_keys = np.unique(keys[train], return_counts=True)
        n_pairs[np.searchsorted(pairs, keys)] = n_keys
        del keys, n_keys
        head = np.array([len(ids), len(at)], np.int64).tobytes()
        null = np.array([i is None for i in ids])
        key = np.array([0 if i is None else i for i in ids], np.int64)
        packed = b"".join([head, key.tobytes(), null.tobytes(), ends.astype(np.int64).tobytes(), np.array(sizes, np.int64).tobytes(), at.tobytes(), b"\n".join(words)])
        yield block, B.PAYLOAD, len(ids), B.press(packed)
        spread = mix(heads.astype(np.uint64))
        order = np.argsort(spread)
        heads, n_heads = heads[order], n_heads[order]
        none = slice(0, 0)
        spans = [dict(B.by_shard(x, shards)) for x in (hashes, pairs << np.uint64(16), spread[order])]
        for s in sorted(set().union(*spans)):
            a, b, c = (x.get(s, none) for x in spans)
            sizes_ = np.array([len(pairs[b]), len(heads[c])], np.int64)
            data = (sizes_, counts[a].astype(np.int64), heads[c], n_heads[c].astype(np.int64), n_pairs[b])
            yield block, s, len(words[a]), B.press(b"".join([*(x.tobytes() for x in data), packed_keys(pairs[b]), b"\n".join(words[a])]))

    return make


def sent(n: int, data: bytes) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts and words, keys and counts of heads, keys and counts of pairs."""
    raw, spot = memoryview(B.unpress(data)), 16
    m, k = np.frombuffer(raw, np.int64, 2).tolist()
    out = []
    for kind, size in ((np.int64, n * KINDS), (np.int64, k), (np.int64, k), (np.int32, m)):
        out.append(np.frombuffer(raw, kind, size, offset=spot))
        spot += out[-1].nbytes
    counts, heads, n_heads, n_pairs = out
    pairs = unpacked_keys(raw[spot : spot + 6 * m], m)
    return counts.reshape(n, KINDS), bytes(raw[spot + 6 * m :]).split(b"\n") if n else [], heads, n_heads, pairs, n_pairs


def total(shard: int, pdf: pd.DataFrame) -> Iterable[B.Part]:
    """Each block gets the corpus counts of its words and pairs; a note holds the shard's words and heads (block: the
    words' sum, size: their number)."""
    known = numbering()
    places, counts, heads, pairs = [], [], [], []
    for n, data in zip(pdf["size"], pdf.data, strict=True):
        c, words, *more = sent(n, data)
        places.append(np.fromiter(map(known.__getitem__, words), np.int64, n))
        counts.append(c)
        heads.append(more[:2])
        pairs.append(more[2:])
    sums = np.zeros((len(known), KINDS), np.int64)
    for at, c in zip(places, counts, strict=True):
        sums[at] += c  # the words of a block are distinct
    each = sums.sum(1)
    _, back = np.unique(np.concatenate([k for k, _ in pairs]), return_inverse=True)
    together = np.bincount(back, np.concatenate([c for _, c in pairs])).astype(np.int64)[back]
    lo = 0
    for block, at, (keys, _) in zip(pdf.block, places, pairs, strict=True):
        yield block, shard, len(at), B.press(each[at].tobytes() + together[lo : lo + len(keys)].tobytes())
        lo += len(keys)
    used = np.flatnonzero(each)
    words = list(known)
    keys, back = np.unique(np.concatenate([k for k, _ in heads]), return_inverse=True)
    n_heads = np.bincount(back, np.concatenate([c for _, c in heads]), len(keys)).astype(np.int64)
    note = (np.array([0, len(keys)], np.int64), sums[used], keys, n_heads)
    yield int(each.sum()), B.NOTE, len(used), B.press(b"".join([*(x.tobytes() for x in note), b"\n".join(words[i] for i in used)]))


def grouped(vocabulary: DataFrame, groups: int) -> DataFrame:
    return vocabulary.withColumn("group", F.pmod(F.xxhash64("block", "size"), F.lit(groups)))


def counters(vocabulary: DataFrame, groups: int) -> np.ndarray:
    """The counters of all words: every group counts its words, then pieces of the tables are summed."""

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        sums = np.zeros((OFFSETS[-1], 2))
        for n, data in zip(pdf["size"], pdf.data, strict=True):
            c, words, heads, n_heads, *_ = sent(n, data)
            count_contexts(words, c, (heads, n_heads), sums)
        rows = [(k, B.press(sums[lo : lo + CHUNK])) for k, lo in enumerate(range(0, len(sums), CHUNK))]
        return pd.DataFrame(rows, columns=["piece", "data"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"piece": pdf.piece[:1], "data": [B.press(sum(B.unpress(d, np.float64) for d in pdf.data).astype(np.float32))]})

    counted = grouped(vocabulary, groups).groupBy("group").applyInPandas(count, "piece int, data binary")
    pieces = counted.groupBy("piece").applyInPandas(add, "piece int, data binary").collect()
    out = np.zeros((OFFSETS[-1], 2), np.float32)
    for r in pieces:
        own = B.unpress(bytes(r["data"]), np.float32).reshape(-1, 2)
        out[r["piece"] * CHUNK : r["piece"] * CHUNK + len(own)] = own
    return out.astype(np.float64)


def finished(data: bytes, answers: dict[int, tuple[int, bytes]], mixer: Mixer, n_train: int, n_words: int) -> pd.DataFrame:
    """RESULT of the documents of a block, from its payload and the answers of the shards."""
    raw = B.unpress(data)
    n_docs, n = np.frombuffer(raw, np.int64, 2).tolist()
    spot = 16

    def take(kind, size: int) -> np.ndarray:
        nonlocal spot
        out = np.frombuffer(raw, kind, size, offset=spot)
        spot += out.nbytes
        return out

    key, null, ends, sizes, at = take(np.int64, n_docs), take(bool, n_docs), take(np.int64, n_docs), take(np.int64, n_docs), take(np.int32, n)
    words = raw[spot:].split(b"\n")
    count, together = [], []
    for s in sorted(answers):
        both = B.unpress(answers[s][1], np.int64)
        count.append(both[: answers[s][0]])
        together.append(both[answers[s][0] :])
    count, together = np.concatenate(count), np.concatenate(together)
    starts = np.r_[0, ends[:-1]]
    base = np.add.reduceat(np.log10((count + 0.1) / (n_train + 0.1 * (n_words + 1)))[at], starts)
    n_known = np.add.reduceat((count > 0)[at], starts, dtype=np.int64)
    tail, lead = past_tails(words, at, starts), leads(words)
    heads = distinct(tail << 17 | lead[at])
    texts, before_ = unpacked_leads(heads)
    spelt = mixer.word_log10(texts, kind_of(before_), before_, "lead")
    there = np.zeros(len(words) * KINDS, bool)
    for p in pieces_of(n):
        there[at[p].astype(np.int64) * KINDS + kind_of(tail[p])] = True
    pairs = np.flatnonzero(there)
    rest = np.zeros(len(there))
    rest[pairs] = mixer.word_log10([words[i] for i in pairs // KINDS], pairs % KINDS, part="rest")
    own = np.empty(n)
    for p in pieces_of(n):
        own[p] = spelt[np.searchsorted(heads, tail[p] << 17 | lead[at[p]])] + rest[at[p].astype(np.int64) * KINDS + kind_of(tail[p])]
    del tail, there, pairs, rest, texts, before_, heads, spelt
    # The word after the previous word; a text starts as often as one ends.
    pair = by_rank(follows(at, starts, word_hashes(words)), together)
    begun = count[words.index(b"")]
    del together
    # How often the text has had the word.
    before = np.empty(n, np.int32)
    cuts = starts[np.r_[True, np.diff(starts // PIECE_TOKENS) > 0]]
    doc = np.repeat(np.arange(n_docs, dtype=np.int32), ends - starts)
    for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), n], strict=True):
        where = (doc[lo:hi] - doc[lo]).astype(np.int64) * len(words) + at[lo:hi]
        bits = (hi - lo).bit_length()
        if int(where.max()).bit_length() + bits < 64:  # sorted with their places, which is faster
            where = np.sort(where << bits | np.arange(hi - lo))
            order, where = where & (1 << bits) - 1, where >> bits
        else:
            order = np.argsort(where, kind="stable")
            where = where[order]
        first = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
        before[lo:hi][order] = np.arange(hi - lo) - np.repeat(first, np.diff(np.r_[first, hi - lo]))
    del doc, where, order, first

    def known(docs: np.ndarray, less: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What word_mix takes of some texts, whose words are taken off their own counts `less` times: the predictors of each
        word over the largest, which of them know something, gates, starts; and the logarithm of the largest."""
        size = (ends - starts)[docs]
        begin = np.r_[0, np.cumsum(size)]
        age = np.arange(begin[-1]) - np.repeat(begin[:-1], size)
        some = age + np.repeat(starts[docs], size)
        had = count[at[some - 1]]
        had[begin[:-1]] = begun
        h = had - less
        there = np.stack([np.ones(len(h), bool), np.full(len(h), n_train > less), h > 0, age > 0])
        experts = np.empty(there.shape)
        experts[0] = np.maximum(10.0 ** own[some], 1e-300)
        experts[1] = np.maximum(count[at[some]] - less, 0) / max(n_train - less, 1)
        experts[2] = np.maximum(pair[some] - less, 0) / np.maximum(h, 1)
        experts[3] = before[some] / np.maximum(age, 1)
        experts *= there
        top = experts.max(0)
        experts /= top
        return experts.astype(np.float32).T, there.T, word_gates(had, age), begin, np.log10(top)

    length = ends - starts
    train = np.flatnonzero([not z and trained_on(int(k)) or z and trained_on(None) for k, z in zip(key, null)])
    some = train[mix(key[train].astype(np.uint64) + np.uint64(7)) % np.uint64(TEACH) == 0]
    weights = taught(*known(some, 1)[:4])  # what all training texts start from, to teach the weights that count
    total, used = 5 * weights, np.full(GATES, 5)
    for some in side_by_side(train, length):
        _, more, n_used = word_mix(*known(some, 1)[:4], weights)
        total, used = total + more, used + n_used
    weights = total / used[:, None]
    sums = np.empty(n_docs)
    for some in side_by_side(np.arange(n_docs), length):
        *told, begin, top = known(some, 0)
        logs = np.log10(np.maximum(word_mix(*told, begin, weights)[0], 1e-300)) + top
        sums[some] = np.add.reduceat(logs, begin[:-1])
    ids = pd.array(key, "Int64")
    ids[null] = pd.NA
    return pd.DataFrame(
        {"doc_id": ids, "n_tokens": ends - starts, "n_known": n_known, "base_score": base, "score": sums, "bits_per_byte": -sums * np.log2(10) / np.maximum(sizes, 1)}
    )


def score(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score, bits_per_byte, train_tokens of each row of docs."""
    spark = docs.sparkSession
    rows = B.blocks_of(docs, propose(B.shard_count(docs)), BLOCK_BYTES)
    answers = B.stored(B.per_shard(B.parts(rows), total), "words")
    stats = B.notes(answers).agg(F.sum("block").alias("n"), F.sum("size").alias("v")).first()
    n_train, n_words = stats["n"] or 0, stats["v"] or 0
    B.drop_parts(rows)
    groups = min(256, max(6, n_words // 500_000))
    table_ = counters(B.notes(answers), groups)
    held = spark.sparkContext.broadcast(learnt(B.notes(answers), table_, groups))

    def finish(block: int, data: bytes, answers: dict[int, tuple[int, bytes]], _) -> pd.DataFrame:
        return finished(data, answers, held.value, n_train, n_words)

    joined = B.payloads(rows).unionByName(B.parts(answers))
    return B.per_block(joined, finish, RESULT).withColumn("train_tokens", F.lit(n_train).cast("long"))


def op9_language_model(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (and bits_per_byte) of every document."""
    scored = score(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
