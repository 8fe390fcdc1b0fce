"""Language-model scoring with a weighted backoff automaton over words.

The model is a smoothed bigram model. Its automaton has a state per word that was followed by something in training, plus
the start state and the unigram state. An arc h -> w exists for every bigram seen and weighs
``(1 - FAIL) * c(hw) / c(h) + FAIL * p(w)``; every state has a failure arc of weight ``FAIL`` to the unigram state,
where w weighs ``p(w) = (c(w) + 0.1) / (N + 0.1 * (V + 1))``. Each state's weights sum to one. A text is read from left to
right: the state carried is the last word; where it has no arc for the next word, the failure arc is taken first (the
unigram state itself, reached after words never seen in training, fails nowhere). Log-probabilities add up.

The model grows with the corpus, so no task holds it whole:

1. Documents are dealt to blocks of about ``BLOCK_BYTES`` of text by a hash. A block sends its distinct unigrams and
   bigrams (64-bit hashes, sorted) with their training counts, cut into ranges of the hash space.
2. A task per hash range adds the counts of all blocks. Ranges are even whatever the words: a frequent word or bigram is one
   entry per block. It answers each block with the total counts of the keys that the block sent, in their order, plus its
   share of the vocabulary size and token count.
3. Each block rebuilds its keys, lines them up with the answers and so has the part of the automaton that its
   own documents can reach, and traverses it.

Tokens: words between ASCII white space with A-Z lower-cased, and one end token a text. Training: documents whose
crc32(id as text) mod 10 is not 0. Defined cases: null text counts as empty (only the end token); a null id counts
as the empty text (crc32 0, held out); repeated rows count as often as they occur and each get a score; with no training
document every word is unknown (p = 0.1 / (0.1 * 1) = 1, score 0); empty table: empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnspark.llm.shingles import WordHashes, mix, split_words

ADD = 0.1
#: Weight of the failure arcs.
FAIL = 0.8
#: Text per block (a task holds one block), and text per range of the hash space.
BLOCK_BYTES, RANGE_BYTES = 8 << 20, 16 << 20
# Neither can be a word: both hold a blank.
END, START = (np.uint64(xxhash.xxh3_64_intdigest(s)) for s in (b" end", b" start"))
_MUL = np.uint64(0x9E3779B97F4A7C15)


def planes(a: np.ndarray) -> bytes:
    """Values byte plane by byte plane: sorted keys and small counts then compress well in a shuffle."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(-1, 8).T.tobytes()


def unplanes(b: bytes, dtype=np.uint64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(dtype).reshape(-1)


class Block:
    """Tokens of a block's documents as arrays, with its distinct unigram and bigram keys."""

    def __init__(self, texts: list[str | None], hashes: WordHashes):
        parts = []
        for text in texts:
            ws = split_words(text)
            h = np.empty(len(ws) + 1, np.uint64)
            h[:-1] = np.fromiter(map(hashes.__getitem__, ws), np.uint64, len(ws))
            h[-1] = END
            parts.append(h)
        self.lengths = np.array([len(p) for p in parts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)
        word = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        before = np.empty_like(word)
        before[1:] = word[:-1]
        before[self.starts] = START
        self.uni, self.word = np.unique(word, return_inverse=True)
        self.bi, self.pair = np.unique(mix(mix(before) * _MUL + word), return_inverse=True)

    def counts(self, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Training counts of the unigram and the bigram keys."""
        used = np.repeat(train, self.lengths)
        return tuple(np.bincount(at[used], minlength=len(keys)).astype(np.uint64)
                     for at, keys in ((self.word, self.uni), (self.pair, self.bi)))


class BackoffAutomaton:
    """The part of the automaton that a block's documents reach; states are the block's words, arcs its bigrams."""

    def __init__(self, block: Block, uni: np.ndarray, bi: np.ndarray, tokens: int, vocabulary: int):
        self.block, self.known = block, uni > 0
        self.unigram = (uni + ADD) / (tokens + ADD * (vocabulary + 1))
        self.visits, self.arcs = uni.astype(np.float64), bi.astype(np.float64)
        end = np.searchsorted(block.uni, END)
        self.starts = self.visits[end] if end < len(block.uni) else 0.0  # the start state is visited once a document

    def traverse(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per document: known tokens, unigram and automaton log10 probability. All texts move in step, position by position
        of the block: the state at a token is the word before it, the start state at the first."""
        b = self.block
        if not len(b.word):
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        p = self.unigram[b.word]
        visits = np.empty(len(p))
        visits[1:] = self.visits[b.word[:-1]]
        visits[b.starts] = self.starts
        seen = visits > 0
        q = np.where(seen, FAIL * p + (1 - FAIL) * self.arcs[b.pair] / np.maximum(visits, 1), p)
        return (np.add.reduceat(self.known[b.word].astype(np.int64), b.starts),
                np.add.reduceat(np.log10(p), b.starts), np.add.reduceat(np.log10(q), b.starts))


def _cuts(ranges: int) -> np.ndarray:
    return np.array([(i << 64) // ranges for i in range(1, ranges)], np.uint64)


def _sender(ranges: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        block = Block(table.column("text").to_pylist(), WordHashes())
        counts = block.counts(~np.array(table.column("held_out").to_pylist(), bool))
        out = {"range": list(range(ranges)), "block": [key[0].as_py()] * ranges}
        for name, keys, count in (("uni", block.uni, counts[0]), ("bi", block.bi, counts[1])):
            at = np.searchsorted(keys, _cuts(ranges))
            out[name] = [planes(x) for x in np.split(keys, at)]
            out[name + "_n"] = [planes(x) for x in np.split(count, at)]
        return pa.table(out, schema=_SENT)
    return run


_SENT = pa.schema([("range", pa.int32()), ("block", pa.int64()), ("uni", pa.binary()), ("uni_n", pa.binary()),
                   ("bi", pa.binary()), ("bi_n", pa.binary())])
_ANSWER = pa.schema([("block", pa.int64()), ("range", pa.int32()), ("uni_n", pa.binary()), ("bi_n", pa.binary()),
                     ("vocabulary", pa.int64()), ("tokens", pa.int64())])


def _adder(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Total counts of one hash range, given back to every block in the order of its keys."""
    out, stats = {"block": table.column("block"), "range": table.column("range")}, None
    for name in ("uni", "bi"):
        keys = [unplanes(x) for x in table.column(name).to_pylist()]
        counts = np.concatenate([unplanes(x) for x in table.column(name + "_n").to_pylist()])
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, weights=counts, minlength=len(distinct)).astype(np.uint64)
        back = total[at]
        ends = np.cumsum([len(k) for k in keys])[:-1]
        out[name + "_n"] = [planes(x) for x in np.split(back, ends)]
        stats = stats or (int((total > 0).sum()), int(total.sum()))
    rows = table.num_rows
    return pa.table(out | {"vocabulary": [stats[0]] * rows, "tokens": [stats[1]] * rows}, schema=_ANSWER)


def _scorer(docs: pa.Table, answers: pa.Table) -> pa.Table:
    answers = answers.sort_by("range")
    block = Block(docs.column("text").to_pylist(), WordHashes())
    uni, bi = (np.concatenate([np.empty(0, np.uint64), *[unplanes(x) for x in answers.column(c).to_pylist()]]) for c in ("uni_n", "bi_n"))
    tokens, vocabulary = (sum(answers.column(c).to_pylist()) for c in ("tokens", "vocabulary"))
    known, base, score = BackoffAutomaton(block, uni, bi, tokens, vocabulary).traverse()
    return pa.table({"doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": block.lengths, "n_known": known,
                     "train_tokens": np.full(len(known), tokens, np.int64), "base_score": base, "score": score}, schema=_SCORES)


_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                     ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def scores(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, ranges = (max(1, math.ceil(size / x)) for x in (BLOCK_BYTES, RANGE_BYTES))
    doc_id = F.col("doc_id").cast("long")
    dealt = docs.select(F.pmod(F.xxhash64(doc_id, "text"), F.lit(blocks)).alias("block"), doc_id.alias("doc_id"),
                        (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0).alias("held_out"), "text")
    sent = dealt.groupBy("block").applyInArrow(
        _sender(ranges), "range int, block long, uni binary, uni_n binary, bi binary, bi_n binary")
    answers = sent.groupBy("range").applyInArrow(
        _adder, "block long, range int, uni_n binary, bi_n binary, vocabulary long, tokens long")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _scorer, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
