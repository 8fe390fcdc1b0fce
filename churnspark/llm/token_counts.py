"""Token counts without tokens: Viterbi over a unigram vocabulary that carries best score and piece count only.

An Aho-Corasick automaton over the pieces enumerates all matches of a word in one pass; at each end position the best
path score and its piece count are kept. Ties go as in the tokenizers library's unigram model: a later match replaces the
best path only if its score is strictly higher, matches come by ascending start (so the longest piece wins a tie), and
a character without a piece of its own competes last, at the lowest score less 10. Unknown characters become their UTF-8
bytes where the vocabulary has all byte pieces, else one unknown piece per run.

Words (between ASCII white space, each with the word mark in front) are independent, so a task counts each distinct word
once per batch, keeps the counts of recent words and adds them up per text.

The vocabulary is read from a sentencepiece file; that file's pieces are ranked, and a piece's score is the log
probability of its rank under Zipf's law, -ln(rank + 2.7).

Defined cases: null or empty text has 0 tokens; every row is counted, repeated or with null id; empty table: empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Words whose counts a task remembers, and characters counted in one pass.
REMEMBERED, AT_ONCE = 1_000_000, 200_000
_SPACES = " \t\n\x0b\x0c\r"
_TO_BLANK = str.maketrans(_SPACES, " " * len(_SPACES))


def zipf_vocabulary(model_path: str) -> list[tuple[str, float]]:
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [(model.id_to_piece(i), -math.log(i + 2.7)) for i in range(model.get_piece_size())]


class Counter:
    """Piece counts of words under a unigram vocabulary."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece and "\n" not in piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        pieces = {p for p, _ in vocabulary}
        self.single = {p for p in pieces if len(p) == 1}
        self.bytes = all(f"<0x{i:02X}>" in pieces for i in range(256))
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.seen: dict[str, int] = {}

    def _count(self, words: list[str]) -> list[int]:
        """Counts of a few words at once: the words stand in one text, each after a newline where its path starts anew."""
        text = "".join(["\n" + MARK + w for w in words])
        least, n = -math.inf, len(text)
        best, count, run = [least] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        single, unknown, as_bytes = self.single, self.unknown, self.bytes
        done = 0  # positions up to here are final
        for end, (length, score) in self.automaton.iter(text):
            while done < end:
                self._close(text, done, best, count, run, single, unknown, as_bytes)
                done += 1
            at = end + 1 - length
            path = best[at] + score
            if path > best[end + 1]:
                best[end + 1], count[end + 1] = path, count[at] + 1
        while done < n:
            self._close(text, done, best, count, run, single, unknown, as_bytes)
            done += 1
        out, at = [], 0
        for w in words:
            at += len(w) + 2
            out.append(count[at])
        return out

    @staticmethod
    def _close(text, i, best, count, run, single, unknown, as_bytes):
        """Finish position i + 1: a newline starts a word, a character without a piece competes as unknown."""
        c = text[i]
        if c == "\n":
            best[i + 1], count[i + 1] = 0.0, 0
        elif c not in single:
            path = best[i] + unknown
            if path > best[i + 1]:
                best[i + 1] = path
                count[i + 1] = count[i] + (len(c.encode("utf-8", "surrogatepass")) if as_bytes else 0 if run[i] else 1)
                run[i + 1] = True

    def texts(self, texts: list[str | None]) -> list[int]:
        split = [t.translate(_TO_BLANK).split(" ") if t else [] for t in texts]
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        seen = self.seen
        new, size = [], 0
        for w in {w for ws in split for w in ws if w not in seen}:
            if not w:
                seen[w] = 0
                continue
            new.append(w)
            size += len(w)
            if size >= AT_ONCE:
                seen.update(zip(new, self._count(new)))
                new, size = [], 0
        seen.update(zip(new, self._count(new)))
        return [sum(map(seen.__getitem__, ws)) for ws in split]


@lru_cache(maxsize=2)
def load_counter(model_path: str) -> Counter:
    """One counter per Python worker; it outlives the task."""
    return Counter(zipf_vocabulary(model_path))


def token_counts(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_tokens) of every row, in one pass without a shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load_counter(model_path)
        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, 1000):
                out += counter.texts(batch.column(1).slice(at, 1000).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], names=["doc_id", "n_tokens"])
    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long")
