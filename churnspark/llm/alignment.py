"""Cross-tokenizer alignment: which tokens of one tokenizer cover the bytes of which tokens of another.

Every text is encoded by a byte-level BPE (tokenizers library, A; a space goes before the text) and by a sentencepiece model (B, which adds
that space itself). The libraries' spans are the coarse cuts: character offsets of A, byte offsets of B. A token whose span is not as long as its
decoded bytes (a piece of a multibyte character, a byte-fallback token) is refined: its end lies its own bytes after the end of the
token before it. Offsets where tokens of both end cut the tokens into groups; within a group every A token is linked to every B token.

The number of documents that hold an (A id, B id) pair linked is counted over the corpus; a document's links are then looked up in those counts.

Neither tokenizer joins anything across a single blank between two words (their files are asked: a byte-level pre-tokenizer that starts a piece at
such a blank, and no sentencepiece piece with a blank behind another character). So a text is cut there into units, which are
aligned on their own and remembered per Python worker; other tokenizers get whole texts as one unit.

Plan: one pass encodes and writes per document the groups' digest and its distinct pairs with their multiplicity. Counting is
a partial aggregation. For the lookup at most ``HOT`` pairs, those with at least 1 / ``HOT`` of all (document, pair) rows, are broadcast; the
others meet their counts by a shuffle in which no pair has more than 1 / ``HOT`` of the rows. The highest count of every A id
is broadcast, one row per vocabulary entry.

Defined cases: texts that are null, empty, or whose bytes one of the tokenizers does not give back have no tokens (zeros, empty digest);
rows with the same id are documents of their own; a document with more than ``PAIRS_AT_ONCE`` distinct pairs is several rows of the
intermediate table; empty table: empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import ChainMap, Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnspark.llm.common import stored

#: Texts handled together, distinct pairs of one row, pairs that may be broadcast.
AT_ONCE, PAIRS_AT_ONCE, HOT = 256, 1 << 20, 50_000
#: Units of one generation that a worker remembers (two are kept), and their longest length; units encoded by one call.
REMEMBERED, LONGEST, UNITS_AT_ONCE = 300_000, 64, 2_000
_CUT = re.compile(r"(?<=\S) (?=\S)").split
#: Larger groups are linked id by id with multiplicities, not token by token.
LARGE_GROUP = 1 << 16


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of a byte-level vocabulary: printable Latin-1 stands for itself, the others follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Unit(NamedTuple):
    """What a piece of text gives: numbers of tokens and groups, the groups' ids as text, pairs and how often each is linked (packed)."""
    n_a: int
    n_b: int
    n_groups: int
    ids: str
    pairs: bytes
    times: bytes


class Aligner:
    """Both tokenizers and their tables; one per Python worker."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet = byte_alphabet()
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_length, self.b_length = (np.array([len(t) for t in table], np.int64) for table in (self.a_bytes, self.b_bytes))
        # ids as text with what follows them: inside and at the end of their side of a group
        v, w = len(self.a_bytes), len(self.b_bytes)
        self.texts = [f"{i}{m}" for m, n in ((",", v), ("|", v), (",", w), (";", w)) for i in range(n)]
        with open(a_path, encoding="utf-8") as f:
            file = json.load(f)
        before = file.get("pre_tokenizer") or {}
        self.cuts = (file.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True)
                     and not before.get("add_prefix_space") and all("▁" not in p.lstrip("▁") for p in pieces))
        self.seen: dict[str, Unit | None] = {}    # units met lately
        self.older: dict[str, Unit | None] = {}   # and those met before; the ones met again move up

    @property
    def width(self) -> int:
        """Number of B ids: a pair is A id * width + B id."""
        return len(self.b_bytes)

    def encode(self, text: str) -> tuple[np.ndarray, ...] | None:
        """(A ids, A ends, B ids, B ends) in bytes of space + text (A gets the space, B adds it); None where the bytes do not come back."""
        raw = text.encode()
        enc, other, whole = self.a.encode(" " + text, add_special_tokens=False), self.b.encode(raw, return_type="offset_mapping"), b" " + raw
        a, b = enc.ids, other["ids"]
        if b"".join(map(self.a_bytes.__getitem__, a)) != whole or b"".join(map(self.b_bytes.__getitem__, b)) != whole:
            return None
        spans = np.fromiter(chain.from_iterable(enc.offsets), np.int64, 2 * len(a)).reshape(-1, 2)
        if len(raw) != len(text):
            spans = _byte_at(" " + text)[spans]
        coarse = np.fromiter(chain.from_iterable(other["offsets"]), np.int64, 2 * len(b)).reshape(-1, 2) + 1
        coarse[0, 0] = 0   # the text begins behind the added space
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        return a, refined(spans, self.a_length[a]), b, refined(coarse, self.b_length[b])

    def group_texts(self, a: np.ndarray, in_a: np.ndarray, b: np.ndarray, in_b: np.ndarray) -> list[str]:
        """The ids of every group in order, as the pieces of ``a1,a2|b1;a3|b2,b3;``."""
        v, w = len(self.a_bytes), len(self.b_bytes)
        last_a, last_b = np.append(in_a[1:] != in_a[:-1], True), np.append(in_b[1:] != in_b[:-1], True)
        codes = np.concatenate([a + v * last_a, 2 * v + b + w * last_b])
        order = np.argsort(np.concatenate([2 * in_a, 2 * in_b + 1]), kind="stable")
        return list(map(self.texts.__getitem__, codes[order].tolist()))

    def one(self, text: str) -> Unit | None:
        """A whole text or a long unit."""
        tokens = self.encode(text)
        if tokens is None:
            return None
        a, a_ends, b, b_ends = tokens
        n, in_a, in_b = groups(a_ends, b_ends)
        pairs, times = linked(a, in_a, b, in_b, n, self.width)
        return Unit(len(a), len(b), n, "".join(self.group_texts(a, in_a, b, in_b))[:-1], pairs.tobytes(), times.tobytes())

    def many(self, units: list[str]) -> Iterator[Unit | None]:
        """Short units, encoded together as one text with blanks between them and cut apart again."""
        tokens = self.encode(" ".join(units))
        if tokens is None:   # one of them does not come back
            if len(units) == 1:
                yield None
            else:
                yield from self.many(units[:len(units) // 2])
                yield from self.many(units[len(units) // 2:])
            return
        a, a_ends, b, b_ends = tokens
        n, in_a, in_b = groups(a_ends, b_ends)
        n_a, n_b = np.bincount(in_a, minlength=n), np.bincount(in_b, minlength=n)
        left, right = link_all(in_a, n_a, n_b)
        pairs, texts = a[left] * self.width + b[right], self.group_texts(a, in_a, b, in_b)
        ends = np.cumsum([len(u.encode()) + 1 for u in units])
        cut_a, cut_b = np.searchsorted(a_ends, ends, "right"), np.searchsorted(b_ends, ends, "right")
        cut_g = in_a[cut_a - 1] + 1
        cut_p, cut_t = np.cumsum(n_a * n_b)[cut_g - 1], cut_a + cut_b
        ones = np.ones(int(np.diff(cut_p, prepend=0).max()), np.int64).tobytes()
        data, f = pairs.tobytes(), [0] * 5
        for t in zip(cut_a.tolist(), cut_b.tolist(), cut_g.tolist(), cut_p.tolist(), cut_t.tolist()):
            yield Unit(t[0] - f[0], t[1] - f[1], t[2] - f[2], "".join(texts[f[4]:t[4]])[:-1], data[8 * f[3]:8 * t[3]], ones[:8 * (t[3] - f[3])])
            f = t

    def align(self, texts: list[str]) -> Iterator[tuple | None]:
        """(tokens of A, of B, groups, links, digest, pairs, times) of each text; None where the bytes do not come back."""
        split = [_CUT(t) if self.cuts else [t] for t in texts]
        if len(self.seen) > REMEMBERED:
            self.seen, self.older = {}, self.seen
        new = set().union(*split).difference(self.seen)
        again = new.intersection(self.older)
        self.seen.update((u, self.older[u]) for u in again)
        new -= again
        short = [u for u in new if self.cuts and len(u) <= LONGEST and not u[0].isspace() and not u[-1].isspace()]
        long = new.difference(short)
        for i in range(0, len(short), UNITS_AT_ONCE):
            some = short[i:i + UNITS_AT_ONCE]
            self.seen.update(zip(some, self.many(some)))
        known = ChainMap({u: self.one(u) for u in long}, self.seen) if long else self.seen
        for units in split:
            counted = Counter(units)
            own = list(map(known.__getitem__, counted))
            if None in own:
                yield None
                continue
            weights = np.fromiter(counted.values(), np.int64, len(own))
            n_a, n_b, n_groups, _, packed, _ = zip(*own)
            links = np.frombuffer(b"".join(packed), np.int64)
            each = np.frombuffer(b"".join([o[5] for o in own]), np.int64) * np.repeat(weights, [len(p) // 8 for p in packed])
            order = np.argsort(links)
            links, each = links[order], each[order]
            first = np.flatnonzero(np.append(True, links[1:] != links[:-1]))
            texts_of = dict(zip(counted, [o[3] for o in own]))
            sha = hashlib.sha256(";".join(map(texts_of.__getitem__, units)).encode()).hexdigest()
            yield int(weights @ n_a), int(weights @ n_b), int(weights @ n_groups), int(each.sum()), sha, links[first], np.add.reduceat(each, first)


def _byte_at(text: str) -> np.ndarray:
    """Byte offset of every character of the text, and of its end."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return np.concatenate([[0], np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000))])


def refined(spans: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Token ends: the span's where it is as long as the token's bytes, else as many bytes after the last such end."""
    ends, sure = spans[:, 1], spans[:, 1] - spans[:, 0] == lengths
    if sure.all():
        return ends
    upto = np.cumsum(lengths)
    last = np.maximum.accumulate(np.where(sure, np.arange(len(ends)), -1))
    return np.where(last >= 0, ends[last] - upto[last], 0) + upto


def groups(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of groups and the group of every A and B token."""
    cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
    return len(cuts), np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends)


def link_all(in_a: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the A and B token of every link, group by group; groups of ``n_b`` 0 have none."""
    times = n_b[in_a]
    left = np.repeat(np.arange(len(in_a)), times)
    first_b = np.cumsum(n_b) - n_b
    return left, first_b[in_a[left]] + np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)


def linked(a: np.ndarray, in_a: np.ndarray, b: np.ndarray, in_b: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of the groups (sorted) and how often each is linked."""
    n_a, n_b = np.bincount(in_a, minlength=n), np.bincount(in_b, minlength=n)
    large = n_a * n_b > LARGE_GROUP
    keep = ~large[in_b]
    left, right = link_all(in_a, n_a, np.where(large, 0, n_b))
    pairs, counts = np.unique(a[left] * width + b[keep][right], return_counts=True)
    if large.any():
        parts, weights = [pairs], [counts]
        for g in np.flatnonzero(large):
            ids_a, k_a = np.unique(a[in_a == g], return_counts=True)
            ids_b, k_b = np.unique(b[in_b == g], return_counts=True)
            parts.append((ids_a[:, None] * width + ids_b).ravel())
            weights.append((k_a[:, None] * k_b).ravel())
        pairs, back = np.unique(np.concatenate(parts), return_inverse=True)
        counts = np.zeros(len(pairs), np.int64)
        np.add.at(counts, back, np.concatenate(weights))
    return pairs, counts


@lru_cache(maxsize=1)
def load_aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


LINKS = ("row long, part int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
         "pairs array<long>, times array<int>")
_SCHEMA = pa.schema([("row", pa.int64()), ("part", pa.int32()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
                     ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
                     ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))])


def _encoder(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = load_aligner(a_path, b_path)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for begin in range(0, batch.num_rows, AT_ONCE):
                some = batch.slice(begin, AT_ONCE)
                texts = some.column(1).to_pylist()
                found = aligner.align([t for t in texts if t])
                columns: list[list] = [[] for _ in _SCHEMA]
                for doc_id, text in zip(some.column(0).to_pylist(), texts):
                    row += 1
                    got = next(found) if text else None
                    if got is None:
                        _add(columns, (row, 0, doc_id, 0, 0, 0, 0, "", [], []))
                        continue
                    n_a, n_b, n_groups, n_links, sha, pairs, times = got
                    for part, at in enumerate(range(0, len(pairs), PAIRS_AT_ONCE)):
                        cut = slice(at, at + PAIRS_AT_ONCE)
                        own = (n_a, n_b, n_groups, n_links, sha) if part == 0 else (0, 0, 0, 0, "")
                        _add(columns, (row, part, doc_id, *own, pairs[cut], times[cut].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)
    return run


def _add(columns: list[list], values: tuple) -> None:
    for column, value in zip(columns, values):
        column.append(value)


def links(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Stored rows of every document: numbers of tokens, groups and links, the groups' digest, distinct pairs and their multiplicities."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(narrow.mapInArrow(_encoder(a_path, b_path), LINKS), "alignment-links")


def pair_counts(found: DataFrame, width: int) -> DataFrame:
    """(pair, docs, best): documents that hold each pair, and whether that is the highest number of its A id."""
    counts = stored(found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("docs")), "alignment-pairs")
    a = F.floor(F.col("pair") / width)
    highest = counts.groupBy(a.alias("a")).agg(F.max("docs").alias("most"))     # at most the vocabulary of A
    return counts.join(F.broadcast(highest), a == F.col("a")).select("pair", "docs", (F.col("docs") == F.col("most")).cast("int").alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, hot: int = HOT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): one row per document."""
    import sentencepiece
    width = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    found = links(docs, a_path, b_path)
    counts = stored(pair_counts(found, width), "alignment-counts")
    total = counts.agg(F.sum("docs")).first()[0] or 0
    frequent = F.broadcast(counts.filter(F.col("docs") * hot >= total))          # at most ``hot`` rows
    rare = counts.filter(F.col("docs") * hot < total)
    each = found.select("row", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("times"))))
    own = [F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum")]
    of_frequent = each.join(frequent, "pair").groupBy("row").agg(*own)
    of_rare = each.join(frequent.select("pair"), "pair", "left_anti").join(rare, "pair").groupBy("row").agg(*own)
    sums = of_frequent.unionByName(of_rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return found.filter("part = 0").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), "groups_sha256")
