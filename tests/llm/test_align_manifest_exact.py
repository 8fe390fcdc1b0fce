"""Cross-tokenizer alignment, Merkle manifest and exact dedup: SQL, brute force, odd rows."""
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from churnspark.llm import alignment, exact_dedup, manifest
from churnspark.llm.oracles import SQL
from tests.llm.test_llm import SCHEMA, con, edge, edge_rows, items, odd_rows, same  # noqa: F401 (fixtures)

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows_by_value(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- exact dedup ----------------------------------------------------------------------------

@pytest.mark.parametrize("name", ["op12_merkle_manifest", "op13_exact_dedup"])
def test_edge_documents_match_sql(edge, items, con, name):
    run = {"op12_merkle_manifest": manifest.manifest, "op13_exact_dedup": exact_dedup.dedup}[name]
    same(run(edge), con, SQL[name])


def exact_brute(rows):
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", r.text or "")].append((-len(r.text or ""), r.doc_id is None, r.doc_id or 0, i))
    out = []
    for bare, members in groups.items():
        best = min(members)
        keep = rows[best[3]].doc_id
        out += [(rows[m[3]].doc_id, keep, len(members), sha(bare)) for m in members]
    return sorted(out, key=repr), len(groups)


@pytest.mark.parametrize("parts,bits", [(1, 4), (40, 1), (40, 4)])
def test_exact_dedup_of_odd_rows(spark, edge, parts, bits):
    extra = spark.createDataFrame([(500 + i, " a\tb " + " " * (i % 3), None, None, i, "x", "y") for i in range(90)], SCHEMA)
    odd = odd_rows(edge).unionByName(extra).repartition(parts)
    want, n_groups = exact_brute(odd.collect())
    got = exact_dedup.dedup(odd, fan_bits=bits)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    found = got.collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=repr) == want
    kept = [r for r in found if r.kept]
    assert len(kept) == n_groups == len({r.text_sha256 for r in kept})   # one row of each group stays, repeats of an id included
    assert all(r.doc_id == r.keep_id for r in kept)


def test_exact_dedup_of_nothing(edge):
    assert exact_dedup.dedup(edge.filter("false")).collect() == []


# --- manifest -------------------------------------------------------------------------------

def fold_all(rows):
    """Every row's result by the definition, without blocks."""
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, n_chars):
        return sha("".join(map(field, (r.doc_id, r.source, r.lang, n_chars, r.text))))

    def climb(nodes):
        """Root of the nodes and every node's siblings."""
        siblings, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, i in enumerate(at):
                if i ^ 1 < len(nodes):
                    siblings[k].append((i & 1, nodes[i ^ 1]))
                else:
                    siblings[k].append(None)
            nodes = [sha("".join(nodes[i:i + 2])) for i in range(0, len(nodes), 2)]
            at = [i // 2 for i in at]
        return nodes[0], siblings

    def fold(node, path):
        for s in path:
            node = sha(node if s is None else s[1] + node if s[0] else node + s[1])
        return node

    trees = defaultdict(list)
    for r in rows:
        trees["" if r.lang is None else "1" + r.lang].append((r, leaf(r, r.n_chars)))
    langs = sorted(trees, key=str.encode)
    ordered = {g: sorted(trees[g], key=lambda x: (x[0].doc_id is not None, x[0].doc_id or 0, x[1])) for g in langs}
    climbed = {g: climb([h for _, h in ordered[g]]) for g in langs}
    root, above = climb([climbed[g][0] for g in langs]) if langs else (None, [])
    out = []
    for g, up in zip(langs, above):
        for (r, h), own in zip(ordered[g], climbed[g][1]):
            path = own + up
            hit = r.doc_id is not None and r.n_chars is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
            folded = fold(leaf(r, r.n_chars + 1) if hit else h, path)
            out.append((r.doc_id, h, climbed[g][0], root, sha("".join(s[1] for s in path if s)), folded, folded == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits,range_rows", [(12, 500_000), (1, 9), (3, 20)])
def test_manifest_of_odd_rows(edge, bits, range_rows):
    odd = odd_rows(edge).withColumn("n_chars", F.when(F.col("doc_id") % 5 != 1, F.col("n_chars")))
    got = manifest.manifest(odd, bits=bits, range_rows=range_rows)
    want = fold_all(odd.collect())
    assert rows_by_value(got) == want
    assert any(not w[-1] for w in want)


def test_manifest_of_nothing_and_of_one_row(edge):
    assert manifest.manifest(edge.filter("false")).collect() == []
    one = edge.filter("doc_id = 10")
    (r,) = manifest.manifest(one).collect()
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == sha("")


@pytest.mark.parametrize("n", [1, 2, 5, 8, 13])
def test_versions_share_all_but_the_path(n):
    nodes = [sha(str(i)) for i in range(n)]
    base = manifest.BlockTree(nodes, None)
    for i in range(n):
        copied = base.version(i, sha("x"))
        whole = manifest.BlockTree(nodes[:i] + [sha("x")] + nodes[i + 1:], None)
        assert len(copied) == len(base.levels)     # one node a level, nothing else
        for level, low in enumerate(whole.levels):
            assert low == [copied.get((level, j), base.levels[level][j]) for j in range(len(low))]


# --- alignment ------------------------------------------------------------------------------

def align_brute(rows):
    import sentencepiece
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    decode = alignment.byte_alphabet()
    docs, held = [], Counter()
    for r in rows:
        text = r.text
        if not text:
            docs.append((r.doc_id, None))
            continue
        ea = t.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(decode[c] for c in tok)) for i, tok in zip(ea.ids, ea.tokens)]
        b = []
        for i, p in zip(sp.encode(text), sp.encode(text, return_type=str)):
            m = re.fullmatch(r"<0x([0-9A-F]{2})>", p)
            b.append((i, bytes([int(m[1], 16)]) if m else p.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            docs.append((r.doc_id, None))
            continue
        ends_a, ends_b = np.cumsum([len(x) for _, x in a]), np.cumsum([len(x) for _, x in b])
        cuts = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
        groups, i, j = [], 0, 0
        for c in cuts:
            ga, gb = [], []
            while i < len(a) and ends_a[i] <= c:
                ga.append(a[i][0])
                i += 1
            while j < len(b) and ends_b[j] <= c:
                gb.append(b[j][0])
                j += 1
            groups.append((ga, gb))
        docs.append((r.doc_id, (len(a), len(b), groups)))
        held.update({(x, y) for ga, gb in groups for x in ga for y in gb})
    most = Counter()
    for (x, _), k in held.items():
        most[x] = max(most[x], k)
    out = []
    for doc_id, found in docs:
        if found is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups = found
        pairs = [(x, y) for ga, gb in groups for x in ga for y in gb]
        digest = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((doc_id, n_a, n_b, len(groups), len(pairs), sum(held[p] == most[p[0]] for p in pairs), sum(held[p] for p in pairs), sha(digest)))
    return sorted(out, key=repr)


ODD_TEXTS = ["<|endoftext|> a <s> </s> <unk> <0x41>", "▁already▁marked", "a ▁ b", "   ", "\t\n\r\n  x  ", "é日🤦\U0001FAE8 ﬁ ſ ‍",
             "👩‍👩‍👧‍👦 नमस्ते ไทย العربية", "\x00\x01 nul", "a" * 3000, " " * 500 + "x", "日本語" * 200, "don't can't I'll 12345 3.14e10"]


def unicode_text(rng):
    pools = ["abc XYZ 019 ,.;'\n", "éàüñßœ ", "日本語テスト中文", "🤦👩🏽‍🚀😀", "Ωδя ж́", "\U00010348\U0001FAE8  "]
    return "".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(1, 120)))


def test_alignment_matches_brute_force(spark, edge):
    rng = random.Random(5)
    more = [(1000 + i, t, "en", "a", 1, "x", "y") for i, t in enumerate(ODD_TEXTS + [unicode_text(rng) for _ in range(200)])]
    docs = odd_rows(edge).unionByName(spark.createDataFrame(more, SCHEMA)).repartition(4)
    want = align_brute(docs.collect())
    for hot in (alignment.HOT, 50):   # 50: most counts are found by the shuffle
        got = alignment.align(docs, A, B, hot=hot)
        assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        assert rows_by_value(got) == want


def test_alignment_in_parts(edge, monkeypatch):
    """Large groups linked id by id, and documents of several rows, give the same."""
    n_a, n_b, groups = 40, 30, 3
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 5, n_a), rng.integers(0, 6, n_b)
    in_a, in_b = np.sort(np.append(rng.integers(0, groups, n_a - 3), [0, 1, 2])), np.sort(np.append(rng.integers(0, groups, n_b - 3), [0, 1, 2]))
    want = Counter(int(x * 100 + y) for x, g in zip(a, in_a) for y, h in zip(b, in_b) if g == h)
    for limit in (1 << 16, 20, 0):
        monkeypatch.setattr(alignment, "LARGE_GROUP", limit)
        pairs, times = alignment.linked(a, in_a, b, in_b, groups, 100)
        assert dict(zip(pairs.tolist(), times.tolist())) == want


def test_alignment_of_nothing(edge):
    assert alignment.align(edge.filter("false"), A, B).collect() == []
