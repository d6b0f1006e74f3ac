import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.llm import bpe, importance, merkle

tiktoken = pytest.importorskip("tiktoken")
tokenizers = pytest.importorskip("public_tokenizers")


# ------------------------------------------------------------------ Merkle ----
def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def slow_manifest(rows):
    """{row number: (leaf, subroot, root, proof, folded)} by building every tree whole, twice."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: H(field(r[0]), field(r[2]), field(t))
    own = [leaf(r, r[1]) for r in rows]

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([H(*levels[-1][i:i + 3]) for i in range(0, len(levels[-1]), 3)])
        return levels

    def proof(levels, i):
        out = []
        for low in levels[:-1]:
            out += [low[j] for j in range(i - i % 3, min(i - i % 3 + 3, len(low))) if j != i]
            i //= 3
        return out

    names = sorted({r[2] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    members = {s: sorted((i for i, r in enumerate(rows) if r[2] == s), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, own[i])) for s in names}
    trees = {s: tree([own[i] for i in members[s]]) for s in names}
    tops = [trees[s][-1][0] for s in names]
    upper = tree(tops)
    out = {}
    for at, s in enumerate(names):
        for p, i in enumerate(members[s]):
            folded = upper[-1][0]
            if rows[i][0] is not None and zlib.crc32(str(rows[i][0]).encode()) % 2 == 0:
                new = leaf(rows[i], None if rows[i][1] is None else rows[i][1].replace("\n", ""))
                changed = [own[j] if j != i else new for j in members[s]]
                folded = tree(tops[:at] + [tree(changed)[-1][0]] + tops[at + 1:])[-1][0]
            out[i] = own[i], trees[s][-1][0], upper[-1][0], proof(trees[s], p) + proof(upper, at), folded
    return out


def manifest_of(d, height):
    c = F.col
    other = merkle.leaf([c("doc_id"), c("source"), F.replace(c("text"), F.lit("\n"), F.lit(""))])
    out = merkle.manifest(d, c("doc_id"), c("source"), merkle.leaf([c("doc_id"), c("source"), c("text")]),
                          F.when(F.crc32(c("doc_id").cast("string")) % 2 == 0, other), height)
    return out.collect()


@pytest.mark.parametrize("height", [1, 2, 6])
def test_manifest(docs_of, height):
    rows = [(i, f"a\nline {i % 9}" if i % 3 else "flat", "hot" if i % 3 else f"s{i % 8}") for i in range(90)]
    rows += [(200, None, None), (201, "", None), (None, "no\nkey", "hot"), (300, "ünï\n", "é"), (7, rows[7][1], rows[7][2]), (7, "same key\n", rows[7][2])]
    want = sorted(slow_manifest(rows).values())
    got = manifest_of(docs_of(rows).repartition(5), height)
    assert sorted((r.leaf, r.subroot, r.root, r.proof, r.folded) for r in got) == want
    for r in got:
        tampered = r.key is not None and zlib.crc32(str(r.key).encode()) % 2 == 0
        assert (r.folded != r.root) == (tampered and r.altered != r.leaf)
        assert (r.copied[-1:] == [r.folded]) if tampered else r.copied == []


def test_manifest_of_one_and_none(docs_of):
    one = manifest_of(docs_of([(1, "a\nb", "s")]), 6)[0]
    assert one.root == one.subroot == one.leaf and one.proof == []
    assert manifest_of(docs_of([(1, "a", "s")]).limit(0), 6) == []


def test_block_shares_nodes():
    tree = merkle.Block([str(i) for i in range(20)], 20)
    assert tree.copied(7, "7") == merkle.climbed("7", 7, 20, [x for level in tree.siblings(7) for x in level])
    assert tree.copied(7, "7")[-1] == tree.top and tree.copied(7, "x")[-1] != tree.top


# -------------------------------------------------------------- importance ----
def slow_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if c.isdigit() and c.isascii() or "a" <= c <= "z" or ord(c) >= 128 else " " for c in lower).split(" ")


def slow_features(text, longest):
    ws = [w for w in slow_words(text) if w]
    return len(ws), [" ".join(ws[i:i + k]) for k in range(1, longest + 1) for i in range(len(ws) - k + 1)]


def slow_resample(rows, target, longest, buckets, least, percent, seed):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    count = lambda texts: np.bincount([bucket(f) for t in texts for f in slow_features(t, longest)[1]], minlength=buckets)
    s, t = count([r[1] for r in rows]), count(target)
    gain = [math.floor(1000 * math.log((int(b) + 1) * (int(s.sum()) + buckets) / ((int(a) + 1) * (int(t.sum()) + buckets)))) for a, b in zip(s, t)]
    out = []
    for k, text, *_ in rows:
        n, f = slow_features(text, longest)
        w = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        out.append([k, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    enough = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for i, r in enumerate(enough[:percent * len(enough) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("longest", [1, 3])
def test_resample(docs_of, prose, longest, llm):
    rows = [(i, prose(i % 60, i) + (" The, END." if i % 2 else ""), "s") for i in range(120)]
    rows += [(500, None), (501, ""), (502, "... !?"), (503, "É ünï x1\ty\x00z  {a}é"), (504, "q" * 1500 + " w " + "r" * 513), (505, "A b " * 3000), (7, rows[7][1]), (None, prose(30, 3))]
    target = [prose(40, 900 + i) for i in range(4)] + [None, ""]
    d = docs_of(rows)
    t = llm.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string")
    got = importance.resample(d, t, longest=longest, buckets=500, least_words=10, percent=30, seed=5)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == slow_resample(rows, target, longest, 500, 10, 30, 5)


def test_resample_nothing(docs_of, llm):
    t = llm.createDataFrame([], "item_id long, text string")
    assert importance.resample(docs_of([(1, "a", "s")]).limit(0), t).count() == 0
    assert [tuple(r)[1:3] for r in importance.resample(docs_of([(1, "a b", "s")]), t).collect()] == [(2, math.floor(1000 * math.log(10002 / 20000)))]


def test_slices_and_composition(monkeypatch):
    r = random.Random(3)
    text = " ".join("".join(r.choice("abé1") for _ in range(r.choice([1, 5, 600, 1300]))) for _ in range(40)) + "-" * 5
    monkeypatch.setattr(importance, "SLICE", 2000)
    (crc, size), (crc2, _) = importance.words_of([text, "short one"])
    ws = [w for w in slow_words(text) if w]
    assert crc.tolist() == [zlib.crc32(w.encode()) for w in ws] and size.tolist() == [len(w.encode()) for w in ws]
    assert crc2.tolist() == [zlib.crc32(b"short"), zlib.crc32(b"one")]


# --------------------------------------------------------------------- BPE ----
PATH = tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=bpe.ranks_at(PATH), special_tokens={})


def odd_texts(prose):
    r = random.Random(1)
    texts = [None, "", "  \n\n\t a\xa0 b  ", "I'll don't 12345678901234567890", "\x1c\x1d a\x85b​", "🙂👩‍👩‍👧 x\x00\x01", "<|endoftext|>",
             "a" * 5000, "=" * 777, "日本語のテキスト処理" * 30, "abcdefghij" * 40, prose(4000, 1), prose(50, 2), prose(50, 2)]
    texts += ["".join(r.choice("abAB ées\n\t1.!'") for _ in range(r.randrange(300))) for _ in range(60)]
    texts += ["".join(r.choice("abcdest") for _ in range(r.randrange(60, 400))) for _ in range(40)]
    return texts


def test_encode_decode(docs_of, prose, plain):
    rows = [(i, t, "s") for i, t in enumerate(odd_texts(prose))]
    out = bpe.encode(docs_of(rows), PATH, tokenizers.PATTERN)
    assert out.columns[-3:] == ["ids", "n_tokens", "decoded"] and "word" in out.columns
    for r in out.collect():
        assert r.ids == plain.encode_ordinary(r.text or "") and r.n_tokens == len(r.ids) and bytes(r.decoded) == (r.text or "").encode()
    again = bpe.decode(out.drop("decoded"), PATH, tokenizers.PATTERN)
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in again.collect())
    assert bpe.encode(docs_of(rows).limit(0), PATH, tokenizers.PATTERN).count() == 0


def test_small_groups_and_forgetting(prose, plain, monkeypatch):
    monkeypatch.setattr(bpe, "GROUP", 50)
    monkeypatch.setattr(bpe, "AT_ONCE", 30)
    monkeypatch.setattr(bpe, "DECODE_ROWS", 40)
    m = bpe.Merger(bpe.ranks_at(PATH), tokenizers.PATTERN, kept=20)
    texts = odd_texts(prose)[-30:] + [prose(30, i) for i in range(9)]
    ids = [plain.encode_ordinary(t) for t in texts]
    assert [x for x, _ in m.encode(texts)] == [",".join(map(str, i)) for i in ids]
    assert m.decode([None, [], *ids]) == [None, b"", *(t.encode() for t in texts)]
    with pytest.raises(ValueError):
        m.decode([[60_000]])


def test_queries(llm, plain):
    """The registered queries over whole small tables, against plain versions."""
    from vigil.llm import queries as Q
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in Q.read(llm, sf, "documents").select("doc_id", "text").collect()]
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for k, t in docs:
        ids = plain.encode_ordinary(t or "")
        want.append((k, len(ids), digest(",".join(map(str, ids)).encode()), digest((t or "").encode())))
    assert sorted(map(tuple, Q.op13_byte_bpe(llm, sf).collect())) == sorted(want)
    target = [r.text for r in Q.read(llm, sf, "benchmark").collect()]
    assert sorted((tuple(r) for r in Q.op12_importance(llm, sf).collect()), key=str) == slow_resample(docs, target, 1, 10_000, 20, 10, 2024)
    assert all(r.verified == (r.folded_root == r.root) for r in Q.op11_merkle(llm, sf).collect())
