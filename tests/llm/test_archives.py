"""Ranked search, Merkle manifest and WARC archives against plain versions."""

import base64
import hashlib
import math
import os
import random
import re
import tempfile
import zlib
from collections import Counter

import numpy as np
import pytest

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def plain_search(docs, items, k=10):
    words = [(i, terms(t)) for i, t in docs]
    n = sum(bool(w) for _, w in words)
    total = sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    out = Counter()
    for item, text in items:
        scored = []
        for i, w in words:
            tf, m = Counter(w), 10 + 90 * len(w) * n // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in set(terms(text)) if tf[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1):
            out[item, rank, i, -s] += 1
    return out


def corpus():
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(300)] + ["Ünï", "x_y", "é", "ABC", "abc", "d1"]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    texts = [say(r.randint(1, 60)) for _ in range(400)]
    docs = [(i, t) for i, t in enumerate(texts)]
    docs += [(1000 + i, texts[0]) for i in range(50)]  # copies: ties beyond the tenth
    docs += [(3, texts[9]), (3, texts[9]), (None, texts[5]), (None, None), (500, ""), (501, " .,;"), (502, "w1 " * 30000), (503, say(20000))]
    items = [(i, " ".join(texts[7 * i].split()[:20]) + " " + say(3)) for i in range(30)]
    items += [(100, None), (101, ""), (102, "unseen words"), (103, texts[0]), (103, texts[0]), (104, "w1"), (None, "w2 w3"), (105, say(3000))]
    return docs, items


@pytest.mark.parametrize("block_bytes", [1 << 20, 4000])
def test_search(spark, block_bytes):
    from quoin.llm.search import search

    docs, items = corpus()
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, rank int").repartition(5)
    b = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, score int")
    got = Counter((x.item_id, x["rank"], x.doc_id, x.score) for x in search(d, b, block_bytes=block_bytes).collect())
    assert got == plain_search(docs, items)
    if block_bytes > 4000:
        assert search(d.limit(0), b).count() == search(d, b.limit(0)).count() == 0


def test_pairs_of_nodes_are_pruned():
    """Documents of other terms are never scored, and what is left gives the brute-force result."""
    from quoin.llm.search import Best, Items, descend, documents_tree

    r = np.random.default_rng(0)
    terms = [np.sort(r.choice(40, 6, replace=False)) + 40 * (i % 5) for i in range(20)]
    weights = r.integers(1, 9000, 200)
    impacts = np.zeros((2000, 200), np.float32)
    for d in range(2000):
        at = r.choice(40, 8, replace=False) + 40 * (d * 5 // 2000)
        impacts[d, at] = r.integers(1000, 900000, 8)
    scores = np.zeros((20, 2000), np.int64)
    for i, t in enumerate(terms):
        scores[i] = impacts[:, t].astype(np.int64) @ weights[t]
    floors = np.sort(scores, axis=1)[:, -10]
    best, opened = Best(20, 10, floors), np.zeros(2, np.int64)
    descend(Items(terms, weights), documents_tree(impacts), np.arange(2000), best, opened)
    for i in range(20):
        want = sorted(((-s, d) for d, s in enumerate(scores[i].tolist()) if s > 0))[:10]
        assert sorted(zip((-best.scores[i]).tolist(), best.ids[i].tolist())) == want
    assert opened[1] <= 20 * 400  # pairs scored: a fifth of the documents has an item's terms at all
    assert opened.sum() < 20 * 2000 / 3


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(leaves):
    """(root, siblings of each leaf from the lowest level up)"""
    groups, nodes, proofs = [[i] for i in range(len(leaves))], list(leaves), [[] for _ in leaves]
    while len(nodes) > 1:
        up, held = [], []
        for k in range(0, len(nodes), 16):
            run = nodes[k : k + 16]
            for j, _ in enumerate(run):
                for leaf in groups[k + j]:
                    proofs[leaf] += run[:j] + run[j + 1 :]
            up.append(sha("".join(run)))
            held.append([x for g in groups[k : k + 16] for x in g])
        nodes, groups = up, held
    return nodes[0], proofs


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_manifest(rows):
    trees = {}
    for row in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, leaf_of(x))):
        trees.setdefault(row[1], []).append(row)
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    each = {s: plain_tree([leaf_of(x) for x in trees[s]]) for s in names}
    root, tops = plain_tree([each[s][0] for s in names])
    out = Counter()
    for s, top in zip(names, tops):
        for row, proof in zip(trees[s], each[s][1]):
            chosen = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            forged = leaf_of((*row[:4], None if row[4] is None else row[4].translate(FOLD))) if chosen else None
            out[row[0], leaf_of(row), forged, each[s][0], root, sha("".join(proof + top))] += 1
    return out


def manifest_rows(n_hot, others):
    rows = [(i * 3, "hot", "en", 5, f"Text {i}") for i in range(n_hot)]
    rows += [(i, f"s{i % others}", None, i, f"b{i}") for i in range(4 * others)]
    return rows + [(1, None, None, None, None), (None, None, "xx", 1, "É" * 3), (None, None, "xx", 1, "É" * 3), (5, "", "de", 0, ""), (5, "", "de", 0, "Z"), (7, "ÿ", "de", 9, "long " * 50000), (8, "one", None, 1, "ABC")]


@pytest.mark.parametrize("n_hot,others", [(4500, 3), (256, 20), (17, 300)])
def test_manifest(spark, n_hot, others):
    from pyspark.sql import functions as F

    from quoin.llm.merkle import folded, manifest, proof_digest

    rows = manifest_rows(n_hot, others)
    df = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, source string, lang string, n_chars long, text string, at string").repartition(3)
    found = manifest(df).withColumns({"proof": proof_digest(F.col("path")), "again": folded(F.col("leaf"), F.col("path")), "bent": folded(F.coalesce("forged", "leaf"), F.col("path"))}).drop("path").collect()
    assert Counter((x.doc_id, x.leaf, x.forged, x.subroot, x.root, x.proof) for x in found) == plain_manifest(rows)
    assert all(x.again == x.root and (x.bent == x.root) == (x.forged in (None, x.leaf)) for x in found)


def test_manifest_of_one_and_of_none(spark):
    from quoin.llm.merkle import manifest

    schema = "doc_id long, source string, lang string, n_chars long, text string"
    (only,) = manifest(spark.createDataFrame([(4, "a", "b", 1, "c")], schema)).collect()
    assert only.leaf == only.subroot == only.root == leaf_of((4, "a", "b", 1, "c")) and only.path == []
    assert manifest(spark.createDataFrame([], schema)).count() == 0


def pages():
    rows = [(i, f"http://h/{i}", f"<p>{'x' * (i % 40)} {i % 60}") for i in range(300)]
    rows += [(1000 + i, "http://copy", "same") for i in range(200)]
    return rows + [(None, "u\nx", "same"), (None, None, None), (2000, None, ""), (2001, "é", "same"), (2001, "é", "same"), (2002, "big", "q" * (17 << 20)), (2003, "r", "\r\n\r\nWARC/1.1\r\n")]


def plain_archive(rows, least):
    firsts, out = {}, Counter()
    for i, _, h in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0)):
        data = (h or "").encode()
        first = firsts.setdefault(data, (i,))[0] if len(data) >= least else None
        again = len(data) >= least and firsts[data][-1] == "taken"
        if len(data) >= least:
            firsts[data] = (first, "taken")
        out[i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first if again else None] += 1
    return out


@pytest.mark.parametrize("least,split", [(0, 3000), (5, 1 << 20)])
def test_warc(spark, least, split):
    from quoin.llm.warc import payloads, read_warc, round_trip

    rows = pages()
    df = spark.createDataFrame([(*x, 1) for x in rows], "page_id long, url string, html string, start int").repartition(4)
    path = f"file://{tempfile.mkdtemp(prefix='spark-')}/archive"
    got = round_trip(df, path=path, split=split, least=least).collect()
    assert Counter((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in got) == plain_archive(rows, least)
    assert all(x.sound for x in got)
    index = read_warc(spark, path, split=split)
    kept = {x.record_id: x.payload for x in payloads(index).collect()}
    for x in index.where("record_type = 'response'").collect():
        assert base64.b32encode(hashlib.sha1(kept[x.record_id]).digest()).decode() == x.payload_digest


def test_warc_of_no_rows(spark):
    from quoin.llm.warc import round_trip

    assert round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_nested_and_damaged_records(spark):
    """A record kept inside another one's payload is no record of the archive, wherever ranges are cut;
    bytes that can't be decoded are told."""
    from quoin.llm.warc import member, read_warc, record

    plain = lambda n, data: record({"WARC-Type": "resource", "WARC-Record-ID": f"<urn:x:{n}>"}, data)
    inner = b"".join(member(plain(f"inner{k}", os.urandom(300))) for k in range(20))  # bytes that don't compress: kept as they are
    stored = zlib.compressobj(0, zlib.DEFLATED, 31)
    outer = stored.compress(plain("outer", inner)) + stored.flush()
    first, last = member(plain("first", b"a" * 1000)), member(plain("last", b"\x1f\x8b\x08" * 50))
    assert outer.count(b"\x1f\x8b\x08") > 20
    folder = tempfile.mkdtemp(prefix="spark-")
    with open(f"{folder}/a.warc.gz", "wb") as f:
        f.write(first + outer + member(b"") + last)
    broken = bytearray(first + last + first)
    broken[len(first) + 30] ^= 255
    with open(f"{folder}/b.warc.gz", "wb") as f:
        f.write(broken + b"tail")
    open(f"{folder}/c.warc.gz", "wb").close()
    for split in (100, 1000, 1 << 20):
        found = read_warc(spark, folder, split=split).collect()
        a = [(x.start, x.record_id) for x in found if x.path.endswith("a.warc.gz")]
        assert sorted(a) == [(0, "<urn:x:first>"), (len(first), "<urn:x:outer>"), (len(first) + len(outer) + len(member(b"")), "<urn:x:last>")]
        b = sorted((x.start, x.end, x.record_type) for x in found if x.path.endswith("b.warc.gz"))
        n, m = len(first), len(last)
        assert b == [(0, n, "resource"), (n, n + m, "damaged"), (n + m, n + m + n, "resource"), (n + m + n, len(broken) + 4, "damaged")]


def test_repeats_of_rows_that_share_an_id(spark):
    """A thousand rows without an id cost what rows with own ids cost, and give the same."""
    import time

    from quoin.llm.substrings import remove_repeats

    r = random.Random(8)
    vocab = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(500):  # pairs that share 60 words
        same = [r.choice(vocab) for _ in range(60)]
        texts += [" ".join([r.choice(vocab) for _ in range(46)] + same + [r.choice(vocab) for _ in range(46)]) for _ in range(2)]
    frame = lambda ids: spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(4)
    told = lambda df: Counter((x.n_words, x.n_removed, x.kept_sha256) for x in df.collect())
    want = told(remove_repeats(frame(range(1000))))
    began = time.time()
    assert told(remove_repeats(frame([None] * 1000))) == want and all(n == 60 for _, n, _ in want)
    assert told(remove_repeats(frame([7] * 1000))) == want
    assert time.time() - began < 60


def plain_hits(items, text, width=13):
    from quoin.llm.decontaminate import fold

    words, hit, found = fold(text.encode()).split(), set(), set()
    for i, t in items:
        own = fold((t or "").encode()).split()
        n = min(width, len(own))
        wins = {tuple(own[s : s + n]) for s in range(len(own) - n + 1)} if own else set()
        for s in range(len(words) - n + 1) if own else ():
            if tuple(words[s : s + n]) in wins:
                hit |= set(range(s, s + n))
                found.add(i)
    return hit, found


def test_anchors_that_many_items_share():
    """An opening phrase of 20,000 items doesn't multiply the work, and hits are those of a plain search."""
    import time

    from quoin.llm.decontaminate import Scanner

    r = random.Random(5)
    opening = "which of the following statements is most".split()
    say = lambda n: [f"w{r.randrange(50)}" for _ in range(n)]
    items = [(f"i{k}", " ".join(opening + say(r.choice([3, 6, 20])) + opening * (k % 3) + say(9))) for k in range(60)]
    items += [("short", " ".join(opening)), ("short again", " ".join(opening)), ("same", "a " * 800), ("none", None)] + [(f"copy{k}", items[0][1]) for k in range(20)]
    texts = [" ".join(say(30) + items[k][1].split()[3:] + opening + say(4)) for k in range(40)] + [" ".join(opening * 30), "a " * 4000, " ".join(opening + say(6) + opening), "which of", items[0][1]]
    scanner = Scanner(items)
    for text in texts:
        n, spans, found, _ = scanner.scan(text.encode())
        hit, want = plain_hits(items, text)
        assert {i for s, e in zip(spans[::2], spans[1::2]) for i in range(s, e)} == hit and set(found) == want and n == len(text.split())
    many = Scanner([(f"i{k}", " ".join(opening + [f"x{k}"] + say(20))) for k in range(20000)])
    began = time.time()
    many.scan(" ".join((opening + say(1)) * 200).encode())
    Scanner([("same", "a " * 800)]).scan(b"a " * 16000)
    assert time.time() - began < 1.5
