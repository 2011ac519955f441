"""Joins and repeats against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import zstandard

from lakeward.llm import jaccardjoin, suffixdedup

from .edge import EDGE, documents, words

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(rows):
    out = []
    for _, text, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
        out.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    return out


def brute_components(rows):
    sets, parent = sets_of(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    smallest = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            smallest[find(i)] = min(d, smallest.get(find(i), d))
    return sorted(((d, len(sets[i]), smallest.get(find(i))) for i, (d, _, _) in enumerate(rows)), key=str)


def near_copies(seed):
    rng = random.Random(seed)
    rows, d = [], 0
    for size in (4, 6, 9, 11, 14, 20, 60, 200):
        base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(copy))
                rng.choice([lambda: copy.__setitem__(at, "new"), lambda: copy.insert(at, "more"), lambda: copy.append("tail"), lambda: copy.pop(at) if len(copy) > 3 else None])()
            rows.append((d, " ".join(copy), "s"))
            d += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("light", [None, 0, 12])
def test_components_match_brute_force(spark, monkeypatch, light):
    if light is not None:
        monkeypatch.setattr(jaccardjoin, "boundary", lambda heavy: light)
    monkeypatch.setattr(jaccardjoin, "CHUNK", 7)
    rows = near_copies(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccardjoin.join_components(documents(spark, rows)).collect()), key=str)
    assert got == brute_components(rows)


def test_components_of_edge_cases(spark):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccardjoin.join_components(documents(spark, EDGE)).collect()), key=str)
    assert got == brute_components(EDGE)
    assert jaccardjoin.join_components(documents(spark, EDGE).limit(0)).count() == 0


def test_keep_one(spark):
    rows = [*EDGE, (20, "lone text here", "d"), (20, "lone text here", "d")]
    kept = jaccardjoin.keep_one(documents(spark, rows))
    assert kept.columns == documents(spark, EDGE).columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 3, 4, 7, 9, 10, 20]


def test_keep_one_with_any_columns(spark):
    rows = [*EDGE, (20, "lone text here", "d"), (20, "lone text here", "d")]
    odd = documents(spark, rows).selectExpr("node as head", "text", "map('a', array(1.5D, null)) as gone", "current_date() as `block`", "struct(kind, label) as rest", "doc_id", "node as `null`", "node as id")
    kept = jaccardjoin.keep_one(odd)
    assert [(f.name, f.dataType.simpleString()) for f in kept.schema] == [(f.name, f.dataType.simpleString()) for f in odd.schema]
    got = kept.collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == [1, 2, 3, 4, 7, 9, 10, 20]
    assert {r.doc_id: r.text for r in got} == {d: t for d, t, _ in rows if d in (1, 2, 3, 4, 7, 9, 10, 20)}
    assert got[0].gone == {"a": [1.5, None]} and got[0].rest.label == "x"
    empties = documents(spark, [(1, "", "a"), (1, "", "a"), (2, None, "a")])
    assert jaccardjoin.keep_one(empties).count() == 3 and jaccardjoin.keep_one(empties.limit(0)).count() == 0


def brute_repeats(rows):
    first = -(1 << 63)
    order = sorted(rows, key=lambda r: (first if r[0] is None else r[0], hashlib.md5((r[1] or "").encode()).hexdigest()))
    seen, out = set(), []
    for d, text, _ in order:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            piece = data[p : p + 100]
            if piece in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(piece)
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def repeating_texts(seed):
    rng = random.Random(seed)
    pieces = ["".join(rng.choices("abcd é", k=n)) for n in (99, 100, 101, 130, 260, 40)]
    rows = [(i, "".join(rng.choice([*pieces, words(rng.randrange(9), rng.randrange(99))]) for _ in range(rng.randrange(6))), "s") for i in range(60)]
    return [*rows, (60, "ab" * 3000, "s"), (61, rows[5][1], "s"), (61, rows[5][1], "s"), (61, "z" * 150, "s")]


@pytest.mark.parametrize("rows", [EDGE, repeating_texts(1), repeating_texts(2)])
def test_repeats_match_brute_force(spark, rows):
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixdedup.remove_repeats(documents(spark, rows)).collect()), key=str)
    assert got == brute_repeats(rows)


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def hard_texts():
    rng = random.Random(7)
    t = thue_morse(4096)
    near = "".join(rng.choices("xyz ", k=700))
    rows = [(i, near[:350] + str(i) + near[350:], "s") for i in range(130)]  # a large group of near copies
    rows += [(200, t, "s"), (201, t[57:1000] + "c" + t[1000:], "s"), (202, t[::-1], "s"), (203, t[300:399], "s"), (204, t[300:400], "s"), (205, "q" + t[3:103] + "q", "s")]
    rows += [(210 + k, "".join(rng.choices("ab", k=k)) * 30, "s") for k in (1, 2, 7, 12, 13, 14, 56, 57, 58, 100)]  # periods
    rows += [(230 + i, "z" * n, "s") for i, n in enumerate((99, 100, 101, 5000, 5000))]
    rows += [(240 + i, "w" * 88 + "e" * i + "k" * 30, "s") for i in range(14)]  # ends and starts around the chain
    return rows


@pytest.mark.parametrize("bytes_", [suffixdedup.BUCKET_BYTES, 2000])
def test_repeats_of_hard_texts(spark, monkeypatch, bytes_):
    monkeypatch.setattr(suffixdedup, "BUCKET_BYTES", bytes_)
    monkeypatch.setattr(suffixdedup, "BLOCK_BYTES", 30_000)
    rows = hard_texts()
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixdedup.remove_repeats(documents(spark, rows)).collect()), key=str)
    assert got == brute_repeats(rows)


def test_equal_fingerprints_do_not_matter(monkeypatch):
    texts = [t.encode() for _, t, _ in hard_texts()[120:150]]
    lens, data = np.array([len(t) for t in texts]), zstandard.ZstdCompressor().compress(b"".join(texts))

    def removed():
        block = suffixdedup.Block(lens, data)
        samples = suffixdedup.Samples(block, np.concatenate([np.r_[np.ones(max(0, n - 99), bool), np.zeros(min(n, 99), bool)] for n in lens]))
        ranks = [(b, np.unique(np.frombuffer(m, f"V{suffixdedup.PIECE_BYTES}"), return_inverse=True)[1].astype(np.uint32).tobytes()) for b, m in samples.piece_messages(3)]
        numbers = samples.ranks(3, ranks, np.uint32)
        return sorted({i for turn in range(2) for i in samples.records(numbers, 3, (turn, 2)).repeated([]).tolist()})

    want = removed()
    monkeypatch.setattr(suffixdedup, "mixed", lambda columns: np.zeros(len(columns[0]), np.uint64) + (columns[0] & np.uint64(1)))
    assert removed() == want and len(want) > 100
    whole, seen, brute, at = b"".join(texts), set(), [], 0
    for n in lens.tolist():
        for p in range(at, at + n - 99):
            if whole[p : p + 100] in seen:
                brute.append(p)
            seen.add(whole[p : p + 100])
        at += n
    assert want == brute


def around_a_passage(n):
    """Texts that differ around the same passage."""
    rng = random.Random(5)
    passage = "".join(rng.choices("lmno ", k=300))
    return [(i, "".join(rng.choices("abcdefgh ", k=rng.randrange(200, 300))) + passage + "".join(rng.choices("abcdefgh ", k=200)), "s") for i in range(n)]


def test_repeats_do_not_depend_on_grams_with_many_places(spark, monkeypatch):
    monkeypatch.setattr(suffixdedup, "HOT", 4)
    monkeypatch.setattr(suffixdedup, "HOT_IN_BLOCK", 2)
    monkeypatch.setattr(suffixdedup, "BLOCK_BYTES", 6_000)
    rows = [*around_a_passage(40), *[(100 + d, t, s) for d, t, s in repeating_texts(3)]]
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixdedup.remove_repeats(documents(spark, rows)).collect()), key=str)
    assert got == brute_repeats(rows)


def test_ends_of_a_common_passage_do_not_meet_in_one_slice():
    texts = [t.encode() for _, t, _ in around_a_passage(400)]
    block = suffixdedup.Block(np.array([len(t) for t in texts]), np.frombuffer(b"".join(texts), np.uint8))
    plain = suffixdedup.Grams(np.zeros(0, np.uint64))
    places, often = np.unique(plain.of(block.data), return_counts=True)

    def largest(grams):
        stretches = suffixdedup.Stretches(block, grams, 16)
        sent = stretches.choose(list(enumerate(suffixdedup.shared_names([m])[0] for _, m in stretches.names())))
        return max(sum(len(t) for t in sent.texts[a:b]) for a, b in zip(sent.cut, sent.cut[1:], strict=False))

    assert 5 * largest(suffixdedup.Grams(places[often >= 100])) < largest(plain)


def test_suffixes_are_sent_as_text_they_share(spark):
    """Near copies: what is shuffled stays a small multiple of the text."""
    rng = random.Random(11)
    bases = ["".join(rng.choices("abcdefghijklmnop ", k=4000)) for _ in range(50)]
    rows = [(i, b[:k] + str(i) + b[k:], "s") for i, (b, k) in enumerate((rng.choice(bases), rng.randrange(4000)) for _ in range(1000))]
    executors = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False)
    before = executors().apply(0).totalShuffleWrite()
    got = suffixdedup.remove_repeats(documents(spark, rows)).agg({"n_bytes": "sum", "n_removed": "sum"}).first()
    assert got["sum(n_removed)"] > 0.9 * got["sum(n_bytes)"]
    assert executors().apply(0).totalShuffleWrite() - before < 4 * got["sum(n_bytes)"]


def test_no_documents_no_repeats(spark):
    assert suffixdedup.remove_repeats(documents(spark, EDGE).limit(0)).count() == 0
