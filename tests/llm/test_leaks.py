"""Decontamination of documents shorter than an item, and of benchmarks in several parts."""

import re

import numpy as np

from lakeward.llm import decontamination

from .edge import documents, words


def exact_leaks(rows, items):
    """Similarity of each document and item by all windows of the item's size, or by the whole text where the item is longer."""
    low = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    shingles = lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    sets = [(i, len(low(t)), shingles(low(t))) for i, t in items]
    weight = lambda s: np.log1p(len(items) / max(1, sum(s in own for _, _, own in sets)))
    out = {}
    for d, t, _ in rows:
        w = low(t)
        held = shingles(w)
        for i, size, own in sets:
            if size >= 5 and not own & held:
                continue  # no window has a shingle of the item
            for a in range(max(0, len(w) - size) + 1):
                win = shingles(w[a : a + size])
                like = sum(weight(s) for s in own & win) / sum(weight(s) for s in own | win)
                if like >= decontamination.SIMILAR:
                    out[d, i] = max(out.get((d, i), 0), round(like, 9))
    return out


def found(spark, rows, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in decontamination.find_leaks(documents(spark, rows), bench).collect()}, bench


def test_documents_shorter_than_an_item(spark):
    items = [(1, words(39)), (2, words(39, 100)), (3, words(6, 300)), (4, "three word item")]
    edited = words(39, 100).split()
    del edited[20]
    rows = [(1, words(38), "s"), (2, words(36, 2), "s"), (3, " ".join(edited), "s"), (4, words(20), "s"), (5, words(5, 300), "s"), (6, "three word", "s"), (7, words(4), "s")]
    got, bench = found(spark, rows, items)
    assert {k: round(r.similarity, 9) for k, r in got.items()} == exact_leaks(rows, items)
    assert (got[1, 1].start_word, got[1, 1].n_words) == (0, 38) and (1, 1) in got and (2, 1) in got and (3, 2) in got
    assert {r.doc_id for r in decontamination.decontaminate(documents(spark, rows), bench).collect()} == {d for d, _, _ in rows} - {d for d, _ in got}


def test_weights_count_the_whole_benchmark_in_any_number_of_parts(spark, monkeypatch):
    common = words(12)
    items = [(i, f"{common} {words(12, 1000 * i)}") for i in range(1, 9)] + [(9, "three word item")]
    rows = [(i, f"{common} {words(12, 1000 * i)}".replace(f"word{i % 3} ", "other ", 1), "s") for i in range(1, 9)] + [(20, items[2][1], "s")]
    whole, _ = found(spark, rows, items)
    monkeypatch.setattr(decontamination.item_parts, "__defaults__", (2,))
    got, bench = found(spark, rows, items)
    assert len(list(decontamination.item_parts(bench))) == 5
    like = {k: round(r.similarity, 9) for k, r in got.items()}
    assert like == {k: round(r.similarity, 9) for k, r in whole.items()} == exact_leaks(rows, items)
    assert {k: r.distance for k, r in got.items()} == {k: r.distance for k, r in whole.items()}
    assert (20, 3) in got and len(got) > 1
    assert {r.doc_id for r in decontamination.decontaminate(documents(spark, rows), bench).collect()} == {d for d, _, _ in rows} - {d for d, _ in got}


def test_multi_index_finds_all_within_the_radius():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 256, (300, 8)).astype(np.uint8)
    asked = base[:200].copy()
    for i, row in enumerate(asked):  # i % 33 bits away
        for bit in rng.choice(64, i % 33, replace=False):
            row[bit // 8] ^= np.uint8(1 << (bit % 8))
    index = decontamination.HammingIndex(base)
    got = set(zip(*(x.tolist() for x in index.near(asked)), strict=True))
    distance = np.bitwise_count(asked[:, None, :] ^ base[None, :, :]).sum(axis=2)
    want = {(i, j, int(distance[i, j])) for i, j in zip(*np.nonzero(distance <= decontamination.RADIUS), strict=True)}
    assert got == want and len(want) > 100
    assert all(len(x) == 0 for x in decontamination.HammingIndex(base[:0]).near(asked[:0]))


def test_recall_over_all_windows_of_larger_tables(spark):
    """Against every window by exact similarity, on documents of sf0.01."""
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    rows, items = [(r.doc_id, r.text, "") for r in docs.where("length(text) < 4000").collect()], [(r.item_id, r.text) for r in bench.collect()]
    want = set(exact_leaks(rows, items))
    got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(documents(spark, rows), bench).collect()}
    assert got <= want and len(got) >= 0.9 * len(want) and want
