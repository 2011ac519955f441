"""Rows of the mix."""

from lakeward.llm import mixing

from .edge import documents, words


def test_repeated_rows_without_words_stay(spark):
    rows = [(1, None, "a"), (1, None, "a"), (1, "", "a"), (None, " ", "a"), (None, None, "a"), (None, "", None), (None, "", None), (1, words(7), "a"), (1, words(7), "a"), (2, words(40), None)]
    got = mixing.mix(spark, documents(spark, rows)).collect()
    assert sorted((r.doc_id, r.source, r.size) for r in got if r.doc_id is not None and r.source) == [(1, "a", 0)] * 3 + [(1, "a", 7)] * 2
    assert len(got) == len(rows) and all(r.taken == 0 for r in got if not r.size)


def test_every_source_meets_its_target(spark):
    rows = [(i, words(n), f"s{i}") for i, n in enumerate((100, 300, 600, 1100, 1500, 1, 0, 2047, 2048, 2049))] + [(100 + i, words(997, i), "t") for i in range(60)] + [(None, words(31), "t")] * 40
    for block in (7, 1024):
        got = mixing.mix(spark, documents(spark, rows), block=block).collect()
        assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in got)
        by = {}
        for r in got:
            x = by.setdefault(r.source, [r.target, 0])
            x[1] += r.taken
        assert all(abs(t - n) <= 0.5 for t, n in by.values()) and by["s0"][1] == 300


def test_the_schedule_interleaves_sources(spark):
    goals = mixing.quotas(spark.createDataFrame([("a", 1, 40_960, 40_960.0), ("b", 2, 40_960, 81_920.0)], "source string, nth int, source_size long, target double"))
    slots = sorted((r.slot, r.nth) for r in mixing.schedule(spark, goals, 120).collect())
    assert [n for _, n in slots].count(1) == 40 and len(slots) == 120
    assert all(2 <= [n for _, n in slots[i : i + 12]].count(1) <= 6 for i in range(0, 108))


def test_edge_rows(spark):
    from .edge import EDGE

    docs = documents(spark, EDGE)
    assert mixing.mix(spark, docs).count() == len(EDGE)
    out = mixing.take(spark, docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} <= {d for d, _, _ in EDGE}
    assert mixing.take(spark, docs.limit(0)).count() == 0
    clash = docs.selectExpr("doc_id", "text", "source", "1 as taken_copies", "2 as c0", "3 as taken_id", "4 as at")
    assert mixing.take(spark, clash).columns == clash.columns and mixing.take(spark, clash).count() == out.count()
