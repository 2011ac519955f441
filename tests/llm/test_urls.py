"""URL models over all ruled URLs, each counted once."""

import math
import random

from pyspark.sql import functions as F

from lakeward.llm import urlfilter


def urls_of(n):
    rng = random.Random(1)
    name = lambda letters: "".join(rng.choices(letters, k=9))
    return [f"http://{name('abcdefg')}.com/{i}" for i in range(n)] + [f"http://{name('tuvwxyz')}.net/{'es' if i % 2 else 'fr'}/{i}" for i in range(n)]


def pages(spark, urls):
    return spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")


def test_models_count_every_ruled_url(spark):
    urls = urls_of(6000)
    classifier = urlfilter.train(urlfilter.ruled(pages(spark, urls)))
    held = {r.url for r in pages(spark, urls).where(f"pmod(xxhash64(url), {urlfilter.HELD}) = 0").collect()}
    for model, kind in zip(classifier.shared.value, (urls[:6000], urls[6000:]), strict=True):
        want = urlfilter.MarkovModel([u for u in kind if u not in held])
        assert all((a == b).all() for got, brute in zip(model.orders, want.orders, strict=True) for a, b in zip(got, brute, strict=True))
    assert classifier.held_out_accuracy > 0.99


def test_copies_of_a_url_change_nothing(spark):
    urls, asked = urls_of(60), ["http://abcabc.org/", "http://xyzxyz.org/", None]
    judged = lambda some: {(r.verdict, r.score) for r in urlfilter.judge(spark, pages(spark, some)).where("rule is null").collect()}
    once = judged(urls + asked)
    assert len(once) == 3 and judged(urls * 200 + asked) == once


def test_null_long_and_repeated_urls(spark, monkeypatch):
    urls = urls_of(80) + [None, None, "", "x" * 3_000_000, "http://h.org/" + "y" * 500_000, "http://h.org/z"] * 2
    got = {r.page_id: r for r in urlfilter.judge(spark, pages(spark, urls)).collect()}
    assert len(got) == len(urls) and all(r.verdict in ("allow", "block") for r in got.values())
    assert all((r.score is None) == (r.rule is not None) for r in got.values())
    assert [got[i].score for i in range(160, 166)] == [got[i].score for i in range(166, 172)] and got[160].score == got[162].score
    monkeypatch.setattr(urlfilter, "BATCH_BYTES", 50)
    classifier = urlfilter.train(urlfilter.ruled(pages(spark, urls)))
    asked = pages(spark, [u for u in urls[150:] if u is not None and len(u) < 100])
    alone = {r.page_id: urlfilter.scores(classifier.shared.value, [r.url])[0] for r in asked.collect()}
    found = asked.select("page_id", urlfilter.scored_by(classifier.shared, F.col("url")).alias("s")).collect()
    assert all(abs(r.s - alone[r.page_id]) < 1e-12 for r in found)


def plain_model(urls):
    """Probability of a symbol behind a context, by the recursive definition."""
    spots = [("\0" * 5 + u + "\x01", i + 5) for u in urls for i in range(len(u) + 1)]

    def p(context, c):
        behind = [s[i] for s, i in spots if s[i - len(context) : i] == context]
        lower, kinds = p(context[1:], c) if context else 1 / 256, len(set(behind))
        return (behind.count(c) + kinds * lower) / (len(behind) + kinds) if behind else lower

    return p


def test_models_follow_their_definition():
    urls = ["http://a.com/x", "http://ab.com/xy", "ftp://q"]
    model, p = urlfilter.MarkovModel(urls), plain_model(urls)
    for u in ("http://a.com/q", "fxy"):
        s = u + "\x01"
        symbols, before, _ = urlfilter.contexts([u])
        want = [math.log(p(("\0" * 5 + s[:i])[-5:], c)) for i, c in enumerate(s)]
        assert all(abs(a - b) < 1e-9 for a, b in zip(model.log_likelihood(symbols, before).tolist(), want, strict=True))
