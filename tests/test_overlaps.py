"""Requests against phrases as a join of sets, against one request at a time."""

import random
from collections import Counter

import pytest

from weftline.operators import experience, overlaps

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa common common common".split()


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(9)
    say = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 7)))
    phrases = [(f"p{rng.randrange(8)}", say(), rng.choice(["read_but_abandoned", "shown_not_read"])) for _ in range(150)] + [("p1", None, "x"), ("p1", "", "x"), ("p2", "the of a", "x"), (None, "alpha beta", "x")]
    requests = [(k, say()) for k in range(25)] + [(90, None), (91, "the"), (92, "alpha beta"), (92, "alpha beta")]
    return spark.createDataFrame(requests[:-1], "request_id int, query string"), spark.createDataFrame(phrases, "path string, phrase string, reason string")


def test_all_requests_at_once(spark, tables):
    requests, phrases = tables
    shown = lambda df: Counter(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    one = lambda f: sum((Counter((r["request_id"], *k) for k in shown(f(r["query"])).elements()) for r in requests.where("query is not null").collect()), Counter())
    assert shown(overlaps.query_history(requests, phrases)) == one(lambda q: experience.query_history(phrases, q).select("path", "n", "score"))
    assert shown(overlaps.usage_matches(requests, phrases)) == one(lambda q: experience.usage_matches(phrases, q).select("path", "n", "score"))
    assert shown(overlaps.anti_penalty(requests, phrases)) == one(lambda q: experience.anti_penalty(phrases, q).select("path", "penalty"))


def test_pairs_are_found_once_and_all(spark):
    rng = random.Random(1)
    sets = list({tuple(sorted(rng.sample("abcdefghijkl", rng.randrange(1, 9)))) for _ in range(120)})
    df = spark.createDataFrame([(list(s),) for s in sets], "words array<string>")
    for least in (0.3, 0.5, 2 / 3, 1.0):
        got = Counter((tuple(r["left"]), tuple(r["right"])) for r in overlaps.similar_sets(df, df, least).collect())
        assert got == Counter((a, b) for a in sets for b in sets if len({*a} & {*b}) / max(len(a), len(b)) >= least)
    assert overlaps.similar_sets(df.limit(0), df, 0.5).count() == 0
    plan = overlaps.similar_sets(df, df, 0.5)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    with pytest.raises(ValueError):
        overlaps.similar_sets(df, df, 0)


def test_frequencies_that_are_not_broadcast(spark, tables, monkeypatch):
    requests, phrases = tables
    want = Counter(map(tuple, overlaps.query_history(requests, phrases).collect()))
    monkeypatch.setattr(overlaps, "FEW", 0)
    assert Counter(map(tuple, overlaps.query_history(requests, phrases).collect())) == want
