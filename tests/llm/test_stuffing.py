import random

import pandas as pd

from quern.llm import stuffing as P

SUBJECT = ["The scan", "A reader", "The store", "The index", "Our team"]
VERB = ["handled the batch on", "must not depend on", "will be confused by", "came back after", "is slower than"]
OBJECT = ["the old records", "a second import", "the empty scopes", "some late arrivals", "the new window"]
SHOP = ["cheap", "deal", "price", "shop", "token", "plugin", "best", "sale", "kit", "buy", "online", "review", "coupon", "bundle"]


def corpus():
    rng = random.Random(1)
    prose = [" ".join(f"{rng.choice(SUBJECT)} {rng.choice(VERB)} {rng.choice(OBJECT)}." for _ in range(12)) for _ in range(300)]
    # Familiar words: prose uses those of the salad too, where they make sense.
    prose += [" ".join(f"The {w} is a {rng.choice(['weak spot', 'new part', 'late arrival'])}, said {rng.choice(SUBJECT)}." for w in rng.sample(SHOP, 9)) for _ in range(150)]
    salad = [" ".join(rng.choice(SHOP) for _ in range(80)) for _ in range(6)]
    loops = ["cheap token kit, best token kit, " * 30, "Why cheap kit? Because cheap kit gives cheap kit for every cheap kit fan. " * 12]
    links = ["\n".join(f"* cheap kit: https://h{i}.example/kit/deal" for i in range(30)), " ".join(f"#best{w}Kit{i}" for i, w in enumerate(SHOP * 3))]
    lists = ["\n".join(f"- The {w} is slower than the new window, see https://h.example/{i}" for i, w in enumerate(SHOP))]
    return prose + lists, salad + loops + links


def test_spam_is_told_from_prose(spark):
    good, bad = corpus()
    rows = [(i, t) for i, t in enumerate(good)] + [(10_000 + i, t) for i, t in enumerate(bad)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id for r in P.stuffed(P.features(df)).collect()} == {10_000 + i for i in range(len(bad))}


def test_counts_don_t_depend_on_blocks(spark):
    good, bad = corpus()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id bigint, text string")
    one = {r.doc_id: tuple(r) for r in P.features(df.coalesce(1)).collect()}
    many = {r.doc_id: tuple(r) for r in P.features(df.repartition(9)).collect()}
    assert [len(k) for k, _ in P._filled([pd.DataFrame({"k": range(9_000), "t": ["x"] * 9_000})])] == [4_000, 4_000, 1_000]
    assert one.keys() == many.keys()
    for k in one:
        assert all(abs(a - b) < 1e-9 for a, b in zip(one[k], many[k]))


def test_mean_information_is_that_of_plain_counts(monkeypatch):
    import math

    monkeypatch.setattr(P, "LEAST_SEEN", 0)
    docs = ["a b c a b", "a b d", "c a b e"]
    block = P.Block.of(docs)
    n = block.counts().sort_values("key")
    of = lambda what: (n["key"][n["what"] == what].to_numpy(), n["n"][n["what"] == what].to_numpy())
    got = block.features(of(P.PAIR), of(P.IS_WORD), 12.0)["mean_npmi"]
    words = [d.split() for d in docs]
    uni = {w: sum(d.count(w) for d in words) for d in words for w in d}
    total = sum(uni.values())
    assert total == 12
    pairs = [list(zip(d, d[1:])) for d in words]
    for i, own in enumerate(pairs):
        info = []
        for x in own:
            n = sum(p.count(x) for p in pairs) - own.count(x)
            info.append(max(-1.0, min(1.0, math.log(n * total / (uni[x[0]] * uni[x[1]])) / -math.log(n / total))) if n else -1.0)
        assert abs(got[i] - sum(info) / len(info)) < 1e-9


def test_verdicts_stay_as_the_corpus_grows(spark):
    good, bad = corpus()
    page, rest = bad[0], good + bad[1:]

    def lift(others):
        df = spark.createDataFrame(list(enumerate([page, good[0], *others])), "doc_id bigint, text string")
        return {r.doc_id: r.lift for r in P.features(df).collect() if r.doc_id < 2}

    one, two = lift(rest), lift(rest + rest)
    # Only the pages' own words don't double.
    assert all(abs(one[k] - two[k]) < 0.05 for k in one)


def test_a_rare_language_isnt_spam(spark):
    good, bad = corpus()
    rng = random.Random(3)
    who, does, what = ["Il lettore", "La scheda", "Il gruppo"], ["resta più lento del", "non dipende dal", "segue sempre il"], ["vecchio archivio", "nuovo ciclo", "primo carico"]
    rare = [" ".join(f"{rng.choice(who)} {rng.choice(does)} {rng.choice(what)}." for _ in range(8)) for _ in range(12)]
    single = "Tylko jedna strona w tym języku mówi o zapisie danych i o tym, jak długo trwa odczyt"
    df = spark.createDataFrame(list(enumerate(rare + [single] + good + bad)), "doc_id bigint, text string")
    assert {r.doc_id for r in P.stuffed(P.features(df)).collect()} == set(range(13 + len(good), 13 + len(good + bad)))


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "word"), (4, "  \n"), (3, "word"), (None, "x y z"), (5, "same words again " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS n_words", "2 AS block")
    got = P.features(df).collect()
    assert sorted((r.doc_id or 0, r.n_words) for r in got) == [(0, 3), (1, 0), (2, 0), (3, 1), (3, 1), (4, 0), (5, 150_000)]
    assert P.features(df.limit(0)).count() == 0
    assert P.features(df.filter("text IS NULL")).count() == 1
    assert P.stuffed(P.features(df.limit(0))).count() == 0
    # The order of words can't be judged here.
    assert [r.doc_id for r in P.stuffed(P.features(df)).collect()] == [5]
    share = spark.createDataFrame([(7, "same key")] * 30, "doc_id bigint, text string")
    assert P.features(share).count() == 30
