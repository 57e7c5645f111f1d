"""Problem 9: mixing sources to target weights."""

import itertools
import random

from hypothesis import given, settings
from hypothesis import strategies as st

import loamline.llm.mixing as mixing
from loamline.llm.mixing import TOKENIZER, encoder, fill, knapsack, mix


@given(st.lists(st.tuples(st.integers(1, 9), st.integers(0, 3)), min_size=1, max_size=4), st.integers(0, 40))
@settings(max_examples=150, deadline=None)
def test_knapsack_is_optimal(stock, budget):
    lengths, counts = [x for x, _ in stock], [n for _, n in stock]
    take = knapsack(lengths, counts, budget)
    assert all(0 <= t <= n for t, n in zip(take, counts, strict=True))
    best = max(s for c in itertools.product(*(range(n + 1) for n in counts)) if (s := sum(a * b for a, b in zip(c, lengths, strict=True))) <= budget)
    assert sum(a * b for a, b in zip(take, lengths, strict=True)) == best


@given(st.lists(st.tuples(st.integers(1, 3000), st.integers(1, 400)), min_size=5, max_size=60), st.floats(0, 1.2))
@settings(max_examples=60, deadline=None)
def test_fill_stays_within_stock_and_budget(stock, share):
    lengths, counts = [x for x, _ in stock], [n for _, n in stock]
    total = sum(x * n for x, n in stock)
    take = fill(lengths, counts, int(total * share))
    used = sum(x * t for x, t in zip(lengths, take, strict=True))
    assert all(0 <= t <= n for t, n in zip(take, counts, strict=True)) and used <= max(int(total * share), 0)
    assert used >= min(int(total * share), total) - max(lengths)


def test_fill_goes_on_with_shorter_documents():
    assert fill([1, 3_000_000], [400_000, 5], 1_000_000) == [400_000, 0]
    lengths, counts = [2, 5, 4_000_000], [300_000, 300_000, 9]
    assert sum(x * t for x, t in zip(lengths, fill(lengths, counts, 1_999_999), strict=True)) == 1_999_999


def test_fill_equals_an_exact_search():
    """Random stocks of long documents, where proportion and greed go wrong."""
    rnd = random.Random(1)
    for _ in range(1000):
        stock = {rnd.randrange(1, 300_001) if rnd.random() < 0.8 else rnd.randrange(1, 300) * 1000: rnd.randrange(1, 5) for _ in range(rnd.randrange(1, 6))}
        lengths, counts = sorted(stock), [stock[x] for x in sorted(stock)]
        budget = int(sum(x * n for x, n in stock.items()) * rnd.random())
        sums = {0}
        for x, n in stock.items():
            sums = {s + k * x for s in sums for k in range(n + 1) if s + k * x <= budget}
        take = fill(lengths, counts, budget)
        assert all(0 <= t <= n for t, n in zip(take, counts, strict=True))
        assert sum(x * t for x, t in zip(lengths, take, strict=True)) == max(sums), (lengths, counts, budget)


def test_knapsack_in_blocks(monkeypatch):
    monkeypatch.setattr(mixing, "HELD_BITS", 1)
    for budget in (0, 5, 99, 1234):
        take = knapsack([7, 30, 12, 95], [3, 4, 2, 9], budget)
        monkeypatch.undo()
        best = knapsack([7, 30, 12, 95], [3, 4, 2, 9], budget)
        monkeypatch.setattr(mixing, "HELD_BITS", 1)
        assert sum(a * b for a, b in zip(take, [7, 30, 12, 95], strict=True)) == sum(a * b for a, b in zip(best, [7, 30, 12, 95], strict=True))


DOCS = "doc_id long, text string, source string, tokens string, n int"
TARGETS = "source string, target_share double, max_repeats int"


def corpus(spark):
    rows = [(i, "soil moisture " * (1 + i % 17), ("big", "big", "big", "small")[i % 4], "clash", 1) for i in range(400)]
    rows += [(1000, None, "big", "x", 1), (1001, "words", None, "x", 1), (1002, "words", "unlisted", "x", 1), (1003, "", "small", "x", 1), (None, "words", "big", "x", 1), rows[0]]
    return spark.createDataFrame(rows, DOCS)


def test_mix_and_report(spark):
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 3), ("absent", 0.1, 5), (None, 0.3, 1)], TARGETS)
    mixed, report = mix(corpus(spark), targets, total_tokens=6000)
    rows, by = mixed.collect(), {r.source: r for r in report.collect()}
    assert len({r.doc_id for r in rows}) == len(rows) and all(r.copies >= 1 for r in rows)
    for s, most in (("big", 1), ("small", 3)):
        used = sum(r.tokens * r.copies for r in rows if r.source == s)
        assert used == by[s].tokens_mixed <= by[s].tokens_wanted and max(r.copies for r in rows if r.source == s) <= most
    assert by["big"].tokens_mixed == 3000 and by["big"].met and by["small"].met == (by["small"].tokens_available * 3 >= 2400 * 0.999)
    assert not by["absent"].met and by["absent"].tokens_mixed == 0 and set(by) == {"big", "small", "absent"}


def test_balanced(spark):
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 2), ("absent", 0.1, 5)], TARGETS)
    rows = {r.source: r for r in mix(corpus(spark), targets, balanced=True)[1].collect()}
    assert abs(rows["big"].actual_share - 5 / 9) < 0.01 and abs(rows["small"].actual_share - 4 / 9) < 0.01 and rows["absent"].tokens_mixed == 0
    assert rows["small"].tokens_mixed >= 2 * rows["small"].tokens_available - 40  # the scarcer source is used up


def test_targets_out_of_reach(spark):
    mixed, report = mix(corpus(spark), spark.createDataFrame([("small", 1.0, 2)], TARGETS), total_tokens=10**9)
    (r,) = report.collect()
    assert r.tokens_mixed == 2 * r.tokens_available and not r.met and r.actual_share == 1.0
    assert {x.copies for x in mixed.collect()} == {2}


def test_selection_is_seeded_and_salted(spark, monkeypatch):
    targets = spark.createDataFrame([("big", 0.3, 1)], TARGETS)
    a = {r.doc_id for r in mix(corpus(spark), targets, 2000, seed=1)[0].collect()}
    assert a == {r.doc_id for r in mix(corpus(spark), targets, 2000, seed=1)[0].collect()}
    assert a != {r.doc_id for r in mix(corpus(spark), targets, 2000, seed=2)[0].collect()}
    monkeypatch.setattr(mixing, "RANKED_AT_ONCE", 3)
    cut = mix(corpus(spark), targets, 2000, seed=1)
    assert sum(r.tokens * r.copies for r in cut[0].collect()) == cut[1].collect()[0].tokens_mixed


def test_no_target_is_left_out(spark):
    targets = spark.range(200_000).selectExpr("concat('s', id) AS source", "1 / 200000 AS target_share", "1 AS max_repeats")
    docs = spark.range(60).selectExpr("id AS doc_id", "'soil moisture' AS text", "concat('s', id * 3333) AS source")
    report = mix(docs, targets, total_tokens=10**9)[1]
    assert report.count() == 200_000 and report.where("tokens_mixed > 0").count() == 60


def test_empty(spark):
    targets = spark.createDataFrame([("big", 1.0, 1)], TARGETS)
    mixed, report = mix(corpus(spark).limit(0), targets)
    assert mixed.count() == 0 and [r.tokens_mixed for r in report.collect()] == [0]
    assert mix(corpus(spark), targets.limit(0))[0].count() == 0


def test_tokenizer_round_trip():
    e = encoder(open(TOKENIZER, "rb").read())
    for text in ("Größe é 漢字 <|endoftext|> \n\n  x", "", "a" * 10_000):
        assert e.decode(e.encode_ordinary(text)) == text
