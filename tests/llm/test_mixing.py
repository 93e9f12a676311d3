"""Budgets and prefixes against plain Python, on a table with ties, nulls and weights of zero."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from docstrata.llm.mixing import LEVELS, mix

SCHEMA = "doc_id long, text string, lang string, source string, h long, epochs long, taken string"


def shares(parent, children):
    """Whole tokens for {name: (capacity, weight)}: fill the small, share the rest, largest fractions first."""
    out, left, open_ = {}, parent, dict(children)
    while open_:
        total = sum(w for _, w in open_.values())
        rate = left / total
        full = sorted((c / w, k) for k, (c, w) in open_.items() if c / w <= rate)
        if not full:
            break
        k = full[0][1]
        out[k] = open_.pop(k)[0]
        left -= out[k]
    exact = {k: left / sum(w for _, w in open_.values()) * w for k, (_, w) in open_.items()}
    out |= {k: int(x) for k, x in exact.items()}
    spare = min(parent, sum(c for c, _ in children.values())) - sum(out.values())
    for k in sorted(exact, key=lambda k: (int(exact[k]) - exact[k], k))[:spare]:
        out[k] += 1
    return out


def plan(rows, weights, budget, epochs):
    """{leaf: budget} of rows (leaf, tokens)."""
    weigh = lambda level, name: weights.get(LEVELS[level], {}).get(name, 1.0)
    supply = Counter()
    for leaf, n in rows:
        if all(weigh(k, x) > 0 for k, x in enumerate(leaf)):
            supply[leaf] += n
    given = {(): min(budget, epochs * sum(supply.values()))}
    for depth in range(3):
        below = {}
        for node, b in given.items():
            room = Counter()
            for leaf, n in supply.items():
                if leaf[:depth] == node:
                    room[leaf[: depth + 1]] += n * epochs
            below |= shares(b, {k: (c, weigh(depth, k[-1])) for k, c in room.items()})
        given = below
    return given, supply


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(8)
    rows = [(k, "w " * rng.choice([0, 1, 3, 10, 40, 300]), rng.choice(["en", "de", "fr", None]), rng.choice(["src0", "src1", "src2", "odd", None]), 1, 2, "x") for k in range(400)]
    rows += [(7, "same text here", "en", "src1", 1, 2, "x")] * 30 + [(None, "no id", "en", "src0", None, None, None)] * 12 + [(900, None, "zz", "src3", 1, 1, "x")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("budget", [0, 1, 777, 5_003, 20_011, 10**9])
def test_every_leaf_takes_its_budget_to_the_token(docs, budget):
    weights = {"domain": {"tier0": 5.0, "tier2": 0.0, "other": 0.3}, "lang": {"en": 2.0, "de": 1.0, "zz": 3.0}, "source": {"odd": 0.5}}
    tier = {"src0": "tier0", "src1": "tier1", "src2": "tier2", "src3": "tier3"}
    held = [((tier.get(r.source, "other"), r.lang or "(null)", r.source or "(null)"), len((r.text or "").split())) for r in docs.collect()]
    want, supply = plan(held, weights, budget, 3)
    rows = mix(docs, weights=weights, budget=budget, max_epochs=3, seed=1).collect()
    got, partial = Counter(), defaultdict(list)
    for r in rows:
        assert 0 <= r.taken <= r.n_tokens
        got[r.domain, r.lang, r.source] += r.taken
        if r.taken < r.n_tokens:
            partial[r.domain, r.lang, r.source].append(r)
    assert {k: n for k, n in got.items() if n} == {k: n for k, n in want.items() if n}
    assert sum(got.values()) == min(budget, 3 * sum(supply.values()))
    assert all(len(v) == 1 for v in partial.values())  # only the last document of a leaf is cut
    # The rows of an epoch are a prefix of one order: whole epochs hold every row of the leaf.
    for leaf, n in want.items():
        times = Counter(r.epoch for r in rows if (r.domain, r.lang, r.source) == leaf and r.taken == r.n_tokens)
        size = sum(1 for x, _ in held if x == leaf)
        assert all(times[e] == size for e in range(n // supply[leaf] if supply[leaf] else 0))


def test_order_is_seeded_and_repeats_follow_each_other(docs):
    a, b, c = (sorted(map(str, mix(docs, budget=3_000, seed=s).collect())) for s in (1, 1, 2))
    assert a == b != c
    same = mix(docs.where("doc_id = 7 and source = 'src1'"), budget=50, weights={}).collect()
    assert sorted(r.taken for r in same) == [2, *[3] * 16]


def test_kept_columns_come_back_whole(docs):
    rows = mix(docs, budget=3_000, keep=docs.columns)
    assert rows.columns == docs.columns
    taken = Counter(r.doc_id for r in mix(docs, budget=3_000).collect())
    assert set(taken) <= set(r.doc_id for r in rows.collect())
    assert rows.agg(F.count("*")).first()[0] >= sum(taken.values())
