from __future__ import annotations

from collections import Counter

import pytest

from paceline.llm import mixing


def targets(sizes, weights=(5, 2, 1), most=3):
    """Water filling, source by source."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, capped = float(sum(sizes.values())), set()
    while True:
        free = sum(weight[s] for s in names if s not in capped)
        rest = left - sum(most * sizes[s] for s in capped)
        over = {s for s in names if s not in capped and rest * weight[s] / free > most * sizes[s]}
        if not over:
            return {s: float(most * sizes[s]) if s in capped else rest * weight[s] / free for s in names}
        capped |= over


@pytest.mark.parametrize(
    "sizes",
    [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 500, "c": 900, "d": 3}, {None: 50, "x": 5, "y": 0}, {"a": 0}, {"a": 10, "é": 10, "z": 9}],
)
def test_targets_are_water_filled(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r.source: r.target for r in mixing.source_targets(df).collect()}
    assert found == pytest.approx(targets(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0))


def test_every_source_comes_near_its_target(spark):
    rows = [(i, "w " * (1 + i * 7919 % 300), f"s{min(i % 9, 5)}") for i in range(3000)]
    found = mixing.mix_copies(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, target, most = Counter(), {}, Counter()
    for r in found:
        taken[r.source] += r.copies * r["size"]
        target[r.source] = r.target
        most[r.source] = max(most[r.source], r["size"])
        assert 0 <= r.copies <= 3
    assert len(found) == 3000
    for s in target:
        assert abs(taken[s] - target[s]) <= 3 * most[s]


def test_documents_are_repeated_as_counted(spark, odd):
    counts = Counter()
    for r in mixing.mix_copies(odd).collect():
        counts[r.doc_id] += r.copies
    mixed = mixing.mix_documents(odd)
    assert mixed.columns == odd.columns
    assert Counter(r.doc_id for r in mixed.collect()) == +counts


def test_reruns_agree(spark, odd):
    one, two = (sorted(map(str, mixing.mix_copies(odd.repartition(n)).collect())) for n in (1, 5))
    assert one == two and len(one) == odd.count()


def test_no_rows(empty):
    assert mixing.mix_copies(empty).collect() == []
    assert mixing.mix_documents(empty).collect() == []


def test_plan_has_no_python(spark, odd):
    plan = mixing.mix_documents(odd)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))
