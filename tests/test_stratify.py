"""Iterative stratification against a plain version of the same rounds."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest

from curata.operators import stratify as ST
from curata.operators.splits import SPLITS

SHARES = (0.66, 0.17, 0.17)


def plain(notes):
    """{note: split} of one task: notes = {id: labels}; no numpy, no rounds side by side."""
    support = Counter(x for own in notes.values() for x in own)
    turn = sorted(support, key=lambda x: (support[x], x))
    left = {x: float(support[x]) for x in turn} | {None: float(len(notes))}
    unmet = {x: [n * s for s in SHARES] for x, n in left.items()}
    out = {}
    for label in [*turn, None]:
        here = [i for i, own in notes.items() if (min(own, key=turn.index) if own else None) == label]
        if not here:
            continue
        want = [max(u, 0) for u in unmet[label]]
        want = [w * len(here) / sum(want) for w in want] if sum(want) else [s * len(here) for s in SHARES]
        sizes = [math.floor(w + 1e-9) for w in want]
        for k in sorted(range(3), key=lambda k: (round(sizes[k] - want[k], 9), k))[: len(here) - sum(sizes)]:
            sizes[k] += 1
        pull = {x: [round(u / max(left[x], 1) - s, 9) for u, s in zip(unmet[x], SHARES)] for x in turn}
        total = lambda i, k: sum(pull[x][k] for x in notes[i] if x != label)
        h = lambda i: hashlib.md5(f"42:t:{i}".encode()).hexdigest()
        order = sorted(here, key=lambda i: (-round(total(i, 0), 7), h(i)))
        rest = sorted(order[sizes[0]:], key=lambda i: (-round(total(i, 1) - total(i, 2), 7), h(i)))
        for k, own in enumerate((order[:sizes[0]], rest[:sizes[1]], rest[sizes[1]:])):
            for i in own:
                out[i] = SPLITS[k]
                for x in [*notes[i], None]:
                    left[x] -= 1
                    unmet[x][k] -= 1
    return out


def random_notes(n, labels, seed):
    rng = random.Random(seed)
    return {i: {f"L{int(rng.paretovariate(0.8)) % labels:02d}" for _ in range(rng.randint(0, 5))} for i in range(n)}


@pytest.mark.parametrize("small", [ST.SMALL, 20])
def test_equals_the_plain_rounds(spark, small):
    """One order per turn, or ranks by ranges for every turn of more than 20 notes."""
    notes = random_notes(400, 6, 1)
    df = spark.createDataFrame([("t", i, sorted(x) + sorted(x)[:1] + [None], "text") for i, x in notes.items()], "task string, note_id long, labels array<string>, text string").repartition(3)
    out = ST.iterative_split(df, small=small).collect()
    assert {r["note_id"]: r["split"] for r in out} == plain(notes) and len(out) == len(notes)


def test_quotas_are_met_in_every_task(spark):
    tasks = {t: random_notes(n, 30, n) for t, n in ((None, 700), ("a", 900), ("b", 3), ("c", 1))}
    df = spark.createDataFrame([(t, i, sorted(x)) for t, own in tasks.items() for i, x in own.items()], "task string, note_id long, labels array<string>")
    out = ST.iterative_split(df)
    rows = out.collect()
    assert Counter((r["task"], r["note_id"]) for r in rows) == Counter((t, i) for t, own in tasks.items() for i in own) and all(r["split"] in SPLITS for r in rows)
    for r in ST.label_quotas(out).collect():
        if r["positives"] >= 6:
            assert abs(r["assigned"] - r["quota"]) <= 1, r
    sizes = defaultdict(Counter)
    for r in rows:
        sizes[r["task"]][r["split"]] += 1
    assert all(abs(sizes[t][s] / len(tasks[t]) - share) < 0.05 for t in (None, "a") for s, share in zip(SPLITS, SHARES))


def test_repeats_empty_and_unlabelled(spark):
    schema = "task string, note_id long, labels array<string>"
    df = spark.createDataFrame([("a", 1, ["x"]), ("a", 1, ["x"]), ("a", 2, None), ("a", 3, [])], schema)
    out = ST.iterative_split(df).collect()
    assert len(out) == 4 and len({r["split"] for r in out if r["note_id"] == 1}) == 1
    assert ST.iterative_split(df.limit(0)).count() == 0
    only = spark.createDataFrame([("a", i, []) for i in range(100)], schema)
    assert Counter(r["split"] for r in ST.iterative_split(only).collect()) == {"train": 66, "dev": 17, "test": 17}


def test_large_tasks_of_a_round_are_ordered_together(spark, monkeypatch):
    """Two orders by ranges per round, however many tasks are large; the same splits as in one task of Spark each."""
    calls, plain_deal = [], ST.dealt_by_ranges
    monkeypatch.setattr(ST, "dealt_by_ranges", lambda df, *a: calls.append(1) or plain_deal(df, *a))
    rows = [(t, i, sorted(x)) for k, t in enumerate((None, "a", "b", "c")) for i, x in random_notes(60 + 20 * k, 3, k).items()]
    df = spark.createDataFrame(rows, "task string, note_id long, labels array<string>")
    of = lambda out: {(r["task"], r["note_id"]): r["split"] for r in out.collect()}
    assert of(ST.iterative_split(df, small=2)) == of(ST.iterative_split(df)) and 0 < len(calls) <= 2 * 4
