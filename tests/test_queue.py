import random
from collections import deque

from quirebase.operators import queue


def test_bounded_queue_against_a_real_one(spark):
    rng, log, want = random.Random(2), [], []
    for pool, size_of_take in (("a", 1), ("b", 5), ("c", 2)):
        items: deque = deque()
        at = 0
        for seq in range(700):
            at += rng.choice([0, 0, 1, 3, 40])
            take = rng.randint(0, size_of_take) if rng.random() < (0.45 if seq % 200 < 120 else 0.1) else None
            log.append((pool, at, seq, take))
            if take is None:
                want.append((pool, at, seq, len(items), len(items) < 6))
                if len(items) < 6:
                    items.append(seq)
            else:
                for _ in range(min(take, len(items))):
                    items.popleft()
    log.sort(key=lambda r: r[2] * 7919 % 1009)
    df = spark.createDataFrame(log, "pool string, at long, seq long, take int")
    for width in (10**9, 50, 1):
        assert sorted(map(tuple, queue.admitted(df, 6, width).collect())) == sorted(want)
    assert {w[4] for w in want} == {True, False} and {w[3] for w in want} == set(range(7))


def test_empty_log(spark):
    assert queue.admitted(spark.createDataFrame([], "pool long, at long, seq long, take int"), 3, 10).collect() == []
