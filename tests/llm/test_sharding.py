import zlib
from collections import Counter, defaultdict

import pytest

from quirebase.llm import sharding


@pytest.mark.parametrize("which", ["odd", "real"])
def test_shards(which, request):
    docs = request.getfixturevalue(which)
    rows = sharding.sharded(docs, 4).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    slots, loads, where = defaultdict(list), Counter(), defaultdict(set)
    for r in rows:
        slots[r.shard].append(r.slot)
        loads[r.shard] += r.size
        where[r.size, r.text_crc32].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in where.values())
    largest = max(Counter((r.size, r.text_crc32) for r in rows).items(), key=lambda x: x[1] * x[0][0])
    assert max(loads.values()) - min(loads.values()) <= largest[1] * largest[0][0]


def test_near_equal(real):
    loads = Counter()
    for r in sharding.sharded(real, 4).collect():
        loads[r.shard] += r.size
    assert max(loads.values()) < 1.02 * min(loads.values())


def test_sixteen_against_plain_scheduling(real):
    """Loads as near equal as one global run's, up to the largest group; types of the contract."""
    out = sharding.sharded(real, 16)
    assert dict(out.dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "shard": "int", "slot": "bigint"}
    groups = Counter()
    for r in real.collect():
        groups[r.text or ""] += len((r.text or "").encode()) + 1
    plain = [0] * 16
    for size in sorted(groups.values(), reverse=True):
        plain[plain.index(min(plain))] += size
    loads = Counter()
    for r in out.collect():
        loads[r.shard] += r.size
    assert len(loads) == 16 and sum(loads.values()) == sum(plain) and abs(max(loads.values()) - max(plain)) <= max(groups.values())


def test_empty(none):
    assert sharding.sharded(none).count() == 0
