"""Plans over whole texts against plain Python."""

import re
from collections import Counter, defaultdict

from quirebase import queries


def lines(spark, sf):
    return {r.doc_id: (r.text or "").split("\n") for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.text is not None}


def test_bag_ratio(spark, sf):
    want = {}
    for doc, rows in lines(spark, sf).items():
        for i, (x, y) in enumerate(zip(rows, rows[1:])):
            a, b = (re.sub("[^0-9A-Za-z]", "", t).lower() for t in (re.sub(r"\\[A-Za-z]+", " ", x), y))
            want[doc, i] = 2 * (Counter(a) & Counter(b)).total() / (len(a) + len(b)) if a and b else 0.0
    got = {(r.doc_id, r.blk): r.ratio for r in queries.QUERIES["a19_bag_ratio"](spark, sf).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_budget(spark, sf):
    want = set()
    for doc, rows in lines(spark, sf).items():
        used = 0
        for i, t in enumerate(rows[:200]):
            note, sent = " ".join(t.split())[:1500], " ".join((rows[i + 1] if i + 1 < len(rows) else "").split())[:600]
            if not note:
                continue
            used += len(note) + len(sent) + 24
            if used > 12000:
                break
            want.add((doc, i, len(note) + len(sent), used))
    assert {tuple(r) for r in queries.QUERIES["w01_w02_w05_budget"](spark, sf).collect()} == want


def test_region(spark, sf):
    want = set()
    for doc, rows in lines(spark, sf).items():
        heads = [i for i, t in enumerate(rows) if 1 <= len(t) <= 29]
        if heads:
            stop = next((i for i in range(heads[-1] + 1, len(rows)) if 30 <= len(rows[i]) <= 40), len(rows))
            want |= {(doc, i) for i in range(heads[-1] + 1, stop)}
        else:
            want |= {(doc, i) for i, t in enumerate(rows) if re.match(" *[(][0-9]+[)]", t)}
    assert {(r.doc_id, r.blk) for r in queries.QUERIES["w16_w17_region"](spark, sf).collect()} == want


def test_accounts_not_shared(spark, sf):
    spark.read.parquet(f"{sf}/orders.parquet").createOrReplaceTempView("orders_")
    owner = {r.o_orderkey: f"u{r.o_custkey % 40}" for r in spark.table("orders_").collect() if r.o_custkey % 17}
    ids = {r.o_orderkey for r in spark.table("orders_").collect()}
    shared = defaultdict(set)
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").collect():
        if r.l_partkey % 11:
            shared[r.l_orderkey].add(f"u{r.l_partkey % 40}")
    want = {(i, w) for i in ids for w in set(owner.values()) - shared[i]}
    assert {tuple(r) for r in queries.QUERIES["j29_not_shared"](spark, sf).collect()} == want
