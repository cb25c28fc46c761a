"""Near copies: what stays on the driver, and which step finds what."""

import random
from collections import Counter

from conceptflow import session
from conceptflow.llm import resemblance, simhash

ROWS = "doc_id bigint, text string"


def test_finished_steps_leave_the_driver(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    docs = spark.createDataFrame([(i, " ".join([*words[:59], f"x{i // 2}"])) for i in range(40)], ROWS)
    heap = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    used = lambda: (heap.totalMemory() - heap.freeMemory()) / 2**20
    groups = resemblance.near_copies(docs)
    left = used()
    session.release(spark)
    assert left - used() < 150  # MB that were still to collect; 497 when no step was released
    assert groups.select("root").distinct().count() == 1


def test_fingerprints_find_candidates_and_texts_decide(spark):
    rng = random.Random(11)
    tail = lambda n: [f"t{rng.randrange(10**9)}" for _ in range(n)]
    texts, found = [], Counter()
    for n in (60, 250, 350, 450):
        for _ in range(4):
            said = [f"s{rng.randrange(10**9)}" for _ in range(5)] * 40  # five shingles, forty times each, in both; tails differ
            pair = [" ".join([*said, *tail(n)]) for _ in "ab"]
            a, b = simhash.fingerprints([t.encode() for t in pair], 5)
            found[min(int(a ^ b).bit_count(), 5)] += 1
            texts += pair
    assert found[0] and sum(found[k] for k in (1, 2, 3, 4))
    docs = spark.createDataFrame(list(enumerate(texts)), ROWS)
    prints = simhash.fingerprints([t.encode() for t in texts], 5)
    near = {(i, i + 1) for i in range(0, len(texts), 2) if int(prints[i] ^ prints[i + 1]).bit_count() <= 4}
    # At 0.001 every pair is similar, but so far apart that no band is shared: only fingerprints can show it.
    root = {r["doc_id"]: r["component_id"] for r in resemblance.near_copies(docs, least=0.001).collect()}
    assert all(root[b] == a for a, b in near)
    # At 0.8 none is, whatever the fingerprints.
    assert all(r["component_id"] == r["doc_id"] for r in resemblance.near_copies(docs).collect())
