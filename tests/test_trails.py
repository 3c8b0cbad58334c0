"""Lists are contracted and rank as walked."""

import random

from seqloom.operators import graph


def test_contracted_lists_rank_as_walked(spark):
    rnd, links, want = random.Random(1), [], {}
    ids = list(range(900))
    rnd.shuffle(ids)
    while ids:
        n = min(len(ids), rnd.choice([1, 2, 3, 40, 300]))
        part, ids = ids[:n], ids[n:]
        want |= {x: (part[0], i) for i, x in enumerate(part)}
        links += list(zip(part, part[1:]))
    nodes = spark.createDataFrame([(x,) for x in want], "id long")
    got = graph._ranked(spark.createDataFrame(links, "src long, dst long"), nodes, few=20).collect()
    assert len(got) == 900 and {r.id: (r.head, r["rank"]) for r in got} == want
