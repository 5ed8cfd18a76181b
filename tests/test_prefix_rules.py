"""The nearest rule above a path against a look at every rule."""

import random
from collections import Counter

from bazaarlake.operators import prefix_rules


def test_nearest_rule_equals_brute_force(spark):
    rng = random.Random(1)
    path = lambda: "/".join(rng.choice("abc") for _ in range(rng.randint(1, 4)))
    rules = [(rng.choice(["", "/"]) + path() + rng.choice(["", "/"]), float(k), f"h{k}") for k in range(25)] + [("", 99.0, None), (None, 5.0, "x")]
    rows = [(k, rng.choice([path(), path() + "/", None, "", "zz", "ab/c"]), k) for k in range(120)]
    got = Counter((r.id, r.path, r.rate_id, r.rate, r.hts, r.rule) for r in prefix_rules.ruled(spark.createDataFrame(rows, "id int, path string, rate_id int"), spark.createDataFrame(rules, "prefix string, rate double, hts string")).collect())
    want = Counter()
    for i, p, x in rows:
        own = (p or "").strip("/")
        hits = [(len(q.strip("/")), rate, h or "", q.strip("/"), h) for q, rate, h in rules if q is not None and (own == q.strip("/") or own.startswith(q.strip("/") + "/"))]
        best = max(hits, default=None)
        want[(i, p, x, best and best[1], best and best[4], best and best[3])] += 1
    assert got == want


def test_rules_are_joined_without_pairs_of_all(spark, sf_dir):
    from bazaarlake.sources.catalog import Catalog

    plan = prefix_rules.ruled(*prefix_rules.sample(Catalog(spark, sf_dir)))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
