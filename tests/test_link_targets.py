"""Distinct link targets: exact counts and mergeable estimates."""

import random

from webcorpus.operators import pages as OP


def test_counts_and_estimates_per_domain_and_suffix(spark):
    rng = random.Random(12)
    rows, by_domain, by_suffix = [], {}, {}
    for i in range(240):
        domain = f"site{i % 4}.com" if i % 3 else f"shop{i % 2}.org"
        targets = [f"https://t.net/{rng.randrange(4000)}" for _ in range(60)]
        rows.append((i, f"https://{domain}/p{i}", "<p>" + "".join(f'<a href="{t}">x</a>' for t in targets + targets[:5]) + '<a href="#top">top</a></p>'))
        by_domain.setdefault(domain, set()).update(targets)
        by_suffix.setdefault(domain.split(".", 1)[1], set()).update(targets)
    rows += [(900, "https://site0.com/empty", None), (901, None, "<a href='https://t.net/1'>x</a>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = OP.link_targets(pages).collect()
    want = {("domain", d): len(t) for d, t in by_domain.items()} | {("suffix", s): len(t) for s, t in by_suffix.items()}
    told = {(r["level"], r["name"]): r for r in got if r["name"]}
    assert {k for k in told if k in want} == set(want)
    for key, n in want.items():
        assert told[key]["targets"] == n
        assert abs(told[key]["estimate"] - n) <= 4 * 1.04 / 64 * n + 1  # four standard errors at precision 12
    assert OP.link_targets(pages.limit(0)).collect() == []
