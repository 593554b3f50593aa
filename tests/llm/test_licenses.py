"""Licence scans against a plain Dice coefficient of multisets of bigrams."""

import re
from collections import Counter

from quern.llm import licenses as q


def words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def dice(a, b):
    x, y = (Counter(zip(w, w[1:])) for w in (a, b))
    return 2 * sum((x & y).values()) / (x.total() + y.total()) if x.total() + y.total() else 0


def brute(text):
    lines = text.split("\n")
    hits = []
    for unit in lines + ([text] if len(lines) > 1 else []):
        best = min(((-dice(words(unit), words(t)), n) for n, t in q.TEMPLATES))
        if -best[0] >= q.THRESHOLD:
            hits.append(best)
    return len(hits), ",".join(sorted({n for _, n in hits})), max((-s for s, _ in hits), default=None)


def test_licenses(spark):
    texts = [t for _, t in q.TEMPLATES]
    rows = [None, "", "\n\n", "plain prose", *texts, *(t.upper().replace(" ", "  * ") for t in texts), "\n".join(texts), texts[0] + " " + texts[0], texts[2].replace(" that ", "\n"), "is is " * 9 + texts[3], "Released under the MIT License.\n" * 2000, "w " * 100_000 + texts[0], "Licensed under CC BY-NC 4.0. é", "Lıcensed under the MIT License.", texts[12][:-20], texts[13] + " please"]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(rows)] + [(None, texts[0], 1, "x"), (0, None, 2, "y")], "doc_id long, text string, hits int, n_hits string").repartition(3)
    got = Counter((r.doc_id, r.n_hits, r.licenses, r.best) for r in q.licenses(df).collect())
    want = Counter((i, *brute(t or "")) for i, t in [*enumerate(rows), (None, texts[0]), (0, None)])
    assert got == want
    assert q.licenses(df.limit(0)).count() == 0
    assert not re.search("Python|Arrow|Pandas|Exchange", q.licenses(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString())


def test_bounds_are_exact():
    for n in range(1, 40):
        lo, hi = q.bounds(n, q.THRESHOLD)
        can = [m for m in range(1, 100) if 2 * min(n, m) / (n + m) >= q.THRESHOLD]
        assert (lo, hi) == (can[0], can[-1])
