"""Near-duplicates: what the steps after the hubs do, and leave undone."""

import numpy as np
import pytest

from granary.llm import common, minhash


@pytest.mark.parametrize("few", [0, 4096])
def test_links_join_known_components(spark, few):
    """New links join components, on the driver or by steps, as components of all links do."""
    rng = np.random.default_rng(8)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2)) if a != b]
    frame = lambda e: spark.createDataFrame(e, "a long, b long")
    read = lambda df: sorted(tuple(r) for r in df.select("id", "component").collect())
    want = dict(read(common.components(frame(edges))))
    low = {i: i for e in edges for i in e}
    for _ in low:
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    assert want == low
    known = common.cut(common.components(frame(edges[:150])))
    assert read(common.merged(known, frame(edges[150:]), few)) == sorted(want.items())
    assert read(common.merged(known, frame([]), few)) == read(known)
    assert common.components(frame([])).count() == 0


def test_small_buckets_end_with_the_hubs(spark, monkeypatch):
    """Buckets of three are decided by step 1: their texts are not compared again."""
    monkeypatch.setattr(minhash, "confirm_blocks", None)
    text = lambda n, m: " ".join(f"w{i}" for i in range(n)) + "".join(f" x{m}y{i}" for i in range(12))
    df = spark.createDataFrame([(m, text(40, m)) for m in range(3)], "doc_id long, text string")
    assert {r["component_id"] for r in minhash.near_duplicates(df, k=2).collect()} == {0, 1, 2}
