"""The fit of the secrets' network: over every candidate, in shards."""

from collections import Counter

import numpy as np

from granary.llm import secrets as S


def test_every_candidate_counts(spark):
    """More candidates than any bound of old: all are dealt out once, and thresholds come from all calibration findings."""
    rng = np.random.default_rng(4)
    values = [S._drawn(rng, S._ALNUM, 19) + "1" for _ in range(3500)]
    texts = [(i, " and ".join(values[i::50]) + f" token={values[i]} ") for i in range(50)] * 2
    df = spark.createDataFrame(texts, "doc_id long, text string")
    scanned = S.scan(df)
    want = {(c["base"], c["before"], c["value"], c["after"]) for r in scanned.collect() for c in r["cand"]}
    held = S.shards(scanned, size=400)
    rows = [r for r in held.collect() if r["value"] is not None]
    assert len(rows) == len(want) > 3500 and {tuple(r)[1:] for r in rows} == want
    assert len({r["shard"] for r in rows}) == -(-len(want) // 400)
    net = S.Network.new()
    _, _, rest, y = S.divided([w[1:] for w in want], [int(w[0]) for w in want])
    z = np.floor(np.clip(net.logits(rest), -S.FAR, S.FAR) * S.GRID)
    got = Counter({(r["label"], r["shape"]): 0 for r in []})
    for r in S.counted(net, held, made_each=0).collect():
        got[r["label"], r["shape"]] += r["num"]
    assert got == Counter((int(a), S.shape(f[1])) for a, f in zip(y, rest)) and len(z) == got.total()


def test_fit_depends_on_no_order(spark):
    """The same network and thresholds however the rows lie; weights are the mean over shards."""
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, f"id {S.made_harmless(rng)} or token={S.made_secret(rng)} end") for i in range(300)], "doc_id long, text string")
    fit = lambda d: S.fit(S.scan(d), rounds=2, size=100, made_each=40)
    a, b = fit(df), fit(df.orderBy("text").repartition(7))
    assert all((a.weights[k] == b.weights[k]).all() for k in a.weights) and a.thresholds == b.thresholds and (a.slope, a.shift) == (b.slope, b.shift)
    held, start = S.shards(S.scan(df), size=100), S.Network.new()
    alone = []
    for labelled, labels in S._labelled(iter(held.toArrow().sort_by([(c, "ascending") for c in ("shard", "value", "before", "after", "base")]).to_batches()), 40):
        one, (f, y, _, _) = S.Network.new(), S.divided(labelled, labels)
        x, of = S.windows(f)
        one.train(x, y[of], 1, total=2)
        alone.append(one.weights)
    mean = S.averaged(start, held, 1, 0, 2, 40)
    assert len(alone) > 3 and all(np.allclose(mean.weights[k], np.mean([w[k] for w in alone], 0), atol=1e-3) for k in mean.weights)


def test_counts_stand_for_findings():
    rng = np.random.default_rng(6)
    y = (rng.random(3000) < 0.3).astype(float)
    z, shapes = np.floor(rng.normal(2 * y - 1, 1, 3000) * 16) / 16, rng.integers(0, 2, 3000)
    plain, summed = S.Network.new(), S.Network.new()
    plain.calibrate(z, y, shapes)
    n = Counter(zip(z, y, shapes))
    summed.calibrate(*(np.array(c) for c in zip(*n)), num=np.array(list(n.values())))
    assert np.allclose(plain.thresholds, summed.thresholds) and np.isclose(plain.slope, summed.slope)
