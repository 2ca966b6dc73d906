"""Candidates of the pipeline's near_duplicates: what is sent doesn't grow with the number of tasks, and pairs are found."""

import numpy as np
import pyarrow as pa
import pytest

from tideline.llm import graph, simhash


def _frame(spark, sig):
    return spark.createDataFrame([(k, *map(int, r)) for k, r in enumerate(sig.view(np.int64))], "id long, " + ", ".join(f"f{s} long" for s in range(8)))


def _flipped(rng, sig, bits):
    out = sig.copy()
    for row in out:
        for at in rng.choice(512, bits, replace=False).tolist():
            row[at // 64] ^= np.uint64(1 << at % 64)
    return out


@pytest.mark.parametrize("rows", [1000, 4000])
def test_rows_are_sent_equally_often_at_every_size(spark, monkeypatch, rows):
    def counted(*args):
        return lambda t: pa.table({"a": [t.num_rows], "b": [t.num_rows], "now": [True]})

    monkeypatch.setattr(simhash, "_wide_task", counted)
    sig = np.random.default_rng(rows).integers(0, 1 << 64, (rows, 8), dtype=np.uint64)
    sent = simhash.similar_links(_frame(spark, sig), 8, per_task=100).collect()
    assert len(sent) >= rows // 100 and sum(r["a"] for r in sent) == 32 * rows


def test_similar_rows_are_linked_and_others_not(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 64, (700, 8), dtype=np.uint64)
    sig = np.concatenate([base, _flipped(rng, base[:400], 78), _flipped(rng, base[400:600], 40)])  # as of similarities of 0.8 and 0.9
    links = {(r["a"], r["b"]) for r in simhash.similar_links(_frame(spark, sig), 8, per_task=60).collect() if r["now"]}
    assert all(b - a == 700 for a, b in links)
    assert sum(a < 400 for a, _ in links) >= 395 and sum(a >= 400 for a, _ in links) == 200


def test_rows_of_one_crowded_block_all_meet(spark):
    rng = np.random.default_rng(6)
    sig = rng.integers(0, 1 << 64, (600, 8), dtype=np.uint64)
    sig[:, 1:] = 0  # seven segments tell nothing, so all are near by them and the first decides
    sig[300:] = sig[:300]
    sig[300:, 0] ^= np.uint64(1)
    links = [(r["a"], r["b"]) for r in simhash.similar_links(_frame(spark, sig), 8, per_task=50).collect() if r["now"]]
    label = simhash.local_components(600, *np.array(links).T)
    i, j = np.nonzero(np.triu(np.bitwise_count(sig[:, None, 0] ^ sig[None, :, 0]) <= 53, 1))
    assert (label == simhash.local_components(600, i, j)).all()
    assert len(links) < 100 * 600


@pytest.mark.parametrize("small", [0, 30, 100_000])
def test_components_may_end_in_one_task(spark, small):
    rng = np.random.default_rng(7)
    a, b = rng.integers(0, 900, 400), rng.integers(0, 900, 400)
    a, b = np.concatenate([a, np.arange(1000, 1060)]), np.concatenate([b, np.arange(1001, 1061)])  # and a long path
    edges = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b)], "a long, b long")
    got = {r["node"]: r["component"] for r in graph.components(edges, small).collect()}
    label = simhash.local_components(1061, a, b)
    named = {}
    assert set(got) == {int(x) for x, y in zip([*a, *b], [*b, *a]) if x != y}
    assert all(named.setdefault(int(label[x]), c) == c and int(label[c]) == int(label[x]) for x, c in got.items())
    assert graph.components(edges.where("a < 0"), small).count() == 0
