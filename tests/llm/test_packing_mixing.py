import itertools
import random

import pytest

from veridex.llm import mixing, packing

DOCS = "doc_id long, source string, text string, tokens string, size string"


def least_bins(sizes, capacity):
    """Brute force over all assignments, first item fixed."""
    best = len(sizes)
    for n in range(1, len(sizes)):
        for spots in itertools.product(range(n), repeat=len(sizes)):
            load = [0] * n
            for s, b in zip(sizes, spots):
                load[b] += s
            if max(load) <= capacity:
                return n
    return best


def test_pack_is_valid_and_near_optimal():
    rng = random.Random(2)
    for _ in range(25):
        sizes = [rng.randint(1, 30) for _ in range(7)]
        bins = packing.pack(list(enumerate(sizes)), 40)
        assert sorted(k for b in bins for k in b) == list(range(7))
        assert all(sum(sizes[k] for k in b) <= 40 for b in bins)
        assert len(bins) == least_bins(sizes, 40)
    sizes = [rng.randint(20, 400) for _ in range(1500)]
    bins = packing.pack(list(enumerate(sizes)), 512)
    assert len(bins) <= -(-sum(sizes) // 512) + 2


def test_completions_against_brute_force():
    """The best filling is found, and no filling that is kept can take a larger unused item for one of its own."""
    rng = random.Random(7)
    for _ in range(60):
        sizes = sorted(rng.sample(range(1, 40), 6))
        counts = [rng.randint(1, 2) for _ in sizes]
        room = rng.randint(5, 90)
        kept = packing.completions(sizes, counts.copy(), room, branches=4, nodes=100_000)
        sums = {sum(s * c for s, c in zip(sizes, combo)) for combo in itertools.product(*[range(c + 1) for c in counts])}
        assert kept[0][0] == room - max(x for x in sums if x <= room)
        for waste, taken in kept:
            assert waste == room - sum(sizes[i] for i in taken) >= 0 and all(taken.count(i) <= counts[i] for i in taken)
        for waste, taken in kept[1:]:
            left = [c - taken.count(i) for i, c in enumerate(counts)]
            assert not any(sizes[i] < sizes[j] <= sizes[i] + waste and left[j] for i in taken for j in range(len(sizes)))


def test_search_goes_back_over_containers():
    """Best fit and the first dive need one container more than is possible."""
    sizes = [44, 24, 24, 22, 21, 17, 8, 8, 6, 6]
    assert sum(sizes) == 180 and len(packing.pack(list(enumerate(sizes)), 60)) == 3
    for seed in range(30):
        rng = random.Random(seed)
        parts = []
        for _ in range(6):  # six containers that can be filled exactly
            cuts = sorted(rng.sample(range(1, 100), 3))
            parts += [b - a for a, b in zip([0, *cuts], [*cuts, 100])]
        assert len(packing.pack(list(enumerate(parts)), 100)) <= 7


def test_containers(spark):
    rng = random.Random(5)
    docs = [(i, "s", "word " * rng.randint(1, 40), "c", "c") for i in range(200)] + [(999, "s", "word " * 500, "c", "c"), (1000, "s", "", "c", "c"), (1001, "s", None, "c", "c"), (None, "s", "x", "c", "c"), (5, "s", "word", "c", "c")]
    kinds = spark.createDataFrame([("small", 64), ("none", 0), ("null", None), (None, 9)], "container_kind string, capacity_tokens int")
    out = packing.fill_containers(spark.createDataFrame(docs, DOCS), kinds).toPandas()
    load = out.groupby("container_id")["size"].sum()
    assert (load <= 64).all() and set(out["container_kind"]) == {"small"}
    assert ((64 - out["container_id"].map(load)) == out["unused"]).all()
    assert set(out["doc_id"]) == {*range(200), 999} and not out.duplicated(["doc_id", "piece"]).any()
    big = out[out["doc_id"] == 999]
    assert len(big) == -(-big["size"].sum() // 64) and (big["size"] == 64).sum() >= len(big) - 1
    assert (64 * len(load) - load.sum()) / (64 * len(load)) < 0.03
    assert packing.fill_containers(spark.createDataFrame([], DOCS), kinds).count() == 0


def nearest_to_weights(tokens, weights, repeats, size):
    """Brute force: shares min(limit, c * weight) with the c that fills the mix, as relative entropy wants them."""
    limit = [r * t / size for r, t in zip(repeats, tokens)]
    low, high = 0.0, 1e9
    for _ in range(300):
        c = (low + high) / 2
        low, high = (c, high) if sum(min(x, c * w) for x, w in zip(limit, weights)) < 1 else (low, c)
    return [min(x, low * w) for x, w in zip(limit, weights)]


def test_temper_is_nearest_to_the_weights():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(1, 6)
        tokens, weights, repeats = [rng.choice([0.0, 1.0, 20.0, 300.0]) for _ in range(n)], [rng.choice([0.5, 1.0, 4.0]) for _ in range(n)], [rng.randint(1, 5) for _ in range(n)]
        size = max(sum(tokens), 1.0) * rng.choice([0.1, 0.5, 1.0, 3.0])
        shares, exponents = mixing.temper(tokens, weights, repeats, size)
        assert shares == pytest.approx(nearest_to_weights(tokens, weights, repeats, size), abs=1e-6)
        assert all(0 <= x <= 1 for x in exponents)


def test_temper_meets_limits():
    shares, exponents = mixing.temper([100.0, 100.0, 5.0], [1.0, 1.0, 1.0], [3, 3, 2], 100.0)
    assert shares[2] == pytest.approx(0.1, abs=1e-6) and shares[0] == shares[1] == pytest.approx(0.45)
    assert exponents[0] == 1.0 and 0 < exponents[2] < 1
    assert mixing.temper([10.0], [1.0], [1], 100.0)[0] == [pytest.approx(0.1)]
    assert mixing.temper([0.0, 5.0], [1.0, 1.0], [4, 4], 4.0)[0] == [0.0, 1.0]
    assert mixing.temper([1.0], [0.0], [1], 1.0)[0] == [0.0]
    assert mixing.temperature_for_entropy([8.0, 1.0, 1.0], mixing.entropy([0.8, 0.1, 0.1])) == pytest.approx(1.0, abs=1e-6)


def test_mix(spark):
    docs = [(i, "ab"[i % 2], "word " * 20, "c", "c") for i in range(400)] + [(1000 + i, "rare", "word " * 20, "c", "c") for i in range(4)] + [(2000, None, "x", "c", "c"), (2001, "a", None, "c", "c")]
    rows = [("m", "a", 3.0, 2, 1.0), ("m", "b", 1.0, 2, 1.0), ("m", "rare", 1.0, 3, 1.0), ("m", "gone", 1.0, 3, 1.0), (None, "a", 1.0, 1, 1.0)]
    mix = spark.createDataFrame(rows, "mix string, source string, weight double, max_repeats int, size_factor double")
    df = spark.createDataFrame(docs, DOCS)
    got = {r.source: r for r in mixing.shares(df, mix).collect()}
    assert got["rare"].most_uses == 3 and got["gone"].used_tokens == 0 and got["a"].most_uses <= 2
    assert got["a"].actual_share / got["b"].actual_share == pytest.approx(3, rel=0.03)
    used = mixing.mix(df, mix).toPandas()
    assert used["times"].min() >= 0 and not used.duplicated(["mix", "doc_id"]).any()
    assert mixing.mix(df.limit(0), mix).count() == 0 and mixing.mix(df, mix.limit(0)).count() == 0
