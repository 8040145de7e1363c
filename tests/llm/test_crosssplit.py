import numpy as np

from veridex.llm import crosssplit

SCHEMA = "id string, split string, source string, question string, form string"
BASE = "In shift workers with {c}, does {a} at {d} mg compared with {b} change recurrent stroke within five years?"
CONDITIONS = ["raised blood pressure", "resistant hypertension", "type 2 diabetes", "carotid narrowing"]


def corpus():
    rows = []
    for i in range(60):
        q = BASE.format(c=CONDITIONS[i % 4], a=f"drug{chr(97 + i % 26)}{chr(97 + i // 26)}xol", b=f"med{chr(97 + i % 26)}{chr(98 + i // 26)}tin", d=[5, 10, 20][i % 3])
        rows.append((f"t{i:02d}", "train", "s", q, "x"))
    return rows


def pairs(spark, extra):
    df = spark.createDataFrame(corpus() + extra, SCHEMA)
    return {(r.id_a, r.id_b) for r in crosssplit.found(spark, df).collect()}


def test_near_copies_and_different_questions(spark):
    q = {r[0]: r[3] for r in corpus()}
    extra = [
        ("e1", "dev", "s", q["t00"], "x"),
        ("e2", " BLIND ", "s", "Please explain: " + q["t01"].upper() + " Thanks.", "x"),
        ("e3", "dev", "s", q["t02"].replace("recurrent", "recurent").replace("does", "d​oes"), "x"),
        ("e4", "dev", "s", q["t03"].replace(" at 5 mg", " at 40 mg").replace(" at 10 mg", " at 40 mg"), "x"),
        ("e5", "dev", "s", q["t04"].replace("raised blood pressure", "type 2 diabetes"), "x"),
        ("e6", "synthetic", "s", q["t05"], "x"),
        ("e7", "dev", "s", None, "x"),
        ("e8", "dev", "s", "", "x"),
        ("e9", "dev", "s", "?!", "x"),
        ("e1", "dev", "s", q["t00"], "x"),
        ("t99", "Train", "s", "", "x"),
        (None, "dev", "s", q["t00"], "x"),
    ]
    assert pairs(spark, extra) == {("e1", "t00"), ("e2", "t01"), ("e3", "t02")}


def test_hot_copies_are_all_paired(spark):
    q = corpus()[0][3]
    extra = [(f"h{i}", "train", "s", q, "x") for i in range(30)] + [("e1", "dev", "s", q, "x"), ("e2", "blind", "u", q + " Thanks.", "x")]
    got = pairs(spark, extra)
    assert len([p for p in got if "e1" in p]) == 31 and len([p for p in got if "e2" in p]) == 31
    df = spark.createDataFrame(corpus() + extra, SCHEMA)
    assert {(r.eval_split, r.eval_source, r.n_questions) for r in crosssplit.report(df).collect()} == {("dev", "s", 1), ("blind", "u", 1)}


def test_empty(spark):
    assert crosssplit.found(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_edit_distance_and_differences():
    assert crosssplit.edit_distance("persists", "presists") == 1 and crosssplit.edit_distance("abc", "abcdef") == 3
    assert crosssplit.differences(["systolic", "x"], ["diastolic", "x"], [50, 9], [60, 9]) == (["systolic"], ["diastolic"])
    assert crosssplit.differences(["5"], ["6"], [9], [9]) == (["5"], ["6"])
    assert crosssplit.differences(["高", "血", "压"], ["高", "压"], [9] * 3, [9] * 2) == ([], [])
    assert crosssplit.differences(["不", "宜"], ["宜"], [9] * 2, [9]) == (["不"], [])


def distance(a, b):
    return sum((int(p) ^ int(q)).bit_count() for p, q in zip(a, b, strict=True))


def test_every_pair_within_the_radius(spark):
    """Candidates against brute force: no pair up to the radius is lost, and far pairs are hardly there."""
    rng = np.random.default_rng(3)
    a = rng.integers(0, 256, (300, 32), dtype=np.uint8)
    b = a[rng.permutation(300)[:200]].copy()
    for k, row in enumerate(b):  # 0 to 59 bits apart
        flip = np.zeros(256, np.uint8)
        flip[rng.permutation(256)[: k % 60]] = 1
        b[k] = row ^ np.packbits(flip)
    rows = [(i, bytearray(x.tobytes()), 7) for i, x in enumerate(a)] + [(1000 + i, bytearray(x.tobytes()), 7) for i, x in enumerate(b)]
    parts = [(i, "train") for i in range(300)] + [(1000 + i, "eval") for i in range(200)]
    codes = spark.createDataFrame(rows, "class long, code binary, fixed long")
    got = {(r.train_class, r.eval_class - 1000) for r in crosssplit.candidates(codes, spark.createDataFrame(parts, "class long, part string")).collect()}
    near = {(x, y) for x in range(300) for y in range(200) if distance(a[x], b[y]) <= crosssplit.RADIUS}
    assert near <= got and len(near) >= 100 and len(got) < 5000
    other = codes.withColumn("fixed", codes["class"])
    assert crosssplit.candidates(other, spark.createDataFrame(parts, "class long, part string")).count() == 0


def test_verified_pairs(spark):
    """Beyond the radius, or with other content, candidates are dropped; several words may be spelt otherwise."""
    base = ["alphaxolem", "betatinora", "gammadorix", "deltamerol", "epsilunate", "zetamicron"]
    words = {i: [w if i >> k & 1 else w[:-1] + "q" for k, w in enumerate(base)] for i in range(16)}
    rng = np.random.default_rng(4)
    codes = {}
    for i in words:
        flip = np.zeros(256, np.uint8)
        flip[rng.permutation(256)[:16]] = 1
        codes[i] = np.packbits(flip)
    classes = spark.createDataFrame([(i, w, [1000 if x in base else 9 for x in w]) for i, w in words.items()], "class long, words array<string>, dfs array<long>")
    rows = spark.createDataFrame([(i, bytearray(codes[i].tobytes()), 1) for i in words], "class long, code binary, fixed long")
    pairs = spark.createDataFrame([(i, j) for i in range(1, 16, 2) for j in range(0, 16, 2)], "train_class long, eval_class long")
    got = sorted((r.train_class, r.eval_class) for r in crosssplit.verified(pairs, rows, classes).collect())
    assert got == [(i, j) for i in range(1, 16, 2) for j in range(0, 16, 2) if distance(codes[i], codes[j]) <= crosssplit.RADIUS] and len(got) > 20
    assert crosssplit.verified(pairs.limit(0), rows, classes).count() == 0


def test_a_misspelt_rare_name_is_found(spark):
    """A name of three questions, misspelt once: codes read it as the name, verification accepts one such word."""
    q = "Does zorvaxolem help {c}?"
    extra = [(f"r{i}", "train", "s", q.format(c=c), "x") for i, c in enumerate(CONDITIONS[:3])] + [("e1", "dev", "s", q.format(c=CONDITIONS[1]).replace("zorvaxolem", "zorvaxolen"), "x")]
    assert ("e1", "r1") in pairs(spark, extra)


def test_rules_do_not_count_rows(spark):
    """One swap of listed words is enough; denials, numbers and populations always count."""
    q = {r[0]: r[3] for r in corpus()}
    zh = "哪项队列研究{w}在老年人中lofaladu比kufifizo更能改善高血压患者的收缩压?"
    german = "Hat Lofaladu bei älteren Menschen mit Bluthochdruck {w} Wirkung auf den Schlaganfall?"
    rows = [
        ("z1", "train", "s", zh.format(w="指明"), "x"),
        ("z2", "dev", "s", zh.format(w="说明"), "x"),
        ("z3", "blind", "s", zh.format(w="指出"), "x"),
        ("g1", "train", "s", german.format(w="keine"), "x"),
        ("g2", "dev", "s", german.format(w="eine"), "x"),
        ("a1", "dev", "s", q["t00"] + " (adults only)", "x"),
        ("a3", "dev", "s", q["t02"] + " (adullts only)", "x"),
        ("a2", "dev", "s", q["t01"].replace("workers", "workers, adults only,"), "x"),
    ] + [(f"n{i}", "train", "s", f"Hat Mittel{chr(97 + i)} eine Wirkung?", "x") for i in range(12)]
    assert pairs(spark, rows) == {("z1", "z2"), ("z1", "z3"), ("a1", "t00"), ("a3", "t02")}


def test_denials_and_numbers_are_no_misspellings():
    for a, b in (("never", "fever"), ("keine", "keiner"), ("sechs", "sechz")):
        assert crosssplit.differences([a, "x"], [b, "x"], [50, 9], [60, 9]) == ([a], [b])


def _close_codes(n, rng, spread):
    base = rng.integers(0, 256, (40, crosssplit.BITS // 8), dtype=np.uint8)
    codes = base[rng.integers(0, len(base), n)].copy()
    for i in range(n):
        for bit in rng.choice(crosssplit.BITS, rng.integers(0, spread), replace=False):
            codes[i, bit // 8] ^= np.uint8(1 << (bit % 8))
    return codes


def test_pairs_within_the_radius_are_those_of_all_pairs(monkeypatch):
    rng = np.random.default_rng(3)
    codes = _close_codes(700, rng, 30)
    a, b = codes[:400], codes[400:]
    fa, fb = rng.integers(0, 3, 400), rng.integers(0, 4, 300)
    distance = np.unpackbits(a[:, None, :] ^ b[None, :, :], axis=2).sum(axis=2)
    right = {(int(i), int(j)) for i, j in zip(*np.nonzero((distance <= crosssplit.RADIUS) & (fa[:, None] == fb[None, :])), strict=True)}
    assert right
    for brute, pairs in ((256, 1_000_000), (10, 1_000_000), (10, 50)):
        monkeypatch.setattr(crosssplit, "BRUTE", brute)
        monkeypatch.setattr(crosssplit, "PAIRS", pairs)
        i, j = crosssplit.within(fa, a.view(np.uint64), fb, b.view(np.uint64))
        got = list(zip(i.tolist(), j.tolist(), strict=True))
        assert len(got) == len(set(got)) and set(got) == right


def test_a_fixed_part_that_many_classes_share_is_cut_into_pieces(spark):
    codes = _close_codes(60, np.random.default_rng(4), 20)
    rows = [(i, 7 if i < 50 else i, codes[i].tobytes(), ["heart", "rate", f"w{i % 5}"], [50, 50, 50], part) for i in range(60) for part in ("train", "eval") if i % 3 or part == "train"]
    sides = spark.createDataFrame(rows, "class long, fixed long, code binary, words array<string>, dfs array<int>, part string")
    every = lambda large: sorted(tuple(r) for r in crosssplit.near_classes(sides, large).collect())
    whole = every(1_000)
    assert len(whole) > 5 and every(7) == whole
    assert whole == sorted((i, j) for i in range(50) for j in range(50) if j % 3 and i != j and i % 5 == j % 5 and np.unpackbits(codes[i] ^ codes[j]).sum() <= crosssplit.RADIUS)


def test_words_beyond_the_broadcast_bound_are_joined(spark, monkeypatch):
    rows = [(f"t{i}", "train", f"does aspirin lower risk number{i % 7} in group{i % 3}") for i in range(30)] + [(f"e{i}", "dev", f"does asprin lower risk number{i % 5} in group{i % 3} please") for i in range(20)]
    df = spark.createDataFrame([(i, s, q, "s") for i, s, q in rows], "id string, split string, question string, source string")
    looked_up = sorted(tuple(r) for r in crosssplit.found(spark, df).collect())
    monkeypatch.setattr(crosssplit, "BROADCAST_WORDS", 0)
    assert looked_up and sorted(tuple(r) for r in crosssplit.found(spark, df).collect()) == looked_up
