import random
from datetime import datetime

from pyspark.sql import functions as F

from veridex.llm import ocr

CHUNKS = "id string, doc_id long, page_number int, ordinal int, text string, updated_at timestamp, wrapped string"
DOCS = "doc_id long, title string, journal string, authors array<string>, line string"
WORDS = "treatment reduced systolic pressure clearly among patients assigned placebo during followed measured community estimate function hospital number clinics systematic databases comparison recorded questionnaire registry".split()


def sentence(rng, n=12):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def wrap(text, width=60):
    lines, line = [], ""
    for w in text.split():
        if len(line) + len(w) + 1 > width:
            lines.append(line)
            line = w
        else:
            line = f"{line} {w}".strip()
    return lines + [line]


def corpus(rng):
    chunks, docs = [], []
    for d in range(30):  # unwrapped text
        docs.append((d, f"Title {d}", "Journal of Tests", ["A B"], "x"))
        chunks.append((f"c{d}", d, 1, 1, "Background\n" + " ".join(sentence(rng) for _ in range(12)), datetime(2024, 1, 1), "x"))
    for d in range(100, 130):  # scans with furniture
        docs.append((d, "Long term effects of walking on sleep quality", "Journal of Tests", ["Miller K"], "x"))
        for p in range(1, 5):
            lines = wrap(" ".join(sentence(rng) for _ in range(6)))
            head = "Long term effects of walking" if p % 2 else f"Journal Tests   {p}"
            chunks.append((f"s{d}p{p}", d, p, 1, "\n".join([head, *lines, f"- {p + 10} -"]), datetime(2024, 1, 1), "x"))
    return chunks, docs


def test_kinds_of_damage(spark):
    rng = random.Random(3)
    chunks, docs = corpus(rng)
    bad = wrap("Treatment clcarly redvced systolic pressure among pati5nts and followed them. " * 2)
    chunks += [
        ("m1", 200, None, 1, "Treatment reduced the systolic pre55ure among patients\nassigned placebo during 1O visits clearly and\nfollowed.", datetime(2024, 1, 1), "x"),
        ("h1", 200, None, 2, "Patients were followed during treat-\nment and pressure was measured by the community\nhospital.", datetime(2024, 1, 1), "x"),
        ("h2", 200, None, 3, "Patients were followed in a double-\nblind comparison that measured systolic pressure\nclearly.", datetime(2024, 1, 1), "x"),
        ("n0", 201, 1, 1, None, datetime(2024, 1, 1), "x"),
        (None, 201, 1, 1, "text", datetime(2024, 1, 1), "x"),
        ("e0", 201, 1, 1, "", datetime(2024, 1, 1), "x"),
    ]
    chunks += [(f"d{i}", 300 + i, None, 1, "A double-blind comparison reduced the pressure. " * 3, datetime(2024, 1, 1), "x") for i in range(5)]
    assert bad
    df, meta = spark.createDataFrame(chunks + chunks[-1:], CHUNKS), spark.createDataFrame(docs, DOCS)
    got = {}
    for r in ocr.found(spark, df, meta).collect():
        got.setdefault(r.id, set()).add(r.defect)
    assert got.pop("m1") == {"misread"} and got.pop("h1") == {"hyphen_break"} and "h2" not in got
    scans = {f"s{d}p{p}" for d in range(100, 130) for p in range(1, 5)}
    assert set(got) == scans
    assert sum(got[s] == {"running_line", "page_number"} for s in scans) >= 0.95 * len(scans)
    pages = {(r.doc_id, r.page_number): r.paragraphs for r in ocr.paragraphs(df, meta).collect()}
    text = " ".join(pages[200, None])
    assert "pressure" in text and "pre55ure" not in text and "treatment and" in text and "double-blind" in text
    assert not any("Journal Tests" in x or "- 12 -" in x for x in pages[100, 2])


def test_empty(spark):
    df, meta = spark.createDataFrame([], CHUNKS), spark.createDataFrame([], DOCS)
    assert ocr.found(spark, df, meta).count() == 0 and ocr.paragraphs(df, meta).count() == 0


def test_perceptron_separates():
    rows = [({"a": 1.0, "bias": 1.0}, ["x", "y", "z"], "x"), ({"b": 1.0, "bias": 1.0}, ["x", "y", "z"], "y"), ({"a": 1.0, "b": 1.0, "bias": 1.0}, ["x", "y", "z"], "z")] * 10
    w = ocr.averaged_perceptron(rows)
    for features, labels, right in rows[:3]:
        found = ocr.scores_of(features, labels, w)
        assert max(labels, key=found.get) == right


def spelt(word, ops):
    out = ""
    for ch, op in zip("^" + word, ops, strict=True):
        kind, _, x = op.partition(":")
        out += {"keep": ch, "delete": "", "replace": x, "insert": ch + x}[kind]
    return out[1:]


def test_operations_make_the_other_word():
    rng = random.Random(1)
    for wrong, right in [("rnan", "man"), ("man", "rnan"), ("abc", "abc"), ("", "a"), ("a", ""), ("clcar", "clear"), ("vvith", "with")]:
        assert spelt(wrong, ocr.operations(wrong, right)) == right
    for _ in range(500):
        a, b = ("".join(rng.choice("abcr") for _ in range(rng.randint(0, 7))) for _ in range(2))
        assert spelt(a, ocr.operations(a, b)) == b
    assert ocr.operations("rnan", "man") == ["keep", "replace:m", "delete", "keep", "keep"]
    assert ocr.operations("ab", "acb") == ["keep", "insert:c", "keep"]


def test_editor_on_held_out_words():
    """Taught on some words with confused letters and some real pairs; judged on others."""
    rng = random.Random(6)
    letters = "abcdefghiklmnoprstuvw"
    words = ["".join(rng.choice(letters) for _ in range(8)) for _ in range(600)]
    rare, common = ocr.word_features("x", 1, 0, 500), ocr.word_features("x", 40, 40, 900)
    edits = [(w.replace("e", "c", 1), w, w, rare) for w in words if "e" in w]
    kept = [(w, w, w[:-1] + "s", common) for w in words if not w.endswith("s")]
    editor = ocr.Editor.taught(edits[::2] + kept[::2])
    gain = lambda w, other, about: editor.gain(w, ocr.operations(w, other), about)
    assert sum(gain(w, o, a) > 0 for w, _, o, a in edits[1::2]) >= 0.95 * len(edits[1::2])
    assert sum(gain(w, o, a) <= 0 for w, _, o, a in kept[1::2]) >= 0.95 * len(kept[1::2])
    assert gain("word", "word", rare) == 0


def test_words_and_parts_of_compounds_with_every_hyphen_and_of_chinese_texts(spark):
    texts = ["beta-blocker plain", "beta‐blocker", "beta¬blocker", "beta­blocker", "hyper-\ntension risk", "高血压 risk-free", "no compound é"]
    rows = spark.createDataFrame([(str(i), False, t) for i, t in enumerate(texts)], "id string, wrapped boolean, text string")
    got = {r.id: r.words for r in ocr.tokenised(rows).collect()}
    assert got["0"] == ["beta-blocker", "plain"] and got["4"] == ["hyper\u0001-\u0001tension", "risk"] and got["6"] == ["no", "compound", "é"]
    assert [w for w in got["5"] if w] == ["risk-free"]
    words = spark.createDataFrame([(i, w) for i, ws in got.items() for w in ws], "id string, w string").where(ocr._hyphened(F.col("w")))
    parts = {r.id: list(r.parts) for r in words.select("id", ocr._parts(F.col("w")).alias("parts")).collect()}
    assert parts == {"0": ["beta", "blocker"], "1": ["beta", "blocker"], "2": ["beta", "blocker"], "3": ["beta", "blocker"], "4": ["hypertension"], "5": ["risk", "free"]}
