"""Noise in text from scanned pages: broken words, misread characters, running lines, page numbers.

Every chunk is taken apart once; words are counted over all chunks and decided on as types. Rare words of scanned pages are
paired, through shared signatures, with far more frequent words, numbers with letters in them with plain numbers. A
character editor, an averaged perceptron that gives each character one of keep, replace, delete, insert and join, is taught
by pairs that the corpus itself labels; a pair is accepted if its operations score above keeping every character, and a
line end in a word is joined or kept by the same model. A second averaged perceptron tells lines at a page's edge apart as
body, running line or page number, from page position, repetition over the pages of the document, distance to the page's
own number and likeness to title, journal and authors. Training samples are bounded; counts and decisions cover all chunks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridex.session import Stage

TRAINING = 8_000  # pairs or lines of each kind that a perceptron is taught with
SELDOM = 8  # a misread word has at least so many occurrences for each one outside of wrapped text
BROADCAST_WORDS = 300_000
MOST_SIGNS = 120
# Character groups that scanners confuse; both sides of a confusion collapse to the same signature.
GROUPS = (("rn", "m"), ("in", "m"), ("ni", "m"), ("cl", "d"), ("ii", "u"), ("vv", "w"), ("li", "h"), ("ri", "n"))
SINGLE_FROM, SINGLE_TO = "0acfb61l|5$9q8", "ooethhiiissggh"
# What may stand for a digit in a misread number.
DIGIT_LIKE = "lIiOoQSsBbGgZzq"
DECIMAL = r"\d+[.,]\d*[lIOSBG]\d*|[lIOSB]\d*[.,]\d+"
HYPHENS = "\\-‐¬\u00ad"
CUT = "\u0001"
WORD = r"[\p{L}\p{N}&&[^\p{IsHan}]]+"
# Both patterns start at a rare sign and look back, so that a scan passes over plain text at full speed.
BREAK = rf"([{HYPHENS}])(?<=[\p{{L}}\p{{N}}][{HYPHENS}])[ \t]*\n[ \t]*(?=[\p{{L}}\p{{N}}])"
WRAPPED = r"\n(?<=[^\n]{14}[^\n.!?。！？:：)）]\n)(?!\n)"
PAGE_NUMBER = r"(?i)^\s*(?:[-–—\[(|]\s*)?(?:page|seite|página|pagina|pág\.|p\.|pp\.|s\.|第)?\s*([0-9lIOoSsbB]{1,5}|[ivxlc]{1,6})\s*(?:页)?(?:\s*(?:/|of|von|de|sur)\s*[0-9]{1,5})?(?:\s*[-–—\])|])?\s*$"
OWNED = r"(?i)©|only\.\s*$|reserved\.?\s*$|\bet al\.\s*$"
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}


Weights = dict[str, dict[str, float]]


def scores_of(features: dict[str, float], labels: list[str], weights: Weights) -> dict[str, float]:
    out = dict.fromkeys(labels, 0.0)
    for f, v in features.items():
        own = weights.get(f)
        if own:
            for label in labels:
                out[label] += v * own.get(label, 0.0)
    return out


def averaged_perceptron(rows: list[tuple[dict[str, float], list[str], str]], turns: int = 6, seed: int = 5) -> Weights:
    """Averaged weights (feature -> label -> weight) of a multiclass perceptron over (features, possible labels, right label)."""
    rng = np.random.default_rng(seed)
    w: Weights = {}
    total: Weights = {}
    step = 1
    for _ in range(turns):
        for i in rng.permutation(len(rows)):
            features, labels, right = rows[i]
            found = scores_of(features, labels, w)
            guess = max(labels, key=lambda x: (found[x], x != right))
            if guess != right:
                for f, v in features.items():
                    own, sums = w.setdefault(f, {}), total.setdefault(f, {})
                    for label, sign in ((right, v), (guess, -v)):
                        own[label] = own.get(label, 0.0) + sign
                        sums[label] = sums.get(label, 0.0) + step * sign
            step += 1
    return {f: {x: v - total[f][x] / step for x, v in own.items()} for f, own in w.items()}


# --- words -----------------------------------------------------------------------------------------------------------


def prepared(chunks: DataFrame) -> DataFrame:
    """Rows with an id and a text, and whether the text is hard-wrapped as pages are, or a page's text of short lines."""
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    short = F.col("page_number").isNotNull() & (F.length("text") <= lines * 95)
    return chunks.where("id is not null and text is not null").select("id", "doc_id", "page_number", "ordinal", "text", (F.col("text").rlike(WRAPPED) | short).alias("wrapped"))


def tokenised(rows: DataFrame) -> DataFrame:
    """(id, wrapped, words, cuts, decimals) of each chunk, read in one pass: distinct lower-case words, hyphenated compounds
    whole and words cut over two lines with their mark between CUT signs; the cut words as written; decimal numbers with a
    letter in them."""
    apart = rf"[^\p{{L}}\p{{N}}{CUT}{HYPHENS}]"
    # signs of one byte alone are no Chinese, which is known without a look at them
    han = (F.octet_length("text") > F.length("text")) & F.col("text").rlike(r"\p{IsHan}")
    split = lambda c: F.when(F.col("han"), F.split(c, rf"(?:{apart}|\p{{IsHan}})+")).otherwise(F.split(c, f"{apart}+"))
    broken = F.col("text").contains("\n")
    marked = rows.select("id", "wrapped", "text", han.alias("han"), F.when(broken, F.regexp_replace("text", BREAK, f"{CUT}$1{CUT}")).otherwise(F.col("text")).alias("marked"))
    listed = marked.select("id", "wrapped", "text", "han", "marked", F.array_distinct(split(F.lower("marked"))).alias("words"))
    cut = F.when(F.col("marked").contains(CUT), F.filter(split(F.col("marked")), lambda w: w.contains(CUT)))
    # a letter in a decimal number leaves a lone letter behind, so few texts need the closer look
    lone = F.arrays_overlap("words", F.array(*map(F.lit, "liosbg")))
    decimal = F.when(lone, F.array_distinct(F.regexp_extract_all("text", F.lit(rf"(?<![\p{{L}}\p{{N}}])({DECIMAL})(?![\p{{L}}\p{{N}}])"), F.lit(1))))
    return listed.select("id", "wrapped", "words", cut.alias("cuts"), decimal.alias("decimals"))


def _hyphened(text: Column) -> Column:
    return text.contains("-") | text.contains("‐") | text.contains("¬") | text.contains("\u00ad")


def _parts(word: Column) -> Column:
    """Words that a compound stands for: a cut word as one, others as their parts."""
    return F.split(F.regexp_replace(word, f"{CUT}[{HYPHENS}]{CUT}", ""), f"[{HYPHENS}]")


def word_counts(tokens: DataFrame) -> DataFrame:
    """(word, scanned, digital): wrapped and other chunks with the word, hyphenated compounds as well as their parts.

    Words cut over two lines are left out, so that the counts judge them independently.
    """
    counted = tokens.select("wrapped", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.count(F.when(F.col("wrapped"), 1)).alias("scanned"))
    plain = F.regexp_replace("word", f"[{HYPHENS}]", "-")
    counted = Stage(tokens.sparkSession, "words").write(counted.where((F.col("word") != "") & ~F.col("word").contains(CUT)).select(plain.alias("word"), "scanned", (F.col("n") - F.col("scanned")).alias("digital")))
    # compounds count for their parts too, which is done on types instead of texts
    parts = counted.where(F.col("word").contains("-")).select(F.explode(F.split("word", "-")).alias("word"), "scanned", "digital").where("word <> ''")
    return counted.unionByName(parts).groupBy("word").agg(F.sum("scanned").alias("scanned"), F.sum("digital").alias("digital"))


def _collapsed(word: Column) -> Column:
    for a, b in GROUPS:
        word = F.replace(word, F.lit(a), F.lit(b))
    return F.translate(word, SINGLE_FROM, SINGLE_TO)


def _signatures(word: Column) -> Column:
    gaps = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.lit("*"), F.substring(word, i + 1, F.length(word))))
    single = [F.concat(F.lit(f"{i}:"), F.replace(word, F.lit(a), F.lit(b))) for i, (a, b) in enumerate(GROUPS)]
    return F.array_distinct(F.concat(F.array(_collapsed(word), *single), gaps))


def operations(wrong: str, right: str) -> list[str]:
    """One operation per character of ^wrong that makes ^right: keep, replace:x, delete, or insert:x after the character.

    The edit is what is left between the common ends; where it shrinks, its first characters are replaced and the rest
    deleted; where it grows, the last one is replaced by what is left.
    """
    i = 0
    while i < min(len(wrong), len(right)) and wrong[i] == right[i]:
        i += 1
    j = 0
    while j < min(len(wrong), len(right)) - i and wrong[-1 - j] == right[-1 - j]:
        j += 1
    x, y = wrong[i : len(wrong) - j], right[i : len(right) - j]
    out = ["keep"] * (len(wrong) + 1)
    if not x:
        if y:
            out[i] = f"insert:{y}"
        return out
    for k, ch in enumerate(x):
        to = y[k:] if k == len(x) - 1 else y[k : k + 1]
        out[1 + i + k] = "keep" if to == ch else f"replace:{to}" if to else "delete"
    return out


def character_features(word: str, k: int, about: dict[str, float]) -> dict[str, float]:
    """The character at place k of ^word$ with its neighbours, and what is known of the word."""
    chars = f"^{word}$$"
    before, ch, after = chars[k - 1 : k] if k else "", chars[k], chars[k + 1]
    kind = lambda c: "9" if c.isdigit() else "a" if c.isalpha() else c
    local = {f"c{ch}": 1.0, f"n{ch}{after}": 1.0, f"p{before}{ch}": 1.0, f"s{kind(before)}{ch}{kind(after)}": 1.0, f"t{before}{ch}{after}": 0.5}
    return {**local, **about}


def word_features(word: str, scanned: int, digital: int, base: int) -> dict[str, float]:
    """What counts say about a word beside the word it may stand for."""
    ratio = base / max(scanned + digital, 1)
    digits = sum(c.isdigit() for c in word)
    return {
        "bias": 1.0, "only scanned": 1.0 if digital * SELDOM <= scanned + digital else -1.0, f"ratio {min(3, int(np.log10(max(ratio, 1))))}": 1.0, "lead": float(np.clip(np.log10(max(ratio, 1)) - 1, -1, 2)), "no base": float(base == 0),
        "mixed": 1.0 * (0 < digits < len(word)), "mostly digits": 1.0 * (2 * digits >= len(word)), "short": 1.0 * (len(word) <= 3),
    }


def edit_features(word: str, k: int, op: str, about: dict[str, float]) -> dict[str, float]:
    """What can be said of an operation that its character was never seen with: its kind, its place, and the word."""
    kind, _, x = op.partition(":")
    return {f"any {kind}": 1.0, f"any {kind} {min(len(x), 3)}": 0.5, "any at start": float(k <= 1), "any at end": float(k >= len(word)), "any digit": float(any(c.isdigit() for c in x) or word[k - 1 : k].isdigit()), **{f"any {f}": v for f, v in about.items()}}


class Editor:
    """The character editor: which operations each character may take, and their weights.

    An operation that its character was never seen with is scored by its kind and by what is known of the word.
    """

    def __init__(self, weights: Weights, options: dict[str, list[str]]):
        self.weights, self.options = weights, options

    @classmethod
    def taught(cls, pairs: list[tuple[str, str, str, dict[str, float]]]) -> Editor:
        """From (word as read, word meant, the other word of the pair, word features).

        Where the operations towards the other word would change a character, the right operation is that one if the
        other word is meant, else keep; a character's possible operations are those it is seen with.
        """
        options: dict[str, set[str]] = {}
        rows = []
        for word, right, other, about in pairs:
            for k, (ch, op) in enumerate(zip("^" + word, operations(word, other), strict=True)):
                if op != "keep":
                    options.setdefault(ch, {"keep"}).add(op)
                    rows.append((character_features(word, k, about), ["keep", op], "keep" if word == right else op))
                    rows.append((edit_features(word, k, op, about), ["keep", "edit"], "keep" if word == right else "edit"))
        return cls(averaged_perceptron(rows), {ch: sorted(ops) for ch, ops in options.items()})

    def gain(self, word: str, ops: list[str], about: dict[str, float]) -> float:
        """Score of the operations over that of keeping every character; an operation never seen with its character rules them out."""
        total = 0.0
        for k, (ch, op) in enumerate(zip("^" + word, ops, strict=True)):
            if op != "keep":
                seen = op in self.options.get(ch, ())
                name = op if seen else "edit"
                found = scores_of(character_features(word, k, about) if seen else edit_features(word, k, op, about), ["keep", name], self.weights)
                total += found[name] - found["keep"]
        return total


DIGITS_FROM, DIGITS_TO = "lioqsbgz", "11005697"


def misread_pairs(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, kept): rare words of scanned pages with a frequent word or number each may stand for, and pairs of words that
    both occur elsewhere, as (word, fix, scanned, digital, base)."""
    stage = Stage(counts.sparkSession, "misread")
    types = counts.where(~F.col("word").contains("-") & (F.length("word") >= 3) & F.col("word").rlike(r"\p{L}"))
    signed = types.select("word", "scanned", "digital", F.explode(_signatures(F.col("word"))).alias("sign"))
    rare = signed.where(f"scanned > 0 and digital * {SELDOM} <= scanned + digital").select("sign", "word", "scanned", "digital")
    base = signed.where("digital >= 2").select("sign", F.col("word").alias("fix"), (F.col("scanned") + F.col("digital")).alias("base"))
    words = rare.join(base, "sign").where((F.col("word") != F.col("fix")) & (F.col("base") >= 8 * F.col("scanned")) & ~F.col("fix").rlike(r"\p{N}")).select("word", "fix", "scanned", "digital", "base").distinct()
    odd = counts.where(f"scanned > 0 and digital * {SELDOM} <= scanned + digital").where(F.col("word").rlike(rf"(?i)^(?=.*\d)(?=.*[{DIGIT_LIKE}])[\d{DIGIT_LIKE}]+$"))
    plain = counts.where(F.col("word").rlike(r"^\d+$")).select(F.col("word").alias("fix"), (F.col("scanned") + F.col("digital")).alias("base"))
    numbers = odd.withColumn("fix", F.translate("word", DIGITS_FROM, DIGITS_TO)).join(plain, "fix", "left").select("word", "fix", "scanned", "digital", F.coalesce("base", F.lit(0)).alias("base"))
    kept = signed.where("digital >= 2").select("sign", "word", "scanned", "digital").join(base, "sign").where(F.col("word") < F.col("fix")).select("word", "fix", "scanned", "digital", "base").distinct()
    return stage.write(words.union(numbers)), kept


def character_editor(pairs: DataFrame, kept: DataFrame) -> Editor:
    """Taught by the corpus: words never seen outside of scanned pages beside a word at least 50 times as frequent (numbers:
    a number seen at all) are edits; words that both occur elsewhere are kept, as are the frequent words themselves."""
    order = F.xxhash64("word", "fix")
    number = F.col("fix").rlike(r"^\d+$")
    sure = pairs.where("digital = 0").where(F.when(number, F.col("base") >= 2).otherwise(F.col("base") >= 50 * F.col("scanned")))
    edits = sure.where(~number).orderBy(order).limit(TRAINING).union(sure.where(number).orderBy(order).limit(TRAINING // 4)).toPandas()
    same = kept.orderBy(order).limit(TRAINING).toPandas()
    rows = [(r.word, r.fix, r.fix, word_features(r.word, r.scanned, r.digital, r.base)) for r in edits.itertuples()]
    # where a kept word occurs must not be all that keeps it, so half of them are taught as if seen on scanned pages only
    rows += [(r.word, r.word, r.fix, {**word_features(r.word, r.scanned, r.digital, r.base), **({"only scanned": 1.0} if i % 2 else {})}) for i, r in enumerate(same.itertuples())]
    return Editor.taught(rows)


def misread_words(pairs: DataFrame, editor: Editor) -> DataFrame:
    """(word, fix): word types that the editor changes, each to the word of its best operations."""

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            gains = [editor.gain(r.word, operations(r.word, r.fix), word_features(r.word, r.scanned, r.digital, r.base)) for r in pdf.itertuples()]
            yield pdf[["word", "fix", "base"]].assign(gain=gains)[np.array(gains) > 0]

    return pairs.mapInPandas(decide, "word string, fix string, base long, gain double").groupBy("word").agg(F.max(F.struct("gain", "base", "fix")).alias("x")).select("word", F.col("x.fix").alias("fix"))


# --- broken words ----------------------------------------------------------------------------------------------------


def line_breaks(tokens: DataFrame) -> DataFrame:
    """(id, left, mark, right): words cut over two lines of a chunk."""
    spread = tokens.where("cuts is not null").select("id", F.explode("cuts").alias("x")).withColumn("x", F.split("x", CUT))
    # a word cut twice gives two breaks
    at = F.explode(F.sequence(F.lit(1), F.size("x") - 2, F.lit(2)))
    cut = spread.where("size(x) >= 3").select("id", "x", at.alias("i"))
    last = lambda c: F.element_at(F.split(c, f"[{HYPHENS}]"), -1)
    first = lambda c: F.element_at(F.split(c, f"[{HYPHENS}]"), 1)
    return cut.select("id", last(F.element_at("x", F.col("i"))).alias("left"), F.element_at("x", F.col("i") + 1).alias("mark"), first(F.element_at("x", F.col("i") + 2)).alias("right")).where("left <> '' and right <> ''")


def join_features(left: str, mark: str, right: str, joined: int, compound: int) -> dict[str, float]:
    """A line end in a word: how often the word stands joined and with the mark elsewhere, the mark, and what follows."""
    lead = np.log1p(joined) - np.log1p(compound)
    return {
        "bias": 1.0, "joined more": 1.0 * (joined > compound), "compound more": 1.0 * (compound > joined), "lead": float(np.clip(lead, -4, 4)), "unseen": 1.0 * (joined == compound == 0), "soft mark": 1.0 * (mark in "¬\u00ad"),
        "upper": 1.0 * right[:1].isupper(), "digit": 1.0 * right[:1].isdigit(), "left digit": 1.0 * left[-1:].isdigit(), f"left length {min(len(left), 6)}": 0.5, f"right length {min(len(right), 6)}": 0.5,
    }


def joins(breaks: DataFrame, counts: DataFrame) -> DataFrame:
    """(left, mark, right, join) per kind of break: whether the mark is no part of the word.

    The editor's operation for the sign at a line end is join or keep. It is taught by breaks whose word stands clearly more
    often joined or clearly more often with the mark; a part of them is taught without these counts, so that marks and
    neighbours alone can decide where a word is seen nowhere else.
    """
    kinds = breaks.select("left", "mark", "right").distinct().withColumn("joined", F.lower(F.concat("left", "right"))).withColumn("compound", F.lower(F.concat_ws("-", "left", "right")))
    n = counts.select("word", (F.col("scanned") + F.col("digital")).alias("n"))
    kinds = kinds.join(n.withColumnRenamed("word", "joined").withColumnRenamed("n", "nj"), "joined", "left").join(n.withColumnRenamed("word", "compound").withColumnRenamed("n", "nc"), "compound", "left").fillna(0, ["nj", "nc"])
    kinds = Stage(breaks.sparkSession, "joins").write(kinds.select("left", "mark", "right", "nj", "nc"))
    sure = kinds.where("(nj >= 3 and nj > 10 * nc) or (nc >= 3 and nc > 10 * nj)").withColumn("join", F.col("nj") > F.col("nc"))
    taught = sure.orderBy(F.xxhash64("left", "mark", "right")).limit(TRAINING).toPandas()
    rows = []
    for i, r in enumerate(taught.itertuples()):
        known = (r.nj, r.nc) if i % 3 else (0, 0)
        rows.append((join_features(r.left, r.mark, r.right, *known), ["join", "keep"], "join" if r.join else "keep"))
    # what is known without any corpus: soft marks, the two clear cases, and what never follows a mark inside a word
    known = lambda right, *args: (join_features(*args), ["join", "keep"], right)
    rows += [known("join", "abcd", "\u00ad", "cdef", 0, 0), known("join", "abcd", "-", "cdef", 9, 0), known("keep", "abcd", "-", "cdef", 0, 9), known("keep", "abcd", "-", "Cdef", 0, 0), known("keep", "abc", "-", "2", 0, 0), known("keep", "2", "-", "cdef", 0, 0)] * max(1, len(rows) // 60)
    weights = averaged_perceptron(rows)

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                found = scores_of(join_features(r.left, r.mark, r.right, r.nj, r.nc), ["join", "keep"], weights)
                out.append(found["join"] > found["keep"])
            yield pdf[["left", "mark", "right"]].assign(join=np.array(out, dtype=bool))

    return kinds.mapInPandas(decide, "left string, mark string, right string, join boolean")


# --- page furniture --------------------------------------------------------------------------------------------------


def edge_lines(rows: DataFrame) -> DataFrame:
    """(id, doc_id, page_number, side, at, line, flows, wide, n): the first and last two lines of pages, from their outer chunks.

    ``at`` counts from the edge. A line of more than MOST_SIGNS signs is a paragraph of unwrapped text and no line of a page.
    The place of a chunk comes from narrow columns, its lines are cut out where it is read.
    """
    lean = rows.where("page_number is not null")
    last = lean.groupBy("doc_id", "page_number").agg(F.max("ordinal").alias("last"), F.min("ordinal").alias("first"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    cut = lean.select("id", "doc_id", "page_number", "ordinal", lines.alias("lines")).select(
        "id", "doc_id", "page_number", "ordinal", F.slice("lines", 1, 3).alias("top"), F.slice(F.reverse("lines"), 1, 3).alias("bottom"), F.size("lines").alias("n"),
        (F.array_max(F.transform("lines", lambda x: F.length(x))) * 0.85).alias("width"),
    )

    def side(name: str) -> Column:
        def row(x: Column, i: Column) -> Column:
            inner = F.get(name, i + 1)  # the next line towards the middle of the page
            flows = inner.rlike(r"^\p{Ll}") if name == "top" else ~inner.rlike(r"[.!?。！？)）:：]\s*$")
            return F.struct(F.lit(name).alias("side"), i.alias("at"), x.alias("line"), F.coalesce(flows, F.lit(False)).alias("flows"), (F.length(x) >= F.col("width")).alias("wide"))

        return F.transform(F.slice(name, 1, 2), row)

    both = F.filter(F.concat(side("top"), side("bottom")), lambda x: F.length(x["line"]) <= MOST_SIGNS)
    spread = cut.select("id", "doc_id", "page_number", "ordinal", "n", F.explode(both).alias("x")).select("id", "doc_id", "page_number", "ordinal", "n", "x.*")
    # most chunks are first on their page; only the other side of several chunks needs the page's range
    placed = spread.join(last, ["doc_id", "page_number"]).where("(side = 'top' and ordinal = first) or (side = 'bottom' and ordinal = last)")
    return placed.select("id", "doc_id", "page_number", "side", "at", "line", "flows", "wide", "n")


def _number_value(line: pd.Series) -> pd.Series:
    pattern = re.compile(PAGE_NUMBER)

    def value(text: str) -> int | None:
        m = pattern.match(text)
        if not m:
            return None
        token = m.group(1)
        if re.fullmatch(r"(?i)[ivxlc]+", token):
            total, last = 0, 0
            for ch in reversed(token.lower()):
                total, last = total + (ROMAN[ch] if ROMAN[ch] >= last else -ROMAN[ch]), max(last, ROMAN[ch])
            return total
        digits = token.translate(str.maketrans("lIOoSsbB", "11005568"))
        return int(digits) if digits.isdigit() else None

    return line.map(value).astype("Int64")


NUMBER_FEATURES = ("bias", "recurs", "recurs often", "own number", "alone", "few", "dressed", "bare", "inner", "deep", "near", "long", "first line", "last line")


def number_features(r) -> dict[str, float]:
    """A line of number shape: how its value lies to the page's own number and to those of the document's other pages."""
    bare = r.line.strip()
    return {
        "bias": 1.0, "recurs": float(r.pages >= 2), "recurs often": float(r.pages >= 3), "own number": float(r.shift == 0), "alone": float(r.numbered_pages <= 1), "few": float(r.numbered_pages <= 2),
        "dressed": float(bool(re.search(r"(?i)[-–—/]|page|seite|p\.|of|第|^\s{5,}", r.line))), "bare": float(bare.isdigit()), "inner": float(r.at > 0), "deep": float(r.n <= 2), "near": float(abs(r.shift) <= 3), "long": float(len(bare) > 12),
        "first line": float(r.side == "top"), "last line": float(r.side == "bottom"),
    }


def page_number_lines(edges: DataFrame) -> DataFrame:
    """(id, doc_id, page_number, side, at, line) of page numbers on lines of their own, by a perceptron.

    Shape and value are features of a line, as is whether its distance to the page's own number, in the same style, recurs on
    other pages. It is taught by lines whose distance recurs on three pages (page numbers) and by lines whose value agrees
    with no other page of a document that has several (none); half of the first are taught as if they were alone.
    """
    numbered = edges.where((F.length("line") <= 60) & F.col("line").rlike(PAGE_NUMBER)).withColumn("value", F.pandas_udf(_number_value, "long")("line")).where("value is not null")
    style = F.concat_ws("/", "side", F.regexp_replace(F.regexp_replace(F.trim("line"), r"\d+", "#"), r"(?i)^[ivxlc]+$", "r"))
    numbered = numbered.withColumn("style", style).withColumn("shift", F.col("value") - F.col("page_number"))
    agree = numbered.groupBy("doc_id", "style", "shift").agg(F.countDistinct("page_number").alias("pages"))
    any_ = numbered.groupBy("doc_id").agg(F.countDistinct("page_number").alias("numbered_pages"))
    rows = Stage(edges.sparkSession, "numbers").write(numbered.join(agree, ["doc_id", "style", "shift"]).join(any_, "doc_id").select("id", "doc_id", "page_number", "side", "at", "line", "shift", "pages", "numbered_pages", "n"))
    order = F.xxhash64("id", "side", "at", "line")
    good = rows.where("pages >= 3").orderBy(order).limit(TRAINING).toPandas()
    poor = rows.where("pages = 1 and numbered_pages >= 3").orderBy(order).limit(TRAINING).toPandas()
    labels = ["number", "body"]
    taught = []
    for i, r in enumerate(good.itertuples()):
        features = number_features(r)
        if i % 2:  # a page number that is alone in its document must be told by its shape and the page's own number
            features |= {"recurs": 0.0, "recurs often": 0.0, "alone": 1.0, "few": 1.0}
        taught.append((features, labels, "number"))
    taught += [(number_features(r), labels, "body") for r in poor.itertuples()]
    # what is known without any corpus: a number that recurs, or equals its page's; and one that agrees with nothing
    known = lambda right, **on: ({"bias": 1.0, **{k.replace("_", " "): v for k, v in on.items()}}, labels, right)
    taught += [known("number", recurs=1.0, few=1.0, bare=1.0), known("number", own_number=1.0, near=1.0, alone=1.0, few=1.0, bare=1.0), known("number", dressed=1.0, alone=1.0, few=1.0), known("body", bare=1.0), known("body", bare=1.0, few=1.0), known("body", bare=1.0, inner=1.0)] * max(1, len(taught) // 200)
    weights = averaged_perceptron(taught)

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for r in pdf.itertuples():
                found = scores_of(number_features(r), labels, weights)
                keep.append(found["number"] > found["body"])
            yield pdf.loc[np.array(keep, dtype=bool), ["id", "doc_id", "page_number", "side", "at", "line"]]

    kinds = dict(rows.dtypes)
    return rows.mapInPandas(decide, ", ".join(f"{c} {kinds[c]}" for c in ("id", "doc_id", "page_number", "side", "at", "line")))


def _plain_words(text: Column) -> Column:
    spaced = F.regexp_replace(F.lower(text), r"(\p{IsHan})", " $1 ")
    return F.filter(F.split(spaced, r"(?U)[^\p{L}\p{N}]+"), lambda w: (F.length(w) > 0) & ~w.rlike(r"^\p{N}+$"))


FURNITURE = ("bias", "repeats", "often", "own", "own_part", "sentence", "sign", "gap", "heading", "starts_low", "flows", "wide", "long", "open_line")


def _furniture_features() -> dict[str, Column]:
    line = F.col("line")
    yes = lambda c: F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))
    return {
        "bias": F.lit(1.0),
        "repeats": yes(F.col("pages") >= 2),
        "often": yes(F.col("pages") >= 3),
        "own": yes((F.col("own") >= 0.85) & (F.col("n_words") >= 2)),
        "own_part": F.coalesce("own", F.lit(0.0)),
        "sentence": yes(line.rlike(r"[.!?。！？,;，；][)\"”]?\s*$") & ~line.rlike(OWNED)),
        "sign": yes(line.rlike(r"(?i)©|\bet al\b|\(19|20\d\d\)|\d{4};\s?\d+|all rights reserved|personal use")),
        "gap": yes(line.rlike(r"^\d+\s{2,}\S|\S\s{2,}\d+\s*$|\s\|\s\d+\s*$|^\d+\s\|\s")),
        "heading": yes(F.col("heading")),
        "starts_low": yes(line.rlike(r"^\s*\p{Ll}")),
        "flows": yes(F.col("flows")),
        "wide": yes(F.col("wide")),
        "long": yes(F.length(line) > 90),
        "open_line": yes(F.col("flows") & F.col("wide") & ~line.rlike(r"\d|©")),
    }


def running_lines(edges: DataFrame, numbers: DataFrame, rows: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, side, at, line) of headers and footers, by a perceptron.

    Lines count by their place after page numbers are set aside. Lines that short lines of unwrapped chunks also show
    are headings or captions. Repetition disregards digits and letter case.
    """
    spark = edges.sparkSession
    stage = Stage(spark, "furniture")
    key = F.xxhash64(F.regexp_replace(F.regexp_replace(F.lower(F.trim("line")), r"\d+", "#"), r"\s+", " "))
    # a header stands before any text: the line above it, if any, is a page number
    flags = numbers.groupBy("id", "side").agg(F.max(F.col("at") == 0).alias("outer"), F.max(F.col("at") == 1).alias("inner"))
    marked = edges.join(flags, ["id", "side"], "left").fillna(False, ["outer", "inner"]).where(~(((F.col("at") == 0) & F.col("outer")) | ((F.col("at") == 1) & F.col("inner"))))
    at_text = F.when((F.col("at") == 1) & F.col("outer"), 0).otherwise(F.col("at"))
    lines = stage.write(marked.select("id", "doc_id", "page_number", "side", "at", at_text.alias("at_text"), "line", key.alias("key"), "flows", "wide", "n"))
    repeated = lines.where("at_text = 0").groupBy("doc_id", "side", "key").agg(F.countDistinct("page_number").alias("pages"))
    short = rows.where("not wrapped").select(F.explode(F.split("text", "\n")).alias("line")).where("length(line) between 1 and 70").withColumn("key", key).groupBy("key").agg(F.count("*").alias("seen")).where("seen >= 3").select("key", F.lit(True).alias("heading"))
    about = documents.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.struct(F.coalesce("title", F.lit("")).alias("t"), F.coalesce("journal", F.lit("")).alias("j"), F.concat_ws(" ", "authors").alias("a"))).alias("m"))
    about = about.select("doc_id", F.array_distinct(_plain_words(F.concat_ws(" ", "m.t", "m.j", "m.a"))).alias("about"))
    words = lines.withColumn("words", _plain_words(F.regexp_replace("line", r"(?i)\bet al\b|for personal use only|all rights reserved", " ")))
    scored = words.join(repeated, ["doc_id", "side", "key"], "left").join(short, "key", "left").join(about, "doc_id", "left")
    own = F.size(F.filter("words", lambda w: F.array_contains(F.col("about"), w))) / F.size("words")
    scored = scored.select("id", "doc_id", "page_number", "side", "at", "at_text", "line", F.when(F.col("at_text") == 0, F.coalesce("pages", F.lit(1))).otherwise(F.lit(1)).alias("pages"), F.coalesce("heading", F.lit(False)).alias("heading"), F.when(F.size("words") > 0, F.coalesce(own, F.lit(0.0))).otherwise(F.lit(0.0)).alias("own"), F.size("words").alias("n_words"), "flows", "wide", "n")
    features = _furniture_features()
    scored = stage.write(scored.select("id", "doc_id", "page_number", "side", "at", "at_text", "line", "pages", "heading", "own", "n", *[c.cast("double").alias(f"f_{f}") for f, c in features.items()]))
    columns = [F.col(f"f_{f}").alias(f) for f in FURNITURE]
    order = F.xxhash64("id", "side", "at", "line")
    good = scored.where("at_text = 0 and pages >= 3 and not heading").where(~F.col("line").rlike(r"[.。]\s*$") | F.col("line").contains("©"))
    poor = scored.where("(at_text = 1 and n >= 6) or heading or (at_text = 0 and pages = 1 and own < 0.5)")
    labels = ["running", "body"]
    taught = []
    for i, row in enumerate(good.orderBy(order).limit(TRAINING).select(*columns).toPandas().to_dict("records")):
        # half of the lines must be told without their repetition
        taught.append((row | {"repeats": 0.0, "often": 0.0} if i % 2 else row, labels, "running"))
    taught += [(row, labels, "body") for row in poor.orderBy(order).limit(TRAINING).select(*columns).toPandas().to_dict("records")]
    # what is known without any corpus, so that a small one can't unlearn it
    known = lambda right, *on: ({"bias": 1.0, **dict.fromkeys(on, 1.0)}, labels, right)
    taught += [known("running", "repeats", "own_part"), known("running", "repeats", "often", "sign"), known("body", "repeats", "wide"), known("body", "repeats", "often", "wide"), known("running", "own", "own_part"), known("running", "sign", "gap"), known("body"), known("body", "starts_low", "flows"), known("body", "sentence"), known("body", "heading", "repeats"), known("body", "sentence", "starts_low", "repeats"), known("body", "flows", "wide", "repeats", "often", "open_line"), known("body", "flows", "repeats"), known("body", "sentence", "repeats"), known("body", "flows", "wide", "repeats", "open_line")] * max(1, len(taught) // 60)
    weights = averaged_perceptron(taught)
    margin = sum((F.lit(weights.get(f, {}).get("running", 0.0) - weights.get(f, {}).get("body", 0.0)) * F.col(f"f_{f}") for f in FURNITURE), F.lit(0.0))
    return scored.where("at_text = 0").where(margin > 0).select("id", "doc_id", "page_number", "side", "at", "line")


# --- results ---------------------------------------------------------------------------------------------------------


class Noise:
    """The decisions over one set of chunks: misread types, breaks, page numbers and running lines."""

    def __init__(self, chunks: DataFrame, documents: DataFrame):
        self.stage = stage = Stage(chunks.sparkSession, "ocr")
        self.rows = prepared(chunks)
        self.tokens = stage.write(tokenised(self.rows))
        self.counts = stage.write(word_counts(self.tokens))
        pairs, kept = misread_pairs(self.counts)
        self.editor = character_editor(pairs, kept)
        self.fixes = stage.write(misread_words(pairs, self.editor))
        self.breaks = stage.write(line_breaks(self.tokens))
        self.joined = stage.write(joins(self.breaks, self.counts))
        self.edges = stage.write(edge_lines(self.rows))
        self.numbers = stage.write(page_number_lines(self.edges))
        self.furniture = stage.write(running_lines(self.edges, self.numbers, self.rows, documents))
        self.small_fixes = self.fixes.count() <= BROADCAST_WORDS

    def misread(self) -> DataFrame:
        """(id, word, fix) of misread words and numbers of all chunks, outside of running lines and page numbers."""
        fixes = F.broadcast(self.fixes) if self.small_fixes else self.fixes
        # no compound has a fix of its own, so only its parts are looked up beside the words
        listed = self.tokens.select("id", F.explode("words").alias("w"))
        single = listed.withColumnRenamed("w", "word").join(fixes, "word")
        parts = listed.where(_hyphened(F.col("w"))).select("id", F.explode(_parts(F.col("w"))).alias("word")).join(fixes, "word")
        hits = single.select("id", "word", "fix").union(parts.select("id", "word", "fix"))
        # decimals are looked at as a whole: the operations that make them plain numbers must beat keeping them
        editor = self.editor

        @F.pandas_udf("string")
        def edited(words: pd.Series) -> pd.Series:
            def one(word: str) -> str | None:
                low = word.lower()
                plain = low.translate(str.maketrans(DIGITS_FROM, DIGITS_TO))
                about = word_features(low, 1, 0, 50)
                return plain if editor.gain(low, operations(low, plain), about) > 0 else None

            return words.map(one)

        decimals = self.tokens.where(F.size("decimals") > 0).select("id", F.explode("decimals").alias("word"))
        decimals = decimals.select("id", F.lower("word").alias("word"), edited("word").alias("fix")).where("fix is not null")
        hits = self.stage.write(hits.union(decimals).distinct())
        # a misread word that stands in a line of furniture only is no damage of the body
        outer = self.furniture.select("id", "line").union(self.numbers.select("id", "line")).select("id", F.explode(F.regexp_extract_all(F.lower(F.col("line")), F.lit(rf"({WORD})"), F.lit(1))).alias("word"))
        outside = outer.join(fixes.select("word"), "word").groupBy("id", "word").agg(F.count("*").alias("outer"))
        hits = hits.join(outside, ["id", "word"], "left")
        plain = hits.where("outer is null").select("id", "word", "fix")
        doubtful = hits.where("outer is not null").join(self.rows.select("id", F.lower(F.col("text")).alias("text")), "id")
        again = doubtful.where(F.size(F.filter(F.regexp_extract_all("text", F.lit(rf"({WORD})"), F.lit(1)), lambda w: w == F.col("word"))) > F.col("outer")).select("id", "word", "fix")
        return plain.union(again).distinct()

    def broken(self) -> DataFrame:
        return self.breaks.join(self.joined.where("join"), ["left", "mark", "right"])


def defects(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, defect): each kind of damage of each chunk id once; clean chunks have no row.

    Rows with null id or text are left out. Several rows of one id count together. Chunks without a page number can hold
    broken and misread words only.
    """
    noise = Noise(chunks, documents)
    kinds = {"hyphen_break": noise.broken(), "misread": noise.misread(), "running_line": noise.furniture, "page_number": noise.numbers}
    out = [df.select("id", F.lit(name).alias("defect")) for name, df in kinds.items()]
    return out[0].union(out[1]).union(out[2]).union(out[3]).distinct()


def paragraphs(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, page_number, paragraphs): repaired paragraphs per page, from the latest row of each chunk id.

    Pages are in chunk order; page-less chunks form a page with a null number. Blank lines part paragraphs, and headings
    stand alone; other line ends are joined, without a blank between Chinese characters.
    """
    noise = Noise(chunks, documents)
    latest = Window.partitionBy("id").orderBy(F.col("updated_at").desc_nulls_last(), F.xxhash64("text"))
    rows = chunks.where("id is not null and text is not null").withColumn("turn", F.row_number().over(latest)).where("turn = 1").select("id", "doc_id", "page_number", "ordinal", "text")
    fixes = noise.misread().groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("word", "fix"))).alias("fixes"))
    dropped = noise.furniture.select("id", "line").union(noise.numbers.select("id", "line")).groupBy("id").agg(F.collect_set("line").alias("dropped"))
    own = noise.breaks.join(noise.joined.where("not join"), ["left", "mark", "right"]).groupBy("id").agg(F.collect_set(F.concat("left", F.lit("\n"), "right")).alias("kept"))

    def repair(text: pd.Series, fix: pd.Series, drop: pd.Series, keep: pd.Series) -> pd.Series:
        split = re.compile(rf"([^\W_]+)[{HYPHENS}][ \t]*\n[ \t]*([^\W_]+)")
        word = re.compile(r"[^\W_]+")

        def cased(old: str, new: str) -> str:
            return new[:1].upper() + new[1:] if old[:1].isupper() else new

        def heads(line: str, after: str, width: int) -> bool:
            """A short line without a closing mark above a line that begins anew is a heading."""
            bare, nxt = line.strip(), after.strip()
            return 0 < len(bare) <= 0.4 * width and bare[-1] not in ".,;:!?。，；：、-‐¬\u00ad" and bool(nxt) and not nxt[0].islower() and not bare[0].islower()

        def one(t: str, f: dict | None, d: list | None, k: list | None) -> list[str]:
            gone, own_marks = set(d if d is not None else ()), set(k if k is not None else ())
            body = [x for x in t.split("\n") if x not in gone]
            width = max(map(len, body), default=0)
            lines = "\n".join(x + "\n" if heads(x, after, width) else x for x, after in zip(body, [*body[1:], ""], strict=True))
            lines = split.sub(lambda m: f"{m[1]}-{m[2]}" if f"{m[1]}\n{m[2]}" in own_marks else m[1] + m[2], lines)
            if f:
                table = dict(f)
                lines = word.sub(lambda m: cased(m[0], table[m[0].lower()]) if m[0].lower() in table else m[0], lines)
            flat = [re.sub(r"(?<=[㐀-鿿，。；：、])\s*\n\s*|\s*\n\s*(?=[㐀-鿿])", "", x) for x in re.split(r"\n\s*\n", lines)]
            return [y for y in (re.sub(r"\s+", " ", x).strip() for x in flat) if y]

        return pd.Series([one(*x) for x in zip(text, fix, drop, keep, strict=True)])

    joined = rows.join(fixes, "id", "left").join(dropped, "id", "left").join(own, "id", "left")
    fixed = joined.select("doc_id", "page_number", "ordinal", "id", F.pandas_udf(repair, "array<string>")("text", "fixes", "dropped", "kept").alias("paragraphs"))
    per_page = fixed.groupBy("doc_id", "page_number").agg(F.sort_array(F.collect_list(F.struct("ordinal", "id", "paragraphs"))).alias("x"))
    return per_page.select("doc_id", "page_number", F.flatten("x.paragraphs").alias("paragraphs"))


def found(spark, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """p5_found."""
    return defects(chunks, documents)
