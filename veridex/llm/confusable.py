"""One consistent form of text that looks the same.

1. Ignorable characters go, compatibility forms that look like their plain letters (full width, ligatures, radicals,
   unbreakable and typographic blanks) fold, marks compose. Super- and subscripts, circled and fraction forms stay.
2. Words with letters of several look-alike alphabets become lattices; Viterbi takes the path of best character bigram
   score, with a cost for changing script, under a model counted over all clean words of the same columns.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridex.session import Stage

# Letters of Greek and Cyrillic that look like the Latin letter below them.
LATIN_LOWER = "aceiopsxyjvhw" + "ovup"
OTHER_LOWER = "асеіорѕхујѵһԝ" + "ονυρ"
LATIN_UPPER = "ABEKMHOPCTXYISJ" + "ABEZHIKMNOPTYX"
OTHER_UPPER = "АВЕКМНОРСТХҮІЅЈ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
HYPHENS = "‐‑‒﹣－"
FOLDED_TAGS = {"<wide>", "<narrow>", "<compat>", "<noBreak>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>", "<vertical>", "<small>"}
KEPT = "ſ…‥"

TWIN = dict(zip(OTHER_LOWER + OTHER_UPPER, LATIN_LOWER + LATIN_UPPER, strict=True))
CLASSES: dict[str, list[str]] = {}
for _other, _latin in TWIN.items():
    CLASSES.setdefault(_latin, [_latin]).append(_other)
OPTIONS = {ch: members for members in CLASSES.values() for ch in members}
SWITCH_COST = 9.0
_PLAIN = re.compile(r"[\x20-\x7e]*")
_WORD = re.compile(r"[^\W\d_]+")


def _fold_char(ch: str) -> str:
    if unicodedata.category(ch) == "Cf" or "︀" <= ch <= "️" or ch in "͏ᅟᅠ឴឵ㅤﾠ":
        return ""
    if ch in HYPHENS:
        return "-"
    if ch in KEPT:
        return ch
    if unicodedata.category(ch) == "Zs":
        return " "
    parts = unicodedata.decomposition(ch).split(" ")
    if parts[0] in FOLDED_TAGS and parts[1] != "0020":
        return "".join(_fold_char(chr(int(x, 16))) for x in parts[1:])
    return ch


_FOLDS: dict[str, str] = {}


def fold(text: str) -> str:
    """Step 1: ignorables deleted, look-alike compatibility forms folded, marks composed, outer blanks cut."""
    if _PLAIN.fullmatch(text):
        return text.strip()
    out = []
    for ch in text:
        if ch not in _FOLDS:
            _FOLDS[ch] = _fold_char(ch)
        out.append(_FOLDS[ch])
    return unicodedata.normalize("NFC", "".join(out)).strip()


def script(ch: str) -> str:
    """L, G, C for the three look-alike alphabets, else O; marks and marked letters follow their base letter."""
    base = unicodedata.normalize("NFD", ch)[0]
    code = ord(base)
    if code < 0x250:
        return "L"
    if 0x370 <= code < 0x400 or 0x1F00 <= code < 0x2000:
        return "G"
    return "C" if 0x400 <= code < 0x530 else "O"


class LookAlikes:
    """Viterbi decoder over look-alike lattices. ``counts`` maps (previous, next) letters to occurrences; '^' starts a word."""

    def __init__(self, counts: dict[tuple[str, str], int]):
        self.pairs = counts
        self.heads: dict[str, int] = {}
        self.single: dict[str, int] = {}
        for (a, b), n in counts.items():
            self.heads[a] = self.heads.get(a, 0) + n
            self.single[b] = self.single.get(b, 0) + n
        self.total = sum(counts.values())
        self.known: dict[str, str] = {}

    def score(self, a: str, b: str) -> float:
        """Log probability of b after a; rare pairs lean on how common b is at all."""
        a, b = a.lower(), b.lower()
        alone = (self.single.get(b, 0) + 0.01) / (self.total + 10)
        return math.log((self.pairs.get((a, b), 0) + 2 * alone) / (self.heads.get(a, 0) + 2))

    def word(self, word: str) -> str:
        if word.isascii() or not any(ch in TWIN for ch in word):
            return word
        if word not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[word] = self._decode(word)
        return self.known[word]

    def _decode(self, word: str) -> str:
        paths = {"^": (0.0, "", "")}
        for ch in word:
            after: dict[str, tuple[float, str, str]] = {}
            for option in OPTIONS.get(ch, [ch]):
                kind = script(option)
                best = None
                for last, (cost, text, before) in paths.items():
                    new = cost + self.score(last, option) - (SWITCH_COST if before and kind != before else 0.0)
                    if best is None or new > best[0]:
                        best = (new, text + option, kind)
                after[option] = best
            paths = after
        return max(paths.values(), key=lambda x: (x[0], x[1]))[1]

    def text(self, text: str) -> str:
        return text if text.isascii() else _WORD.sub(lambda m: self.word(m.group()), text)


def letter_model(texts: DataFrame, column: str) -> DataFrame:
    """(a, b, n): letter bigrams over all words of the column that are written in one script, '^' before the first.

    The alphabets bound the result, not the rows. Words are counted before they are taken apart.
    """
    words = texts.select(F.explode(F.regexp_extract_all(F.lower(F.col(column)), F.lit(r"([\p{L}]+)"), F.lit(1))).alias("w")).where(r"w rlike '^([a-zß-ɏ]+|[а-ԯ]+|[α-ώ]+)$'")
    counted = words.groupBy("w").count()
    padded = F.concat(F.lit("^"), "w")
    grams = counted.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.struct(F.substring(padded, i, 1).alias("a"), F.substring(padded, i + 1, 1).alias("b")))).alias("g"), "count")
    return grams.groupBy("g.a", "g.b").agg(F.sum("count").alias("n"))


def canonical(texts: DataFrame, column: str, out: str = "canonical") -> DataFrame:
    """Adds the consistent form of a text column. Null stays null, text of ignorables alone becomes empty.

    The driver gathers the letter model only: at most (letters of three alphabets) squared rows, about 10^5 at worst.
    """
    counts = {(r["a"], r["b"]): r["n"] for r in letter_model(texts, column).collect()}

    @F.pandas_udf("string")
    def consistent(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = LookAlikes(counts)
        for batch in batches:
            yield batch.map(lambda t: None if t is None else model.text(fold(t)))

    plain = F.col(column).rlike(r"^[\x20-\x7e]*$")
    value = F.when(F.col(column).isNull(), F.lit(None).cast("string")).when(plain, F.trim(F.col(column)))
    odd = texts.where(~plain).withColumn(out, consistent(F.col(column)))
    return texts.where(plain | F.col(column).isNull()).withColumn(out, value).unionByName(odd)


def look_alikes(texts: DataFrame, field: str) -> DataFrame:
    """(field, id_a, id_b): rows of (id, text) whose canonical forms are equal but whose characters differ.

    Rows with equal characters are one form, and only forms are paired: a title that a third of all rows share meets each
    of its variants once. Ids are joined to pairs of forms at the end, where the result asks for them. Ids are strings,
    the smaller first; repeated rows count once; null ids and texts take no part.
    """
    stage = Stage(texts.sparkSession, "look-alikes")
    rows = stage.write(texts.where("id is not null and text is not null").select("id", "text", F.xxhash64("text", F.length("text")).alias("f")).distinct())
    forms = canonical(rows.groupBy("f").agg(F.first("text").alias("text")), "text")
    hashed = stage.write(forms.select("f", F.xxhash64("canonical").alias("h"), "canonical"))
    several = hashed.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    kept = stage.write(hashed.join(several, "h", "left_semi"))
    side = lambda end: kept.select(F.col("f").alias(f"f_{end}"), "h", F.col("canonical").alias(f"canonical_{end}"))
    pairs = stage.write(side("a").join(side("b"), "h").where("f_a < f_b and canonical_a = canonical_b").select("f_a", "f_b"))
    named = lambda end: rows.select(F.col("f").alias(f"f_{end}"), F.col("id").alias(f"id_{end}"))
    both = pairs.join(named("a"), "f_a").join(named("b"), "f_b").where("id_a <> id_b")
    out = stage.write(both.select(F.lit(field).alias("field"), F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct())
    stage.drop(rows, hashed, kept, pairs)
    return out


def found(spark: SparkSession, documents: DataFrame, test_set: DataFrame) -> DataFrame:
    """p4_found over documents.title and test_set.question."""
    titles = documents.select(F.col("doc_id").cast("string").alias("id"), F.col("title").alias("text"))
    questions = test_set.select("id", F.col("question").alias("text"))
    return look_alikes(titles, "documents.title").unionByName(look_alikes(questions, "test_set.question"))
