"""Same or near-same questions across splits, by similarity-hash bit fingerprints.

Questions become canonical tokens; equal token strings are one form, and forms with the same content words are one class.
Misspelt words are mapped to their base through shared deletion signatures. Each class gets a weighted 256-bit similarity
hash of its content words, cut into 16 segments. Training classes meet evaluation classes on equal segments, where the
evaluation side also shows every segment with one bit turned: two codes at most 31 bits apart have a segment with at most
one differing bit, so this finds every pair within the radius. Pairs are then verified word by word: what differs may
only be function words, courtesies, misspellings, or words of fixed lists that stand for one another. Classes are dealt by
what verification wants equal, and meet and are verified inside the tasks, so that no candidate is ever written.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridex.llm.confusable import canonical
from veridex.llm.keys import squeezed
from veridex.session import Stage

BITS = 256
SEGMENTS = 16
# Two codes this far apart differ in at most one bit of some segment: 2 * SEGMENTS - 1.
RADIUS = 31
SEEN = 3  # for codes alone, a word of at most so many forms is read as a near word of twice as many
EVALUATION = ("dev", "blind")
BROADCAST_WORDS = 1_000_000  # words that every task may hold with their counts; more are joined
CELL = 20_000  # classes that are dealt into one cell
LARGE = 200_000  # classes of one side with the same fixed part that a task takes at a time
BRUTE = 256  # so many training classes with the same fixed part are compared one by one
PAIRS = 1_000_000  # pairs of codes that a task holds at a time

# Words that carry no clinical content, and courtesies around a question.
FUNCTION = frozenset(
    """a an the of in on for to with by at from as and or is are was were be been being has have had who whom which what that this these those it its
    does do did can may might could would should will shall i you we they he she me my your our their there here when where how if then than so
    over within during about into upon per via also please kindly cite sources source references thanks thank question query q quick check explain
    like know tell want need ask asking regarding hello hi dear
    el la los las un una unos unas de del en con por para al y o u e que qué cuál cuáles cual cuales cómo como es son fue fueron se lo le les su sus
    esta este estos estas favor gracias citar fuentes consulta pregunta quisiera saber hola
    le les une des du dans avec pour par et ou est sont que qui quel quelle quels quelles ce cette ces merci veuillez citer question
    der die das den dem des ein eine einer eines einem einen und oder ist sind von vom zu zum zur im in mit für auf bei nach welche welcher welches wie was bitte danke frage quellen
    的 了 是 否 请 问 谢 吗 呢 吧 在 与 和 或 对 于 中 有 哪 些 什 么 如 何 怎 样 题 想 解 给 出 来 源 能 其 之 及 以 为 可""".split()
)
# Tails in brackets that stand on any question; only the whole tail is left out, never its words elsewhere.
TAILS = ("adults only",)
# The letters of a tail's words, one more or less, so that a misspelt tail is one too.
TAIL = r"\((?:" + "|".join(" ".join(f"[{w}]{{{len(w) - 1},{len(w) + 1}}}" for w in tail.split()) for tail in TAILS) + r")\)"
# Words of a question's frame that stand for one another.
ALIKE = {
    word: group[0]
    for group in (
        "adding addition add|despite spite notwithstanding|compared versus vs against|large big great|safe harmless|supports backs support|improve better|say says report reports state states|switching changing|replace substitute"
        "|improved bettered betterd|indica señala muestra|apoya respalda|atendidas atendidos|tras después|mejora reduce"
    ).split("|")
    for group in [group.split()]
    for word in group
}
# Chinese words of the frame that stand for one another, sign by sign.
ALIKE_HAN = {"指明": "说明", "指出": "说明"}
# Denials and number words; they are never another word misspelt.
NEGATION = frozenset(
    """no not never none neither nor non without zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen
    seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand half once twice
    ni nunca jamás sin ningún ninguno ninguna nadie nada tampoco cero uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince
    dieciséis veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien ciento mil medio media
    ne pas jamais sans aucun aucune rien zéro deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente
    quarante cinquante soixante cent mille demi demie
    nicht kein keine keinen keinem keiner keines nie niemals ohne weder noch null eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn
    zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend halb
    不 无 未 非 没 勿 别 零 一 二 三 四 五 六 七 八 九 十 百 千 万 两 双 半""".split()
)
TOKEN = "(" + TAIL + r"|[\p{L}&&[^\p{IsHan}]]+|\d+(?:[.,]\d+)*|\p{IsHan})"


def questions(records: DataFrame) -> DataFrame:
    """(id, part, split, source, question) of distinct records in train, dev or blind; others and null texts take no part."""
    split = squeezed(F.col("split"))
    part = F.when(split == "train", "train").when(split.isin(*EVALUATION), "eval")
    return records.select("id", part.alias("part"), split.alias("split"), F.coalesce("source", F.lit("")).alias("source"), "question").where("id is not null and part is not null and question is not null").distinct()


def with_forms(rows: DataFrame) -> DataFrame:
    """Adds tokens of the canonical text and form, the hash of their sequence."""
    tokens = F.regexp_extract_all(F.lower(F.col("canonical")), F.lit(TOKEN), F.lit(1))
    return canonical(rows, "question").withColumn("tokens", tokens).withColumn("form", F.xxhash64(F.concat_ws(" ", "tokens"), F.size("tokens"))).drop("canonical", "question")


def document_frequency(forms: DataFrame) -> DataFrame:
    """(token, df) over all forms."""
    return forms.select("form", F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def misspellings(frequency: DataFrame, ratio: int = 10, least: int = 4) -> DataFrame:
    """(token, base, sure): words one edit or swap away from a more frequent word.

    A base at least ``ratio`` times as frequent is sure. Words of at most SEEN forms also get a base twice as frequent,
    which only codes use. Words that share a string after at most one deletion are at most two edits apart; the distance
    is then checked.
    """
    words = frequency.where(F.col("token").rlike(r"^\p{L}+$") & (F.length("token") >= least))
    cuts = F.transform(F.sequence(F.lit(1), F.length("token")), lambda i: F.concat(F.substring("token", F.lit(1), i - 1), F.substring("token", i + 1, F.length("token"))))
    signed = words.select("token", "df", F.explode(F.array_distinct(F.concat(F.array("token"), cuts))).alias("sign"))
    # a base is at least twice as frequent as another word, so words of one form are none
    a, b = signed.select("sign", "token", "df"), signed.where("df >= 2").select("sign", F.col("token").alias("base"), F.col("df").alias("base_df"))
    sure = F.col("base_df") >= ratio * F.col("df")
    close = sure | ((F.col("df") <= SEEN) & (F.col("base_df") >= 2 * F.col("df")))
    near = a.join(b, "sign").where((F.col("token") != F.col("base")) & ~F.col("token").isin(*sorted(NEGATION)) & close).select("token", "base", "base_df", sure.alias("sure")).distinct()
    swapped = (F.length("token") == F.length("base")) & (F.array_sort(F.split("token", "")) == F.array_sort(F.split("base", "")))
    near = near.where((F.levenshtein("token", "base") <= 1) | ((F.levenshtein("token", "base") == 2) & swapped))
    return near.groupBy("token").agg(F.max(F.struct("base_df", "base", "sure")).alias("x")).select("token", F.col("x.base").alias("base"), F.col("x.sure").alias("sure"))


def _han_alike(tokens: Column) -> Column:
    text = F.array_join(tokens, "\x1f")
    for word, other in ALIKE_HAN.items():
        text = F.replace(text, F.lit("\x1f".join(word)), F.lit("\x1f".join(other)))
    return F.split(text, "\x1f")


def _listed(forms: DataFrame, known: DataFrame, stage: Stage) -> DataFrame:
    """(form, words, nears): content words of each form and what codes read for them, from (token, word, near) of the tokens
    that are read as another word. A few are looked up where a form is read, many are joined."""
    alike = F.create_map(*[F.lit(x) for pair in ALIKE.items() for x in pair])
    same = lambda c: F.coalesce(alike[c], c)
    mine = F.filter(_han_alike(F.col("tokens")), lambda t: ~t.isin(*sorted(FUNCTION)) & ~t.rlike(TAIL))
    if known.count() > BROADCAST_WORDS:
        spread = forms.select("form", F.explode(mine).alias("token")).join(known, "token", "left").select("form", F.coalesce("word", "token").alias("word"), F.coalesce("near", "token").alias("near"))
        listed = spread.groupBy("form").agg(F.collect_list(F.struct("word", "near")).alias("x")).select("form", F.col("x.word").alias("words"), F.col("x.near").alias("nears"))
    else:
        table = known.select("token", "word", "near").toPandas()
        shared = forms.sparkSession.sparkContext.broadcast({t: (w, n) for t, w, n in table.itertuples(index=False)})

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = batch.column("tokens")
                flat = own.flatten().to_pylist()
                both = [shared.value.get(t, (t, t)) for t in flat]
                offsets = pa.array(np.concatenate([[0], np.cumsum(own.value_lengths().to_numpy())]), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array([x[i] for x in both], pa.string())) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column("form"), *lists], names=["form", "words", "nears"])

        listed = forms.select("form", mine.alias("tokens")).mapInArrow(read, "form long, words array<string>, nears array<string>")
    each = F.filter(F.transform(F.arrays_zip("words", "nears"), lambda x: F.struct(same(x["words"]).alias("word"), same(x["nears"]).alias("near"))), lambda x: ~x["word"].isin(*sorted(FUNCTION)))
    return stage.write(listed.select("form", each.alias("x")).select("form", F.col("x.word").alias("words"), F.col("x.near").alias("nears")).where(F.size("words") > 0))


def _counted(listed: DataFrame, names: dict[str, str], stage: Stage) -> DataFrame:
    """Adds, for each column of words, a column with the number of forms that have the word. Words of one form only aren't
    gathered; the others are looked up where a form is read, or joined if they are many."""
    for column, out in names.items():
        several = stage.write(listed.select(F.explode(F.array_distinct(column)).alias("word")).groupBy("word").agg(F.count("*").alias("df")).where("df > 1"))
        if several.count() > BROADCAST_WORDS:
            at = listed.select("form", F.posexplode(column).alias("at", "word")).join(several, "word", "left")
            lists = at.groupBy("form").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("df", F.lit(1)).alias("df")))).alias("x")).select("form", F.col("x.df").alias(out))
            listed = stage.write(listed.join(lists, "form"))
            continue
        table = several.toPandas()
        shared = listed.sparkSession.sparkContext.broadcast(dict(zip(table["word"], table["df"].tolist(), strict=True)))
        kinds = ", ".join(f"{c} {k}" for c, k in listed.dtypes)

        def look(batches: Iterator[pa.RecordBatch], shared=shared, column=column, out=out) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = batch.column(column)
                dfs = pa.array([shared.value.get(w, 1) for w in own.flatten().to_pylist()], pa.int64())
                offsets = pa.array(np.concatenate([[0], np.cumsum(own.value_lengths().to_numpy())]), pa.int32())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, dfs)], names=[*batch.schema.names, out])

        listed = listed.mapInArrow(look, f"{kinds}, {out} array<long>")
    return listed


def content(forms: DataFrame, base: DataFrame) -> DataFrame:
    """(form, class, words, dfs, coded, weights), written: content words in their base spelling with their form counts, sorted,
    and the words of the code with their squared inverse frequency. Forms of function words alone have no row."""
    stage = Stage(forms.sparkSession, "content")
    # a base may itself be read as a more frequent word, once
    twice = base.join(base.select(F.col("token").alias("base"), F.col("base").alias("further")), "base", "left").select("token", "base", "sure", F.coalesce("further", "base").alias("near"))
    known = stage.write(twice.select("token", F.when(F.col("sure"), F.col("base")).otherwise(F.col("token")).alias("word"), "near"))
    listed = _listed(forms, known, stage)
    counted = _counted(listed, {"words": "dfs", "nears": "near_dfs"}, stage)
    total = F.lit(float(forms.count()))
    w = F.sort_array(F.transform(F.arrays_zip("words", "dfs"), lambda x: F.struct(x["words"].alias("word"), x["dfs"].alias("df"))))
    several = F.filter(F.arrays_zip("nears", "near_dfs"), lambda x: x["near_dfs"] > 1)
    c = F.sort_array(F.transform(several, lambda x: F.struct(x["nears"].alias("word"), F.pow(F.log((total + 1) / x["near_dfs"]), 2).alias("weight"))))
    rows = counted.select("form", w.alias("w"), c.alias("c")).select("form", F.col("w.word").alias("words"), F.col("w.df").alias("dfs"), F.col("c.word").alias("coded"), F.col("c.weight").alias("weights"))
    contents = Stage(forms.sparkSession, "contents").write(rows.withColumn("class", F.xxhash64("words", F.size("words"))))
    stage.clear()
    return contents


def _bits(words: list[str]) -> np.ndarray:
    codes = b"".join(xxhash.xxh3_128_digest(w, seed=s) for w in words for s in (1, 2))
    return np.unpackbits(np.frombuffer(codes, dtype=np.uint8)).reshape(len(words), BITS).astype(np.float32) * 2 - 1


def fixed_part(words: list[str]) -> int:
    """Equal for questions with the same content: of the words that spelling can't change, and how many words aren't Chinese."""
    fixed = sorted({w for w in words if w in NEGATION or not w.isalpha()})
    return xxhash.xxh3_64_intdigest("\x1f".join([*fixed, str(sum(1 for w in words if not _HAN.match(w)))])) >> 1


def fingerprints(classes: DataFrame) -> DataFrame:
    """(class, code, fixed): 256-bit similarity hash as 32 bytes, and the hash of what verification wants equal.

    A word that only one form has can't agree with any other form and is left out of the sum; classes without any other
    word have no fingerprint, they match as equal classes only.
    """

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, words, coded, weights in zip(pdf["class"], pdf["words"], pdf["coded"], pdf["weights"], strict=True):
                if len(coded):
                    total = np.asarray(weights, dtype=np.float32) @ _bits(list(coded))
                    out.append((name, np.packbits((total > 0).astype(np.uint8)).tobytes(), fixed_part(list(words))))
            yield pd.DataFrame(out, columns=["class", "code", "fixed"])

    return classes.select("class", "words", "coded", "weights").mapInPandas(code, "class long, code binary, fixed long")


def segments(codes: DataFrame, turned: bool) -> DataFrame:
    """(block, class) for each segment of a code, and for each segment with one bit turned if asked for.

    A block also holds what verification wants equal, so few different classes share one.
    """
    width = BITS // SEGMENTS
    value = lambda i: F.conv(F.hex(F.substring("code", i * width // 8 + 1, width // 8)), 16, 10).cast("int")
    each = codes.select("class", "fixed", F.posexplode(F.array(*[value(i) for i in range(SEGMENTS)])).alias("at", "value"))
    if turned:
        each = each.withColumn("value", F.explode(F.array(F.col("value"), *[F.col("value").bitwiseXOR(F.lit(1 << b)) for b in range(width)])))
    return each.select("class", F.xxhash64("at", "value", "fixed").alias("block"))


def candidates(codes: DataFrame, parts: DataFrame) -> DataFrame:
    """(train_class, eval_class): different classes that share a block; all within the radius are among them, each once."""
    train = segments(codes.join(parts.where("part = 'train'").select("class"), "class"), False).withColumnRenamed("class", "train_class")
    held = segments(codes.join(parts.where("part = 'eval'").select("class"), "class"), True).withColumnRenamed("class", "eval_class")
    return train.join(held, "block").where("train_class <> eval_class").select("train_class", "eval_class").distinct()


def edit_distance(a: str, b: str, most: int = 2) -> int:
    """Edits with swaps of neighbours; stops beyond ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            value = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                value = min(value, last[j - 2] + 1)
            row.append(value)
        if min(row) > most:
            return most + 1
    return row[-1]


_HAN = re.compile(r"[㐀-鿿]")


def differences(a: list[str], b: list[str], df_a: list[int], df_b: list[int]) -> tuple[list[str], list[str]]:
    """Content words that are in one question only, after misspellings are matched; empty lists for the same content."""
    left, right = list((Counter(a) - Counter(b)).elements()), list((Counter(b) - Counter(a)).elements())
    df = {**dict(zip(a, df_a, strict=True)), **dict(zip(b, df_b, strict=True))}
    names = 0  # pairs that only their spelling calls equal; one may be a misspelt name, two are other names
    for x in left.copy():
        if len(x) < 4 or not x.isalpha() or _HAN.match(x) or x in NEGATION:
            continue
        for y in right:
            if not y.isalpha() or _HAN.match(y) or y in NEGATION:
                continue
            rare = min(df[x], df[y]) * 20 <= max(df[x], df[y])
            d = edit_distance(x, y)
            if (d <= 1 and rare) or (d <= 2 and rare and len(x) >= 7) or (d <= 1 and len(x) >= 5 and not names):
                names += not rare
                left.remove(x)
                right.remove(y)
                break
    # a Chinese character typed twice
    left = [x for x in left if not (_HAN.match(x) and x in b)]
    right = [y for y in right if not (_HAN.match(y) and y in a)]
    # one character of a Chinese text dropped, unless it denies or counts
    one = left if not right else right if not left else []
    if len(one) == 1 and _HAN.match(one[0]) and one[0] not in NEGATION:
        return [], []
    return left, right


def same_content(a: list[str], b: list[str], df_a: list[int], df_b: list[int]) -> bool:
    """Whether nothing of content differs; most pairs fail by their first word without a near spelling."""
    left, right = set(a) - set(b), set(b)
    if len(right) == len(b):  # no word twice, so what both have can't stand for another word
        right = right - set(a)
    for x in left:
        if not _HAN.match(x) and not any(edit_distance(x, y) <= 2 for y in right):
            return False
    return differences(a, b, df_a, df_b) == ([], [])


def verified(pairs: DataFrame, codes: DataFrame, classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(train_class, eval_class) of the candidates within the Hamming radius whose content is the same."""
    rows = codes.join(classes.select("class", "words", F.col("dfs").cast("array<int>").alias("dfs")), "class")
    side = lambda name, end: rows.select(F.col("class").alias(name), *[F.col(c).alias(f"{c}_{end}") for c in ("code", "words", "dfs")])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bits = lambda c, pdf=pdf: np.unpackbits(np.frombuffer(b"".join(pdf[c]), dtype=np.uint8).reshape(len(pdf), -1), axis=1)
            keep = (bits("code_a") != bits("code_b")).sum(axis=1) <= radius if len(pdf) else []
            near = pdf[keep] if len(pdf) else pdf
            same = [same_content(list(a), list(b), list(x), list(y)) for a, b, x, y in zip(near["words_a"], near["words_b"], near["dfs_a"], near["dfs_b"], strict=True)]
            yield near.loc[np.array(same, dtype=bool), ["train_class", "eval_class"]]

    both = pairs.join(side("train_class", "a"), "train_class").join(side("eval_class", "b"), "eval_class")
    return both.mapInPandas(compare, "train_class long, eval_class long")


def _bytes_of(codes: pa.ChunkedArray) -> np.ndarray:
    """Codes as rows of four numbers."""
    return np.frombuffer(b"".join(codes.to_pylist()), dtype=np.uint64).reshape(len(codes), BITS // 64)


def within(fixed_a: np.ndarray, codes_a: np.ndarray, fixed_b: np.ndarray, codes_b: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and b of all pairs with the same fixed part whose codes are at most ``radius`` <= RADIUS bits apart, each once.

    Of few rows with one fixed part all pairs are compared; else those that share a segment with at most one bit turned.
    """
    order = np.argsort(fixed_a, kind="stable")
    fixed_a, codes_a = fixed_a[order], codes_a[order]
    lo, hi = np.searchsorted(fixed_a, fixed_b, "left"), np.searchsorted(fixed_a, fixed_b, "right")
    found: list[np.ndarray] = [np.zeros(0, dtype=np.int64)]
    size = max(1, len(fixed_b))

    def compare(starts: np.ndarray, counts: np.ndarray, b: np.ndarray, a: np.ndarray | None = None) -> None:
        """Rows a[start], a[start + 1], ... of each b, a part at a time."""
        some = np.flatnonzero(counts)
        starts, counts, b = starts[some], counts[some], b[some]
        ends = np.cumsum(counts)
        at = 0
        while at < len(b):
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
            n = counts[at:to]
            x = np.arange(n.sum()) + np.repeat(starts[at:to] - (np.cumsum(n) - n), n)
            x = x if a is None else a[x]
            y = np.repeat(b[at:to], n)
            near = np.bitwise_count(codes_a[x] ^ codes_b[y]).sum(axis=1) <= radius
            found.append(x[near] * size + y[near])
            at = to

    few = hi - lo <= BRUTE
    compare(lo[few], (hi - lo)[few], np.flatnonzero(few))
    many = np.flatnonzero(~few)
    many = many[np.argsort(lo[many], kind="stable")]
    width = BITS // SEGMENTS
    parts_a, parts_b = (np.ascontiguousarray(c).view(np.uint16) for c in (codes_a, codes_b))
    for own in np.split(many, np.flatnonzero(np.diff(lo[many])) + 1) if len(many) else []:
        first, last = lo[own[0]], hi[own[0]]
        before = len(found)
        for s in range(SEGMENTS):
            value = parts_a[first:last, s]
            rows = first + np.argsort(value, kind="stable")
            start = np.concatenate([[0], np.cumsum(np.bincount(value, minlength=1 << width))])
            for turned in [0, *[1 << bit for bit in range(width)]]:
                met = parts_b[own, s] ^ np.uint16(turned)
                compare(start[met], start[met.astype(np.int64) + 1] - start[met], own, rows)
            found[before:] = [np.unique(np.concatenate(found[before:]))] if len(found) > before else []
    keys = np.unique(np.concatenate(found))
    return order[keys // size], keys % size


def meeting(train: pa.Table, held: pa.Table) -> pa.Table:
    """(train_class, eval_class) with the same content among the rows (class, fixed, code, words, dfs) of a cell."""
    pairs: list[tuple[int, int]] = []
    if len(train) and len(held):
        number = lambda t, c: t.column(c).to_numpy()
        i, j = within(number(train, "fixed"), _bytes_of(train.column("code")), number(held, "fixed"), _bytes_of(held.column("code")))
        a, b = number(train, "class")[i], number(held, "class")[j]
        i, j, a, b = (x[a != b] for x in (i, j, a, b))
        for at in range(0, len(i), 10_000):
            own = slice(at, at + 10_000)
            sides = [t.column(c).take(pa.array(k[own])).to_pylist() for t, k in ((train, i), (held, j)) for c in ("words", "dfs")]
            pairs += [pair for pair, x, dx, y, dy in zip(zip(a[own].tolist(), b[own].tolist(), strict=True), *sides, strict=True) if same_content(x, y, dx, dy)]
    return pa.table([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], names=["train_class", "eval_class"])


def near_classes(sides: DataFrame, large: int = LARGE) -> DataFrame:
    """(train_class, eval_class): all different classes within the radius whose content is the same, of written rows
    (class, fixed, code, words, dfs, part).

    Both sides are dealt once, by their fixed part. A fixed part that more than ``large`` rows of a side have is cut into
    pieces of about that many, and each piece of one side meets each of the other.
    """
    cells = max(24, -(-sides.count() // CELL))
    count = lambda part: F.count(F.when(F.col("part") == part, 1))
    sizes = sides.groupBy("fixed").agg(count("train").alias("a"), count("eval").alias("b")).where((F.col("a") > large) | (F.col("b") > large))
    pieces = sizes.select("fixed", F.ceil(F.greatest("a", F.lit(1)) / large).cast("int").alias("pa"), F.ceil(F.greatest("b", F.lit(1)) / large).cast("int").alias("pb"))
    dealt = sides.join(F.broadcast(pieces), "fixed", "left")

    def side(part: str, own: str, other: str) -> DataFrame:
        mine, theirs = F.pmod(F.xxhash64("class"), F.col(own)).cast("int"), F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))
        rows = dealt.where(F.col("part") == part).select("class", "fixed", "code", "words", "dfs", own, mine.alias("mine"), theirs.alias("theirs"))
        place = ("mine", "theirs") if part == "train" else ("theirs", "mine")
        cell = F.when(F.col(own).isNull(), F.pmod(F.xxhash64("fixed"), F.lit(cells))).otherwise(F.xxhash64("fixed", *place))
        names = ["class", "fixed", "code", "words", "dfs"]
        return rows.select(*names, cell.alias("cell")).toDF(*names, "cell")  # columns of its own, as both sides come from one table

    return side("train", "pa", "pb").groupBy("cell").cogroup(side("eval", "pb", "pa").groupBy("cell")).applyInArrow(meeting, "train_class long, eval_class long")


def overlaps(records: DataFrame) -> DataFrame:
    """(train_id, eval_id, eval_split, eval_source, exact): all cross-split pairs that ask the same question.

    Distinct ids each count once per pair; empty questions match nothing. Copies share one form and forms of the same
    words one class, so their pairs are joined out only here, where the result asks for them. Each table goes as soon as
    the next one is written, and so do the files of the shuffles between them.
    """
    spark = records.sparkSession
    stage = Stage(spark, "crosssplit")
    texts = stage.write(with_forms(questions(records)).where(F.size("tokens") > 0))
    forms = stage.write(texts.groupBy("form").agg(F.first("tokens").alias("tokens")))
    rows = stage.write(texts.drop("tokens"))
    stage.drop(texts)
    frequency = stage.write(document_frequency(forms))
    base = stage.write(misspellings(frequency))
    stage.drop(frequency)
    contents = content(forms, base)
    stage.drop(forms, base)
    # forms of function words alone are classes of their own
    named = stage.write(rows.join(contents.select("form", "class"), "form", "left").withColumn("class", F.coalesce("class", "form")))
    stage.drop(rows)
    parts = stage.write(named.select("class", "part").distinct())
    # forms of one class have the same words, but may read rare ones differently for the code
    codes = stage.write(fingerprints(contents.select("class", "words", "coded", "weights")).groupBy("class").agg(F.min("code").alias("code"), F.first("fixed").alias("fixed")))
    words = contents.groupBy("class").agg(F.first("words").alias("words"), F.first(F.col("dfs").cast("array<int>")).alias("dfs"))
    sides = stage.write(codes.join(words, "class").join(parts, "class").select("class", "fixed", "code", "words", "dfs", "part"))
    stage.drop(contents, codes)
    near = near_classes(sides)
    equal = parts.where("part = 'train'").join(parts.where("part = 'eval'").select("class"), "class").select(F.col("class").alias("train_class"), F.col("class").alias("eval_class"))
    side = lambda part, name: named.where(f"part = '{part}'").select(F.col("class").alias(f"{name}_class"), F.col("form").alias(f"{name}_form"), F.col("id").alias(f"{name}_id"), F.col("split").alias(f"{name}_split"), F.col("source").alias(f"{name}_source"))
    linked = stage.write(near.union(equal).distinct())
    stage.drop(sides, parts)
    every = linked.join(side("train", "train"), "train_class").join(side("eval", "eval"), "eval_class").where("train_id <> eval_id")
    found = stage.write(every.select("train_id", "eval_id", "eval_split", "eval_source", (F.col("train_form") == F.col("eval_form")).alias("exact")).distinct())
    stage.drop(named, linked)
    return found


def report(records: DataFrame) -> DataFrame:
    """Per evaluation split and source: pairs, exact pairs, and questions of the split that also stand in train."""
    return overlaps(records).groupBy("eval_split", "eval_source").agg(F.count("*").alias("n_pairs"), F.sum(F.col("exact").cast("long")).alias("n_exact"), F.countDistinct("eval_id").alias("n_questions"))


def found(spark, records: DataFrame) -> DataFrame:
    """p2_found: pairs of ids of the same question in train and in dev or blind, the smaller id first."""
    return overlaps(records).select(F.least("train_id", "eval_id").alias("id_a"), F.greatest("train_id", "eval_id").alias("id_b")).distinct()
