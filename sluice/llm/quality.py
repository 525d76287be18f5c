"""Quality rules: basic counts, and the divergence of a text from its language's own distributions.

Each language has two reference histograms: shares of character classes, and shares of its common words (all other words
share one bin). Words and both histograms are counted over all documents.
A text's Jensen-Shannon distances (base 2, from 0 to 1) to its language's references must stay within limits that allow for
the chance spread of short texts; texts with fewer words or characters than the guards ask for are too short to judge and
pass.

All of it is DataFrame expressions. The texts are read twice: once to count words by language, and once for all that a text
gives by itself (its profile: counts, characters by class, common words), which is written without the text. The class
histograms are sums of profiles, and the distances are computed from profiles alone. The references are one row a language,
which is broadcast to the profiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import written

SPACES, SYMBOL = r"[\x20\x09-\x0D]+", r"[#*$%&|<>]"
#: Character classes by pattern, after white space; letters that aren't upper case and characters of no class are two more.
CLASSES = (SYMBOL, r"\p{Nd}", r"[.,;:!?'\"()-]", r"\p{Lu}")
#: Common words a language.
COMMON = 40
#: Guards: shorter texts aren't judged by words, or by characters.
LEAST_WORDS = 100
LEAST_CHARS = 200
#: Largest Jensen-Shannon distances of a text that is kept, and what is added to them over the root of the count.
CLASS_LIMIT = 0.2
WORD_LIMIT = 0.16
CLASS_SPREAD = 2.0
WORD_SPREAD = 3.0


def words_of(text: Column) -> Column:
    """Words between ASCII white space, in order."""
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), SPACES), "")


#: Bits of a window's place in a sorted key; the rest are the upper bits of its hash.
_PLACE = 20


def window_hashes(words: Column, size: int = 3) -> Column:
    """64-bit hashes of the windows of ``size`` words, in order."""
    n = F.size(words) - (size - 1)
    hashes = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))
    return F.when(n >= 1, hashes).otherwise(F.array().cast("array<bigint>"))


def sorted_keys(hashes: Column) -> Column:
    """Of hashes that aren't all different: the upper bits of each with its place in the lower ones, sorted; else nothing.
    Plain numbers sort much faster than pairs; what the bits that are left out may change, repeated() sees and mends."""
    keys = F.transform(hashes, lambda h, i: F.shiftleft(F.shiftright(h, _PLACE), _PLACE).bitwiseOR(i.cast("long")))
    none = F.array().cast("array<bigint>")
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), none).when(F.size(hashes) <= 1 << _PLACE, F.sort_array(keys)).otherwise(none)


def repeated(hashes: Column, keys: Column, size: int = 3) -> Column:
    """How many words lie in a window of ``size`` words that occurs twice or more, the first time included. ``keys``:
    sorted_keys() of ``hashes``.

    A window is repeated if a neighbour in the order has its hash. The places, sorted again, cover the words: each adds as many
    as lie beyond the one before. Where different hashes share their upper bits, or there are too many places for a key, pairs
    of hash and place are sorted instead.
    """
    top, place = (lambda x: F.shiftright(x, _PLACE)), (lambda x: x.bitwiseAND(F.lit((1 << _PLACE) - 1)).cast("int"))
    same = lambda a, b: F.coalesce(top(a) == top(b), F.lit(False))
    near = F.filter(keys, lambda x, k: same(F.get(keys, k - 1), x) | same(F.get(keys, k + 1), x))
    cover = lambda p: F.aggregate(p, F.struct(F.lit(-size).alias("last"), F.lit(0).alias("sum")), lambda a, i: F.struct(i.alias("last"), (a["sum"] + F.least(F.lit(size), i - a["last"])).alias("sum")), lambda a: a["sum"])
    covered = lambda p: F.get(F.transform(F.array(F.sort_array(p)), cover), F.lit(0))

    def paired():
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = lambda s: F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
        return F.get(F.transform(F.array(placed), lambda s: covered(F.transform(again(s), lambda x: x["i"]))), F.lit(0))

    def counted(found):
        mixed = F.exists(F.sequence(F.lit(1), F.size(found) - 1), lambda k: same(F.get(found, k - 1), F.get(found, k)) & (F.get(hashes, place(F.get(found, k - 1))) != F.get(hashes, place(F.get(found, k)))))
        return F.when((F.size(found) == 0) | mixed, paired()).otherwise(covered(F.transform(found, place)))

    fast = F.get(F.transform(F.array(near), counted), F.lit(0))
    none = F.lit(0)
    return F.when(F.size(keys) > 0, fast).when(F.size(hashes) > 1 << _PLACE, paired()).otherwise(none).cast("long")


def dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text.cast("string"), F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.transform(F.array(lines), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))[0]


def base(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with __words, __letters, __classes (characters by class), n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed."""
    docs = docs.withColumns({"__words": words_of(F.col("text")), "__letters": letters_of(F.col("text"))})
    docs = docs.withColumns({"__classes": class_counts(F.col("text"), F.col("__words"), F.col("__letters")), "__hashes": window_hashes(F.col("__words"))})
    docs = docs.withColumn("__keys", sorted_keys(F.col("__hashes")))
    docs = docs.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": (F.length(F.coalesce(F.col("text").cast("string"), F.lit(""))) - F.get("__classes", F.lit(0))).cast("long"),
        "n_symbols": F.get("__classes", F.lit(1)),
        "n_dup_lines": dup_lines(F.col("text")),
        "n_repeat_words": repeated(F.col("__hashes"), F.col("__keys")),
    })
    return docs.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).drop("__hashes", "__keys")


def letters_of(text: Column) -> Column:
    """Lower-case runs of letters."""
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}]+"), "")


def class_counts(text: Column, words: Column, letters: Column) -> Column:
    """Characters by class: white space first, then CLASSES, letters that aren't upper case, and all others. ``words`` and
    ``letters``: the text's words and runs of letters, whose lengths give the counts of white space and of letters."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    size, n_letters = F.length(text).cast("long"), F.length(F.array_join(letters, "")).cast("long")
    space = size - F.length(F.array_join(words, ""))
    counts = F.array(space, *[F.regexp_count(text, F.lit(c)).cast("long") for c in CLASSES])
    none = F.lit(0).cast("long")
    lower = lambda x: F.greatest(none, n_letters - F.get(x, F.lit(len(CLASSES))))
    other = lambda x: F.greatest(none, size - n_letters - F.aggregate(F.slice(x, 1, len(CLASSES)), none, lambda s, v: s + v))
    return F.transform(F.array(counts), lambda x: F.concat(x, F.array(lower(x), other(x))))[0]


def common_words(docs: DataFrame) -> DataFrame:
    """(lang, words, word_shares) for each language (the empty string: all texts together): the common words, most frequent
    first, and their shares of all words, behind the share of all others. ``docs``: text, lang.

    Every word of every text is counted; counts are summed up a task before they are shuffled. Rows without a language
    count for all only.
    """
    rows = docs.where(F.col("text").isNotNull()).select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.explode(letters_of(F.col("text"))).alias("word"))
    bins = written(rows.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")), "words")
    every = bins.groupBy("word").agg(F.sum("n").alias("n")).select(F.lit("").alias("lang"), "word", "n")
    bins = bins.where("lang <> ''").unionByName(every)
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    top = bins.withColumn("k", F.row_number().over(first)).where(F.col("k") <= COMMON).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("k", "word", "n"))).alias("top"))
    found = bins.groupBy("lang").agg(F.sum("n").alias("all")).join(top, "lang").select("lang", F.col("top.word").alias("words"), F.transform("top", lambda x: x["n"] / F.col("all")).alias("shares"))
    rest = F.lit(1.0) - F.aggregate("shares", F.lit(0.0), lambda s, x: s + x)
    return written(found.select("lang", "words", F.concat(F.array(rest), "shares").alias("word_shares")), "common-words")


def class_shares(profiled: DataFrame) -> DataFrame:
    """(lang, class_shares) for each language (the empty string: all texts together), from rows of lang and __classes."""
    chars = [F.sum(F.get("__classes", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES) + 3)]
    sums = written(profiled.groupBy(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang")).agg(*chars), "classes")
    every = sums.agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(len(chars))]).where("c0 IS NOT NULL").select(F.lit("").alias("lang"), *[f"c{i}" for i in range(len(chars))])
    bins = [F.col(f"c{i}") for i in range(len(chars))]
    size = F.greatest(F.lit(1), sum(bins[1:], bins[0]))
    return sums.where("lang <> ''").unionByName(every).select("lang", F.array(*[c / size for c in bins]).alias("class_shares"))


def profiles(docs: DataFrame, common: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, lang) without text and with the counts of base(), __classes, n_chars, n_letter_words and
    __common: (bin, n) of the common words of the text's language that it has, bin 0 for all other words.

    A language without common words of its own, or none, is held to those of all texts.
    """
    every = common.where("lang = ''").first() or {"words": []}
    # Most words are longer than any common one and need no look-up.
    longest = common.select(F.max(F.array_max(F.transform("words", F.octet_length)))).first()[0] or 0
    own = common.where("lang <> ''").select(F.col("lang").alias("__lang"), F.col("words").alias("__own"))
    docs = docs.join(F.broadcast(own), F.col("lang").cast("string") == F.col("__lang"), "left")
    docs = base(docs.withColumn("__known", F.coalesce("__own", F.array(*map(F.lit, every["words"])).cast("array<string>"))))
    short = F.filter("__letters", lambda w: F.octet_length(w) <= longest)
    docs = docs.withColumn("__codes", F.sort_array(F.filter(F.transform(short, lambda w: F.array_position("__known", w)), lambda c: c > 0)))
    others = (F.size("__letters") - F.size("__codes")).cast("double")
    bins = F.concat(F.when(others > 0, F.array(F.struct(F.lit(0).alias("bin"), others.alias("n")))).otherwise(F.array().cast("array<struct<bin:int,n:double>>")), runs(F.col("__codes")))
    docs = docs.withColumns({"n_chars": F.length("text").cast("long"), "n_letter_words": F.size("__letters").cast("long"), "__common": bins})
    return docs.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_chars", "n_letter_words", "__classes", "__common")


def references(docs: DataFrame) -> DataFrame:
    """(lang, words, word_shares, class_shares) for each language of ``docs`` (text, lang), and for all texts under the empty
    string. Rows without text count nothing."""
    rows = docs.where(F.col("text").isNotNull()).select("text", "lang")
    counted = rows.select("lang", class_counts(F.col("text"), words_of(F.col("text")), letters_of(F.col("text"))).alias("__classes"))
    return _joined(common_words(rows), class_shares(counted))


def _joined(common: DataFrame, classes: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    found = classes.join(common, "lang", "left")
    return written(found.select("lang", F.coalesce("words", none).alias("words"), F.coalesce("word_shares", F.array(F.lit(1.0))).alias("word_shares"), "class_shares"), "references")


def divergence(counts: Column, shares: Column) -> Column:
    """Jensen-Shannon distance of two histograms: rows (bin from 0, n) of the bins that occur, and the shares of all bins."""
    total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x["n"])
    log = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    def add(state, x):
        p, q = x["n"] / state["total"], F.get(shares, x["bin"])
        m = (p + q) / 2
        return F.struct(state["total"].alias("total"), (state["sum"] + log(p, m) + log(q, m) - q).alias("sum"))

    start = F.struct(F.greatest(total, F.lit(1.0)).alias("total"), F.lit(1.0).alias("sum"))  # a bin that doesn't occur adds its share
    return F.aggregate(counts, start, add, lambda s: F.sqrt(F.greatest(F.lit(0.0), s["sum"] / 2)))


def runs(codes: Column) -> Column:
    """(bin, n) of the values in a sorted array."""
    n = F.size(codes)
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: F.coalesce(F.get(codes, i) != F.get(codes, i - 1), F.lit(True)))
    found = F.transform(F.array(ends), lambda e: F.transform(e, lambda x, k: F.struct(F.get(codes, x - 1).cast("int").alias("bin"), (x - F.coalesce(F.get(e, k - 1), F.lit(0))).cast("double").alias("n"))))
    return F.when(n > 0, F.get(found, F.lit(0))).otherwise(F.array().cast("array<struct<bin:int,n:double>>"))


def judged(profiled: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of profiles() with class_distance, word_distance and kept. ``known``: rows of references().

    Null and empty texts have no words and fail. A language without a reference, or none, is held to that of all texts.
    """
    keys = {"word_shares": [1.0], "class_shares": [0.0] * (len(CLASSES) + 3)}
    every = known.where("lang = ''").first() or keys
    own = known.where("lang <> ''").select(F.col("lang").alias("__lang"), *[F.col(k).alias(f"__own_{k}") for k in keys])
    docs = profiled.join(F.broadcast(own), F.col("lang").cast("string") == F.col("__lang"), "left")
    docs = docs.withColumns({f"__{k}": F.coalesce(F.col(f"__own_{k}"), F.array(*map(F.lit, every[k])).cast("array<double>")) for k in keys})
    classes = F.filter(F.transform("__classes", lambda v, i: F.struct(i.alias("bin"), v.cast("double").alias("n"))), lambda x: x["n"] > 0)
    docs = docs.withColumns({"word_distance": divergence(F.col("__common"), F.col("__word_shares")), "class_distance": divergence(classes, F.col("__class_shares"))})
    chars, words = F.col("n_chars"), F.col("n_letter_words")
    far = (chars >= LEAST_CHARS) & (F.col("class_distance") > CLASS_LIMIT + CLASS_SPREAD / F.sqrt(chars))
    odd = (words >= LEAST_WORDS) & (F.col("word_distance") > WORD_LIMIT + WORD_SPREAD / F.sqrt(words))
    return docs.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far | odd, F.lit(False)))


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and both distances) for every
    row of ``docs`` (doc_id, text, lang)."""
    own = docs.select("doc_id", "text", "lang")
    common = common_words(own)
    profiled = written(profiles(own, common), "profiles")
    known = _joined(common, class_shares(profiled.where(F.col("n_chars").isNotNull())))
    return judged(profiled, known).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")
