"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a sample of labelled text. A text is parsed against it: the longest match
from where the last phrase ended is the next phrase, and a character that follows nothing is a phrase of its own. Few phrases
a character mean that the text repeats what the language says. Phrase counts are normalised to bits a character,
phrases * log2(sample length) / characters, and the language that needs the fewest wins.

The automaton is turned into a table of transitions (a missing one leads to where the character leads from the start, and
counts a phrase), so thousands of stretches of text are parsed abreast, one character a step, in numpy. Texts are cut into
stretches of ``STRETCH`` characters for that. A stretch is parsed as if a phrase began with it; then the state in which the
stretch before really ends is carried into it, until both parses are in one state, which they soon are, and the difference
of their counts corrects the first one. So the count is that of the whole text parsed in one go.

Every language has codes of its own for all characters of its sample; one that the sample lacks is a phrase of its own there.
Tables of more than ``ALPHABET`` codes would be too wide and are kept as sorted lists of the transitions that exist, and so
are all tables where the samples together have more than ``DENSE_CHARS`` characters.

Learning takes ``sample_docs`` documents a language, the first by a hash of doc_id, and whole documents of those until
``sample_chars`` characters; a stretch of the first drawn document that is longer than that fills what room is left. With many
languages each gets an equal share of ``TOTAL_CHARS``, ``LEAST_CHARS`` at the least. So the model's size doesn't depend on the
input, and every labelled language with letters is learnt, whatever their number.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm.common import held, slices, unused

UNDECIDED = "und"
SAMPLE_DOCS = 200
SAMPLE_CHARS = 60_000
#: Characters of all languages' samples together, and of a language where there are so many that its share is less.
TOTAL_CHARS = 1_500_000
LEAST_CHARS = 2_000
STRETCH = 1024
#: Codes up to which a language's transitions are a table of all states and codes, and characters of all samples up to which.
ALPHABET = 96
DENSE_CHARS = 400_000
#: Sharpness of the score: how much a difference of one bit a character counts.
SHARPNESS = 6.0


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that reads every substring of ``codes``; state 0 is the start."""
    nexts: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        cur = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                copy = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return nexts


def transition_table(nexts: list[dict[int, int]], width: int) -> np.ndarray:
    """Row offsets by state and code; complemented where a phrase ends before the code. A code that the sample lacks leads
    to one more state, which every code leaves as if from the start."""
    alone = len(nexts)
    start = np.full(width, alone, np.int32)
    for c, t in nexts[0].items():
        start[c] = t
    start *= width
    table = np.empty((alone + 1, width), np.int32)
    table[:] = ~start
    for state, to in enumerate(nexts):
        row = table[state]
        for c, t in to.items():
            row[c] = t * width
    table[0] = start
    return table.reshape(-1)


class Sparse:
    """The same transitions as sorted keys, for wide alphabets; states are numbers."""

    def __init__(self, nexts: list[dict[int, int]], width: int):
        found = sorted((state * width + c, t) for state, to in enumerate(nexts) for c, t in to.items())
        self.width = width
        self.keys = np.array([k for k, _ in found] + [-1], np.int64)[: max(1, len(found))]
        self.to = np.array([t for _, t in found] + [0], np.int32)
        self.start = np.full(width, len(nexts), np.int32)
        for c, t in nexts[0].items():
            self.start[c] = t

    def step(self, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after the codes ``c``, and where a phrase ended before them."""
        key = state.astype(np.int64) * self.width + c
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.to[at], self.start[c]), ~hit & (state != 0)


class Languages:
    """``samples``: texts by language. Built from a few hundred KB in a Python worker."""

    def __init__(self, samples: dict[str, list[str]]):
        self.names = sorted(samples)
        texts = {k: normal(" ".join(samples[k])) for k in self.names}
        # Codes of the characters of all samples, and for each language its own by those; 0 is any other character.
        chars = np.unique(np.frombuffer("".join(texts.values()).encode("utf-32-le"), "<u4"))
        self.code = np.zeros(0x110000, np.int32)
        self.code[chars] = np.arange(1, len(chars) + 1)
        self.own, self.tables, self.rates = [], [], []
        dense = sum(map(len, texts.values())) <= DENSE_CHARS
        for k in self.names:
            codes = self.codes(texts[k])
            kept = np.unique(codes)
            own = np.zeros(len(chars) + 1, np.int32)
            own[kept] = np.arange(1, len(kept) + 1)
            nexts = suffix_automaton(own[codes].tolist())
            self.own.append(own)
            self.tables.append((transition_table if dense and len(kept) < ALPHABET else Sparse)(nexts, len(kept) + 1))
            self.rates.append(np.log2(max(2, len(codes))))

    def codes(self, text: str) -> np.ndarray:
        return self.code[np.frombuffer(text.encode("utf-32-le"), "<u4")]

    def step(self, k: int, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after the codes ``c`` in language k, and -1 where a phrase ended before them (else 0)."""
        table = self.tables[k]
        if isinstance(table, Sparse):
            to, out = table.step(state, c)
            return to, -out.astype(np.int32)
        to = table[state + c]
        out = to >> 31
        return to ^ out, out

    def phrases(self, codes: list[np.ndarray]) -> np.ndarray:
        """How many phrases each text (none is empty) needs in each language."""
        sizes = np.array([len(c) for c in codes], np.int64)
        starts = np.cumsum(sizes) - sizes
        joined = np.concatenate(codes)
        cuts = -(-sizes // STRETCH)
        owner = np.repeat(np.arange(len(codes)), cuts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        begin, length = starts[owner] + nth * STRETCH, np.minimum(STRETCH, sizes[owner] - nth * STRETCH)
        by = np.argsort(-length, kind="stable")
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        ordered = begin[by]
        live = np.searchsorted(-length[by], -np.arange(length.max()), side="left").tolist()  # stretches longer than t
        later = np.flatnonzero(nth > 0)
        counts = np.empty((len(codes), len(self.names)), np.int64)
        for k, own in enumerate(self.own):
            mapped = own[joined]
            state, count = np.zeros(len(owner), np.int32), np.zeros(len(owner), np.int64)
            for t, n in enumerate(live):
                state[:n], out = self.step(k, state[:n], mapped[ordered[:n] + t])
                count[:n] -= out
            count = count[place]
            if len(later):
                count += self._carried(k, mapped, begin, length, later, state[place])
            # The last phrase ends with the text.
            counts[:, k] = np.bincount(owner, weights=count, minlength=len(codes)) + 1
        return counts

    def _carried(self, k: int, mapped: np.ndarray, begin: np.ndarray, length: np.ndarray, later: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """What to add to the phrases of each stretch if its parse doesn't begin anew but in the state in which the stretch
        before it ends. ``later``: the stretches that aren't the first of their text; ``ends``: states of the fresh parses."""
        known: dict[tuple[int, int], tuple[int, int]] = {}  # (stretch, state before it): state at its end, phrases to add
        fresh = ends.tolist()
        while True:
            # The states are followed as far as they are known; beyond, a stretch's end is taken to be that of its fresh parse.
            after, add, todo = {}, np.zeros(len(begin), np.int64), []
            for i in later.tolist():
                state = after.get(i - 1, fresh[i - 1])
                if (i, state) in known:
                    after[i], add[i] = known[i, state]
                else:
                    todo.append((i, state))
            if not todo:
                return add
            lanes, states = (np.array(x) for x in zip(*todo, strict=True))
            new, old, more = states.astype(np.int32), np.zeros(len(lanes), np.int32), np.zeros(len(lanes), np.int64)
            end, open_, t = ends[lanes].copy(), np.flatnonzero(states != 0), 0
            while len(open_):
                over = length[lanes[open_]] == t
                end[open_[over]] = new[open_[over]]
                open_ = open_[~over]
                c = mapped[begin[lanes[open_]] + t]
                old[open_], was = self.step(k, old[open_], c)
                new[open_], now = self.step(k, new[open_], c)
                more[open_] += was - now
                open_ = open_[old[open_] != new[open_]]
                t += 1
            known.update(zip(todo, zip(end.tolist(), more.tolist(), strict=True), strict=True))


def normal(text: str | None) -> str:
    """Lower case, each run of other characters than letters one space."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le"), "<u4")
    letter = LETTERS[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    out = np.where(letter, codes, 32)[keep]
    return out.astype("<u4").tobytes().decode("utf-32-le").strip()


def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


LETTERS = _letters()


def predict(texts: list[str | None], model: Languages) -> tuple[list[str], list[float]]:
    """The language and a score for each text: the softmax of minus the bits a character. ``und`` and 0 without a letter."""
    names, scores = [UNDECIDED] * len(texts), [0.0] * len(texts)
    if not model.names:
        return names, scores
    codes = [model.codes(normal(t)) for t in texts]
    some = [i for i, c in enumerate(codes) if len(c)]
    if some:
        counts = model.phrases([codes[i] for i in some])
        bits = counts * np.array(model.rates) / np.array([[len(codes[i])] for i in some])
        best = bits.argmin(axis=1)
        share = np.exp(-SHARPNESS * (bits - bits.min(axis=1, keepdims=True)))
        top = 1 / share.sum(axis=1)
        for i, k, s in zip(some, best.tolist(), top.tolist(), strict=True):
            names[i], scores[i] = model.names[k], s
    return names, scores


def learn(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> dict[str, list[str]]:
    """Texts by language from ``labelled`` (doc_id, text, lang); rows without a letter, a language or a doc_id don't count.

    What comes to the driver is ``sample_docs`` rows of numbers a language, and then ``sample_chars`` characters, twice at most.
    """
    spark = labelled.sparkSession
    rows = labelled.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.select("doc_id", "lang", F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("t"), F.length("text").alias("size"), "text")
    # Only numbers are ranked, and each task passes on a bounded number a language, however common the language is.
    order = Window.partitionBy("lang").orderBy("h", "doc_id", "t")
    drawn = rows.drop("text").withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample_docs).orderBy("lang", "n").collect()
    sample_chars = max(min(sample_chars, LEAST_CHARS), min(sample_chars, TOTAL_CHARS // max(1, len({x.lang for x in drawn}))))
    taken, room, long = [], {}, {}
    for x in drawn:
        left = room.setdefault(x.lang, sample_chars)
        if x.size > sample_chars:
            long.setdefault(x.lang, x)
        elif x.size <= left:
            room[x.lang] -= x.size
            taken.append((x, x.size))
    taken += [(x, room[k]) for k, x in long.items() if room[k]]
    if not taken:
        return {}
    wanted = T.StructType([*rows.select("doc_id", "lang", "t").schema.fields, T.StructField("n", T.IntegerType()), T.StructField("take", T.IntegerType())])
    ids = spark.createDataFrame([(x.doc_id, x.lang, x.t, x.n, n) for x, n in taken], wanted)
    first = F.when(F.col("size") > sample_chars, F.greatest(F.lit(1), F.regexp_instr(F.col("text"), F.lit(r"\p{L}")))).otherwise(F.lit(1))
    # A bounded list, so the texts are found by one scan; rows that are alike in all are one.
    found = rows.join(F.broadcast(ids), ["doc_id", "lang", "t"]).select("lang", "n", (F.col("size") > sample_chars).alias("long"), F.substring(F.col("text"), first, F.col("take")).alias("text"))
    samples: dict[str, list[str]] = {}
    for x in sorted(set(found.collect()), key=lambda x: (x.long, x.n, x.text)):
        samples.setdefault(x.lang, []).append(x.text)
    return samples


def _identifier(samples, key: str, names: list[str]):
    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held(key, lambda: Languages(samples.value))
        for batch in slices(batches, "text"):
            found, scores = predict(batch.column("text").to_pylist(), model)
            new = {names[0]: pa.array(found, pa.string()), names[1]: pa.array(scores, pa.float64())}
            yield pa.record_batch([new[n] if n in new else batch.column(i) for i, n in enumerate(batch.schema.names)], names=batch.schema.names)

    return identify


def identify(docs: DataFrame, samples: dict[str, list[str]], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` (with a column text) and lang_pred, score, or what ``names`` has instead. Columns of those names are replaced.

    Null texts and texts without a letter are ``und`` with score 0, and so is everything if nothing was learnt. Equal bits
    go to the language that comes first by name.
    """
    sent = docs.sparkSession.sparkContext.broadcast(samples)
    typed = docs.withColumns({names[0]: F.lit(None).cast("string"), names[1]: F.lit(None).cast("double")})
    return typed.mapInArrow(_identifier(sent, uuid.uuid4().hex, list(names)), typed.schema)


def held_out(docs: DataFrame):
    return (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1).alias("held_out")


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row; learns from the labelled rows that aren't held out."""
    samples = learn(docs.where(~F.coalesce(held_out(docs), F.lit(True))))
    found = identify(docs.select("doc_id", F.coalesce(held_out(docs), F.lit(False)).alias("held_out"), "text"), samples)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, least_score: float = 0.3) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang, other columns) whose language can be told, unchanged: those that are ``und``
    or score under ``least_score`` go. Learns as report() does."""
    name, score = unused(docs, "lang_pred", "score")
    found = identify(docs, learn(docs.where(~F.coalesce(held_out(docs), F.lit(True)))), (name, score))
    return found.where((F.col(name) != UNDECIDED) & (F.col(score) >= least_score)).select(*docs.columns)
