"""Benchmark decontamination: an FM-index for each training shard.

A shard is a stretch of rows of one partition. Its words become symbols of the benchmark's vocabulary; a word that no
benchmark item has ends a run of text, as does the end of a document, and runs shorter than the shortest window can't hold
one and are left out. The index of the runs is searched backwards for all windows at once, occurrences are located by
sampled suffix positions, and overlapping ones are merged into spans. An index is built faster than it could be read back, so
none is kept.

There is no shuffle: each row is answered where it lies. The windows are broadcast in parts of at most ``part_bytes`` of
benchmark text, and a Python worker holds one part at a time: each shard is searched for one part after the other, so neither
what a worker holds nor what the driver builds at once grows with the benchmark.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm.common import held, slices
from sluice.llm.fmindex import FMIndex

WINDOW = 10
#: Bytes of benchmark text whose windows are broadcast at once; as symbols and places they take about three times that, and
#: their distinct words about 100 bytes each.
PART_BYTES = 4 << 20
#: Bytes of text of a shard; a longer document is a shard of its own.
SHARD_BYTES = 6 << 20
#: Windows that are searched for abreast.
_ABREAST = 1 << 16
#: a-z, 0-9 and all beyond ASCII stay, A-Z are lower-cased, the rest parts words.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORD_BYTES).split()


class Windows:
    """Distinct windows of benchmark items, by length: where each lies in ``text`` (the items' words as symbols), and the
    items that have it. Rows of one item are one item with all their windows."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.symbol: dict[bytes, int] = {}
        self.names = sorted({item for item, _ in items})
        number = {item: i for i, item in enumerate(self.names)}
        texts, found, end = [np.empty(0, np.int32)], {}, 0
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            texts.append(np.fromiter((self.symbol.setdefault(w, len(self.symbol) + 1) for w in words), np.int32, len(words)))
            m = min(window, len(words))
            starts = np.arange(end, end + len(words) - m + 1)
            found.setdefault(m, []).append((starts, np.full(len(starts), number[item])))
            end += len(words)
        self.text = np.concatenate(texts)
        self.lengths = sorted(found)
        self.starts, self.cuts, self.owners = {}, {}, {}
        for m in self.lengths:
            starts, owner = (np.concatenate(x) for x in zip(*found[m], strict=True))
            rows = np.lib.stride_tricks.sliding_window_view(self.text, m)[starts]
            _, first, which = np.unique(rows.view([("", np.int32)] * m).reshape(-1), return_index=True, return_inverse=True)
            pairs = np.unique(np.stack((which.reshape(-1), owner), axis=1), axis=0)
            self.starts[m] = starts[first]
            self.cuts[m] = np.searchsorted(pairs[:, 0], np.arange(len(first) + 1))
            self.owners[m] = pairs[:, 1].astype(np.int32)

    def patterns(self, m: int) -> Iterator[tuple[int, np.ndarray]]:
        """The windows of m words, some at a time: (number of the first, rows of symbols)."""
        view = np.lib.stride_tricks.sliding_window_view(self.text, m)
        for i in range(0, len(self.starts[m]), _ABREAST):
            yield i, view[self.starts[m][i : i + _ABREAST]]

    def items(self, m: int, which: int) -> Iterator[str]:
        return map(self.names.__getitem__, self.owners[m][self.cuts[m][which] : self.cuts[m][which + 1]].tolist())


def occurrences(texts: list[np.ndarray], windows: Windows) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each window length: (length, window, word position in the joined texts). ``texts``: symbols, 0 for other words."""
    if not windows.lengths or not texts:
        return
    joined = np.concatenate([x for t in texts for x in (t, [0])])
    known = joined != 0
    edge = np.diff(np.concatenate(([0], known.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = ends - starts >= windows.lengths[0]
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return
    sizes = ends - starts + 1  # the 0 behind each run stays
    offsets = np.cumsum(sizes) - sizes
    places = np.arange(sizes.sum()) + np.repeat(starts - offsets, sizes)
    symbols = len(windows.symbol) + 1
    index = FMIndex(joined[places].astype(np.uint16 if symbols < 1 << 16 else np.int32), symbols)
    for m in windows.lengths:
        for first, patterns in windows.patterns(m):
            which, at = index.locate(*index.search(patterns))
            # ``joined`` has one place more for each text before.
            yield m, which + first, places[at]


def scan(texts: list[str | None], windows: Windows) -> list[tuple[int, np.ndarray, set[str]]]:
    """For each text: its number of words, a mask of the words that are hit, and the items found."""
    get = windows.symbol.get
    coded = []
    for text in texts:
        words = words_of(text)
        coded.append(np.fromiter(map(get, words, repeat(0)), np.int32, len(words)))
    sizes = np.array([len(x) + 1 for x in coded], np.int64)
    starts = np.cumsum(sizes) - sizes
    change = np.zeros(int(sizes.sum()) + 1, np.int32)
    items: list[set[str]] = [set() for _ in texts]
    for m, which, at in occurrences(coded, windows):
        np.add.at(change, at, 1)
        np.add.at(change, at + m, -1)
        owner = np.searchsorted(starts, at, side="right") - 1
        size = len(windows.starts[m])
        for pair in np.unique(owner * size + which).tolist():
            items[pair // size].update(windows.items(m, pair % size))
    hit = np.cumsum(change) > 0
    return [(len(x), hit[s : s + len(x)], found) for x, s, found in zip(coded, starts.tolist(), items, strict=True)]


def edges(hit: np.ndarray) -> list[tuple[int, int]]:
    """The stretches of words that are hit, as (start, stop)."""
    at = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0])))).tolist()
    return list(zip(at[::2], at[1::2], strict=True))


class Search:
    """Windows in parts, sent to the Python workers; called there with texts, it gives what scan() gives for all parts."""

    def __init__(self, parts: list[Broadcast]):
        self.parts, self.key = parts, uuid.uuid4().hex

    def _part(self, k: int) -> Windows:
        def load() -> Windows:
            windows = self.parts[k].value
            vars(self.parts[k]).pop("_value", None)  # else a worker keeps what it has read of a broadcast
            return windows

        return held((self.key, k), load)

    def __call__(self, texts: list[str | None]) -> list[tuple[int, np.ndarray, set[str]]]:
        found = scan(texts, self._part(0))
        for k in range(1, len(self.parts)):
            found = [(n, hit | more, items | others) for (n, hit, items), (_, more, others) in zip(found, scan(texts, self._part(k)), strict=True)]
        return found


def search(benchmark: DataFrame, window: int = WINDOW, part_bytes: int = PART_BYTES) -> Search:
    """The windows of ``benchmark``, read and broadcast a part at a time."""
    spark = benchmark.sparkSession
    items = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    parts = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // part_bytes))
    sent = []
    for part in range(parts):
        rows = items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        sent.append(spark.sparkContext.broadcast(Windows([tuple(x) for x in rows.collect()], window)))
    return Search(sent)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """``docs`` (with a column text) and the columns __words (words of the text), __spans (merged stretches of hit words:
    start, stop) and __items (ids of the items found, as sorted strings), in place of any of those names.

    ``benchmark``: item_id, text; other columns are ignored. Null texts have no words; items without words have no window;
    rows of one item_id are one item with all their windows; items with a null id are left out. An item of fewer than
    ``window`` words is one window. No benchmark leaves every document clean.
    """
    searched = search(benchmark, window, part_bytes)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SHARD_BYTES):
            rows = searched(batch.column("text").to_pylist())
            spans = [[{"start": a, "stop": b} for a, b in edges(hit)] for _, hit, _ in rows]
            new = [pa.array([n for n, _, _ in rows], pa.int64()), pa.array(spans, _SPANS), pa.array([sorted(x) for *_, x in rows], pa.list_(pa.string()))]
            yield pa.record_batch([*batch.columns, *new], names=[*batch.schema.names, "__words", "__spans", "__items"])

    docs = docs.drop("__words", "__spans", "__items")
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])
    fields = [T.StructField("__words", T.LongType()), T.StructField("__spans", T.ArrayType(span)), T.StructField("__items", T.ArrayType(T.StringType()))]
    return docs.mapInArrow(found, T.StructType([*docs.schema.fields, *fields]))


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs``."""
    found = find(docs.select("doc_id", F.col("text").cast("string")), benchmark, window)
    hit = F.aggregate("__spans", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"])
    return found.select(
        "doc_id", F.col("__words").alias("n_words"), hit.alias("n_hit"), F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the stretches of words in ``spans``, and without what lies between the words of one stretch."""
    at = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    out, last = [], 0
    for start, stop in spans:
        out.append(text[last : at[start][0]])
        last = at[stop - 1][1]
    return "".join([*out, text[last:]])


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """``docs`` (text, a string; other columns of any name) with the found passages cut out of text and n_chars, if there is
    one, counted anew; documents of which no word is left go. Documents without a hit are unchanged."""
    searched = search(benchmark, window, part_bytes)

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SHARD_BYTES):
            texts = batch.column("text").to_pylist()
            changed, gone = {}, []
            for i, (n, hit, _) in enumerate(searched(texts)):
                count = int(hit.sum())
                if count == n and n:
                    gone.append(i)
                elif count:
                    changed[i] = cut(texts[i], edges(hit))
            if changed:
                rows = pa.array(list(changed), pa.int64())
                mask = pc.is_in(pa.array(np.arange(len(texts))), rows)
                for name, new in (("text", list(changed.values())), ("n_chars", [len(x) for x in changed.values()])):
                    if name in batch.schema.names:
                        at = batch.schema.names.index(name)
                        kind = batch.schema.types[at]
                        values = pa.array([str(x) for x in new] if pa.types.is_string(kind) else new, kind)
                        batch = batch.set_column(at, batch.schema.field(at), pc.replace_with_mask(batch.column(at), mask, values))
            yield batch.filter(pa.array(~np.isin(np.arange(len(texts)), gone))) if gone else batch

    return docs.mapInArrow(edit, docs.schema)
