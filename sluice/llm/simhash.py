"""SimHash near-duplicates by pigeonhole blocks.

A text gets a 64-bit fingerprint of its word shingles. Fingerprints within ``distance`` bits of each other are linked:
cut into ``blocks`` pieces, two such fingerprints differ in ``distance`` pieces at most, so they agree on the rest. Every
choice of ``blocks - distance`` pieces is a key; fingerprints join on the keys, and the Hamming distance is verified.

Scale. The join runs over *distinct* fingerprints, so a group of exact copies counts once. A key that more than ``crowd``
fingerprints share (near copies by the thousand) is never paired out: inside it, a fingerprint meets its partners in the
values one flipped bit away (two fingerprints within two bits share such a value), which has at most 65 members each and
is exact as well. So both the pairs and the groups grow in proportion to the fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm.common import release, slices, unused, written
from sluice.llm.graph import components

BITS = 64
#: Shingles whose bits are counted at a time; bounds the memory of a Python worker.
STEP = 1 << 17


def shingle_hashes(text: str | None, size: int = 3, seed: int = 42) -> np.ndarray:
    """Unsigned XXH64 of each shingle of ``size`` words, repeats included; fewer words make one shingle, none make none."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    n = max(1, len(words) - size + 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[:n].tolist()
    stops = (ends[min(size, len(words)) - 1 :] - 1).tolist()
    line = b" ".join(words)
    return np.fromiter(map(xxhash.xxh64_intdigest, map(line.__getitem__, map(slice, starts, stops)), repeat(seed)), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes; zero for none."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), STEP):
        ones += np.unpackbits(hashes[i : i + STEP].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in slices(batches, 1):
        found = np.array([fingerprint(shingle_hashes(t.as_py())) for t in batch.column(1)], np.uint64)
        yield pa.record_batch([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; fp holds the 64 bits as a signed long."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def block_keys(fp: str, blocks: int, distance: int) -> list:
    """One key for each choice of pieces on which a close pair may agree: (number of the choice, bits of its pieces)."""
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [sum(1 << b for b in range(cuts[i], cuts[i + 1])) for i in range(blocks)]
    keys = []
    for k, choice in enumerate(combinations(range(blocks), blocks - distance)):
        mask = sum(masks[i] for i in choice)
        mask -= (mask >> 63) << 64
        keys.append(F.struct(F.lit(k).alias("k"), F.col(fp).bitwiseAND(F.lit(mask).cast("long")).alias("v")))
    return keys


def links(fps: DataFrame, distance: int = 2, blocks: int = 5, crowd: int = 32) -> DataFrame:
    """(a, b) between distinct fingerprints ``fps`` (fp): enough verified links that exactly the fingerprints within
    ``distance`` bits of each other are connected as if all their links were given. ``distance`` is 2 at most."""
    if not 0 <= distance <= 2:
        raise ValueError("crowded keys are resolved for a distance of up to 2 bits")
    keyed = fps.select("fp", F.explode(F.array(*block_keys("fp", blocks, distance))).alias("key")).select("fp", "key.k", "key.v")
    sizes = keyed.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = written(keyed.join(sizes, ["k", "v"]), "shared-keys")
    few = shared.where(F.col("n") <= crowd)
    pairs = few.select("k", "v", F.col("fp").alias("a")).join(few.select("k", "v", F.col("fp").alias("b")), ["k", "v"])
    pairs = pairs.where("a < b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance).select("a", "b")
    many = shared.where(F.col("n") > crowd).select("fp").distinct()
    flips = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit((1 << b) - ((1 << b) >> 63 << 64)).cast("long")) for b in range(BITS)]
    near = many.select("fp", F.explode(F.array(*flips)).alias("at"))
    low = near.groupBy("at").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    met = low.select("a", F.explode("all").alias("b")).where("a <> b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    if distance == 2:
        return pairs.union(met)
    # With fewer bits allowed, a meeting value's members needn't be close: give the pairs among its 65 members at most.
    every = low.select(F.explode("all").alias("a"), "all").select("a", F.explode("all").alias("b")).where("a < b")
    return pairs.union(every.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))


def near_duplicates(docs: DataFrame, distance: int = 2, blocks: int = 5, crowd: int = 32) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text; other columns are ignored).

    Null and empty texts have no words and the fingerprint zero, which links like any other. Repeated rows are copies of
    each other. component_id is the smallest doc_id that can be reached over links; null doc_ids never name a component
    (a component of nulls only is null). No rows give no rows.
    """
    prints = written(fingerprints(docs), "fingerprints")
    firsts = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    joined = components(links(firsts.select("fp"), distance, blocks, crowd)).withColumnsRenamed({"node": "fp", "component": "root"})
    roots = written(joined.join(firsts, "fp").select("fp", "root", "first"), "fingerprint-roots")
    lowest = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    named = roots.join(lowest, "root").select("fp", "component_id")
    names = firsts.join(named, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return prints.join(names, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with their fingerprint as one more column, the last."""
    release()
    for batch in slices(batches, "text"):
        found = np.array([fingerprint(shingle_hashes(t.as_py())) for t in batch.column("text").cast(pa.string())], np.uint64)
        yield pa.record_batch([*batch.columns, pa.array(found.view(np.int64))], names=[*batch.schema.names, ""])


def keep_one(docs: DataFrame, distance: int = 2, blocks: int = 5, crowd: int = 32, nameless: bool = False) -> DataFrame:
    """One row of ``docs`` for each component, the first by doc_id (null ones last) and text; all columns are kept, and their
    types must have an order.

    Rows are told apart by what they hold: different texts under one doc_id stay if they lie in different components. A row
    without a doc_id is kept with ``nameless`` only, where its component has no row with one.
    """
    fp, none = unused(docs, "__fp", "__none")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    marked = docs.mapInArrow(lambda x: (b.rename_columns([*b.schema.names[:-1], fp]) for b in _marked(x)), T.StructType([*docs.schema.fields, T.StructField(fp, T.LongType())]))
    row = F.struct(F.col("doc_id").isNull().alias(none), "doc_id", "text", *others)
    # Copies are one row before anything is joined; summed up before the shuffle, so a crowd of them is a row a task.
    firsts = written(marked.groupBy(F.col(fp).alias("fp")).agg(F.min(row).alias("row")), "first-rows")
    joined = components(links(firsts.select("fp"), distance, blocks, crowd)).withColumnsRenamed({"node": "fp", "component": "root"})
    best = firsts.join(joined, "fp").groupBy("root").agg(F.min(F.struct("row", "fp")).alias("best")).select(F.col("best.fp").alias("fp"))
    losers = joined.join(best, "fp", "left_anti").select("fp")
    kept = firsts.join(losers, "fp", "left_anti")
    return (kept if nameless else kept.where(~F.col("row").getField(none))).select("row.*").select(*docs.columns)
