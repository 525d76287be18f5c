"""Token-id files with fixed-width bit packing.

A shard file holds the ids of a stretch of documents in ascending doc_id order:

    magic, version, bits an id, ids a block, documents, ids, blocks     header, 8 little-endian 64-bit integers (one spare)
    doc_id of each document                                             64-bit; a mask of the null ones follows, 1 byte each
    first id of each document, and the number of ids                    64-bit, documents + 1 values
    byte offset of each block in the payload, and its length            64-bit, blocks + 1 values
    payload                                                             64-bit words

Every id takes the fewest bits that hold the vocabulary. A block has ``BLOCK`` ids (the last one fewer) and starts at a
word, so block k is found by its offset alone and unpacked by vectorised shifts; any slice of ids needs only its blocks.

Scale. Documents are dealt by ranges of doc_id, each task writes shard files of bounded size under a temporary name and
renames them, so a task that is run again leaves no half file. A shard's place in the whole is the sum of the shards before
it, from a manifest with one row a shard.
"""

from __future__ import annotations

import json
import re
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm.common import held, release, scratch, slices, written

MAGIC = 0x314B50414B4F54  # "TOKPAK1"
BLOCK = 4096
#: Ids after which a task starts a new shard file.
SHARD_IDS = 8_000_000
#: Words whose ids a Python worker remembers.
MEMORY = 400_000


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> np.ndarray:
    """Words of 64 bits with ``bits`` of each id, low bits first. The lanes repeat every 64/gcd(64, bits) ids."""
    lanes = 64 // np.gcd(64, bits)
    words = int(lanes * bits // 64)
    rows = -(-len(ids) // lanes)
    table = np.zeros((rows, lanes), np.uint64)
    table.reshape(-1)[: len(ids)] = ids
    out = np.zeros((rows, words), np.uint64)
    for lane in range(lanes):
        word, shift = divmod(lane * bits, 64)
        out[:, word] |= table[:, lane] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= table[:, lane] >> np.uint64(64 - shift)
    return out.reshape(-1)[: -(-len(ids) * bits // 64)]


def unpack(words: np.ndarray, bits: int, n: int) -> np.ndarray:
    """The first n ids of ``words``, as unsigned 32-bit integers."""
    lanes = 64 // np.gcd(64, bits)
    wide = int(lanes * bits // 64)
    rows = -(-n // lanes)
    table = np.zeros((rows, wide), np.uint64)
    table.reshape(-1)[: len(words)] = words[: rows * wide]
    out = np.empty((rows, lanes), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for lane in range(lanes):
        word, shift = divmod(lane * bits, 64)
        value = table[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            value |= table[:, word + 1] << np.uint64(64 - shift)
        out[:, lane] = value & mask
    return out.reshape(-1)[:n]


def shard_bytes(doc_ids: list[int | None], ids: list[np.ndarray], vocabulary: int, block: int = BLOCK) -> bytes:
    bits = bits_for(vocabulary)
    starts = np.concatenate(([0], np.cumsum([len(x) for x in ids], dtype=np.int64))).astype("<i8")
    joined = np.concatenate(ids) if ids else np.empty(0, np.uint32)
    blocks = [pack(joined[i : i + block], bits).astype("<u8").tobytes() for i in range(0, len(joined), block)]
    offsets = np.concatenate(([0], np.cumsum([len(b) for b in blocks], dtype=np.int64))).astype("<i8")
    header = np.array([MAGIC, 1, bits, block, len(ids), len(joined), len(blocks), 0], "<i8")
    names = np.array([x or 0 for x in doc_ids], "<i8")
    nulls = bytes(x is None for x in doc_ids)
    return b"".join([header.tobytes(), names.tobytes(), nulls, starts.tobytes(), offsets.tobytes(), *blocks])


class Shard:
    """A shard file's content; ids are unpacked when asked for."""

    def __init__(self, content: bytes):
        magic, version, self.bits, self.block, docs, self.n_ids, blocks, _ = np.frombuffer(content, "<i8", 8).tolist()
        if magic != MAGIC or version != 1:
            raise ValueError("not a token shard")
        at = 64
        names = np.frombuffer(content, "<i8", docs, at)
        nulls = np.frombuffer(content, np.uint8, docs, at := at + 8 * docs)
        self.doc_ids = [None if n else x for x, n in zip(names.tolist(), nulls.tolist(), strict=True)]
        self.starts = np.frombuffer(content, "<i8", docs + 1, at := at + docs)
        self.offsets = np.frombuffer(content, "<i8", blocks + 1, at := at + 8 * (docs + 1))
        self.content, self.payload = content, at + 8 * (blocks + 1)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop, from the blocks that hold them."""
        if start >= stop:
            return np.empty(0, np.uint32)
        out = []
        for b in range(start // self.block, (stop - 1) // self.block + 1):
            first = b * self.block
            size = int(self.offsets[b + 1] - self.offsets[b])
            words = np.frombuffer(self.content, "<u8", size // 8, self.payload + int(self.offsets[b]))
            out.append(unpack(words, self.bits, min(self.block, self.n_ids - first))[max(0, start - first) : stop - first])
        return np.concatenate(out)

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


#: The steps of a tokenizer before its model under which a text may be cut at white space: nothing is composed over white
#: space, and the pattern drops it.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: A run of letters and the ASCII punctuation behind it. Without apostrophes and angle brackets, so that neither a short form
#: nor a special token is in it, the pattern above cuts between the two and nowhere else.
_WORD = re.compile(r"([^\W\d_]+)([!-&(-/:;?@\[-`{-~]*)")
_OTHER = "\x00"


def cuts_at_white_space(tokenizer) -> bool:
    """Whether the ids of a text are those of its chunks between white space, one after the other."""
    steps = json.loads(tokenizer.to_str())
    before, model = steps["pre_tokenizer"] or {}, steps["model"]
    cut, byte_level = [*before.get("pretokenizers", []), {}, {}][:2]
    return (
        steps["normalizer"] == _NORMALIZER and len(before.get("pretokenizers", [])) == 2
        and (cut.get("type"), cut.get("pattern"), cut.get("behavior"), cut.get("invert")) == ("Split", {"Regex": _PATTERN}, "Removed", True)
        and (byte_level.get("type"), byte_level.get("add_prefix_space"), byte_level.get("use_regex")) == ("ByteLevel", False, False)
        and model["type"] == "BPE" and not model.get("dropout")
        and all(t["content"].startswith("<") and not re.search(r"\s", t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in steps["added_tokens"])
    )


class Letters(dict):
    """For str.translate: what the tokenizer's steps before its model make of a character that stays one run of letters with
    any letter beside it, and _OTHER for every other character. The steps themselves are asked, once a character."""

    def __init__(self, tokenizer):
        self.lower, self.cut = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str

    def __missing__(self, code: int) -> str:
        c, found = chr(code), _OTHER
        if c.isalpha() and unicodedata.is_normalized("NFC", c):
            low = self.lower(c)
            runs = [self.cut(x) for x in (low, low + "a", "a" + low)]
            if all(len(x) == 1 for x in runs):
                found = runs[0][0][0]
        self[code] = found
        return found


class Encoder:
    """Ids of whole texts.

    Where the tokenizer cuts at white space, each chunk between ASCII white space is encoded by itself. A chunk of letters
    that are already composed, with or without punctuation behind, is one word to the tokenizer's model, which is asked for
    its ids directly; any other chunk goes through the library whole. What a slice of text repeats is looked up once, and the
    ids of words are remembered.
    """

    def __init__(self, path: str, chunked: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.chunked = chunked and cuts_at_white_space(self.tokenizer)
        self.letters = Letters(self.tokenizer) if self.chunked else None
        self.words: dict[str, bytes] = {}
        self.others: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        for known in (self.words, self.others):
            if len(known) > MEMORY:
                known.clear()
        words, others, letters, tokenize = self.words, self.others, self.letters, self.tokenizer.model.tokenize
        cut, composed = _WORD.fullmatch, unicodedata.is_normalized
        out, rest = [], []
        for i, chunk in enumerate(chunks):
            m = cut(chunk)
            if m:
                head, tail = m.groups()
                word = head.translate(letters)
                if _OTHER not in word and (head.isascii() or composed("NFC", head)):
                    ids = words.get(word)
                    if ids is None:
                        ids = words[word] = array("I", [t.id for t in tokenize(word)]).tobytes()
                    if tail:
                        end = others.get(tail)
                        if end is None:
                            end = others[tail] = self._encode([tail])[0]
                        ids += end
                    out.append(ids)
                    continue
            ids = others.get(chunk)
            if ids is None:
                rest.append(i)
            out.append(ids)
        for i, ids in zip(rest, self._encode([chunks[i] for i in rest]), strict=True):
            out[i] = others[chunks[i]] = ids
        return out

    def __call__(self, texts: list[str | None] | pa.Array) -> list[np.ndarray]:
        if not self.chunked:
            return [np.frombuffer(x, np.uint32) for x in self._encode([t or "" for t in (texts.to_pylist() if isinstance(texts, pa.Array) else texts)])]
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not len(texts):
            return []
        chunks = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = chunks.flatten().dictionary_encode()
        found = self._chunks(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        # Taken as strings of bytes, the chunks' ids lie one after the other in one buffer.
        laid = pa.array(found, pa.large_binary()).take(coded.indices)
        _, ends, joined = laid.buffers()
        ends = np.frombuffer(ends, np.int64, len(laid) + 1) // 4 if len(laid) else np.zeros(1, np.int64)
        joined = np.frombuffer(joined, np.uint32, int(ends[-1])) if ends[-1] else np.empty(0, np.uint32)
        at = chunks.offsets.to_numpy()
        return np.split(joined, ends[at[1:-1] - at[0]])


MANIFEST = T.StructType([T.StructField("task", T.LongType()), T.StructField("part", T.LongType()), T.StructField("file", T.StringType()), T.StructField("n_docs", T.LongType()), T.StructField("n_ids", T.LongType())])


def _writer(folder: str, tokenizer: str, end_id: int, shard_ids: int, block: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        fs, root = pafs.FileSystem.from_uri(folder)
        encode = held(("encoder", tokenizer), lambda: Encoder(tokenizer))
        names, ids, size, part = [], [], 0, 0

        def flush():
            nonlocal names, ids, size, part
            file = f"{task:08d}-{part:06d}.tok"
            draft = f"{root}/_{file}.{uuid.uuid4().hex}"
            with fs.open_output_stream(draft) as out:
                out.write(shard_bytes(names, ids, encode.vocabulary, block))
            fs.move(draft, f"{root}/{file}")
            row = pa.record_batch([[task], [part], [file], [len(names)], [size]], names=MANIFEST.names)
            names, ids, size, part = [], [], 0, part + 1
            return row

        for rows in slices(batches, 1):
            for name, found in zip(rows.column(0).to_pylist(), encode(rows.column(1)), strict=True):
                names.append(name)
                ids.append(np.append(found, np.uint32(end_id)))
                size += len(ids[-1])
                if size >= shard_ids:
                    yield flush()
        if names:
            yield flush()

    return write


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, shard_ids: int = SHARD_IDS, block: int = BLOCK) -> DataFrame:
    """Writes ``docs`` (doc_id, text; other columns are ignored) as shard files under ``folder``, which all executors and
    the driver can reach, and returns the manifest (task, part, file, n_docs, n_ids), itself a written table.

    Null texts are empty; every document ends with ``end_id``. Rows are in ascending doc_id order, null ids first, repeated
    ids by text. No rows write no file.
    """
    spark = docs.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(target)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(_writer(folder, tokenizer, end_id, shard_ids, block), MANIFEST), "token-manifest")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(file, doc_id, start, ids) of every document in the shard files; start counts the ids of its own shard before it."""

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = Shard(content.as_py())
                step = 1024
                for i in range(0, len(shard.doc_ids), step):
                    some = range(i, min(i + step, len(shard.doc_ids)))
                    ids = [pa.array(shard.document(k).astype(np.int64)) for k in some]
                    offsets = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
                    values = pa.concat_arrays(ids)
                    yield pa.record_batch([[file] * len(some), pa.array(shard.doc_ids[i : some.stop], pa.int64()), pa.array(shard.starts[i : some.stop]), pa.ListArray.from_arrays(offsets, values)], names=["file", "doc_id", "start", "ids"])

    return _files(spark, folder).mapInArrow(unpacked, "file string, doc_id long, start long, ids array<long>")


def _files(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[0-9]*.tok").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def digests(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files; start counts over all documents."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = Shard(content.as_py())
                joined = shard.ids(0, shard.n_ids).astype("<u4")
                at = shard.starts.tolist()
                sums = [zlib.crc32(joined[a:b]) for a, b in zip(at, at[1:], strict=False)]
                yield pa.record_batch([[file] * len(sums), pa.array(shard.doc_ids, pa.int64()), pa.array(shard.starts[:-1]), pa.array(np.diff(shard.starts)), pa.array(sums, pa.int64())], names=["file", "doc_id", "start", "n_tokens", "ids_crc32"])

    before = Window.orderBy("task", "part").rowsBetween(Window.unboundedPreceding, -1)
    bases = manifest.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    rows = _files(spark, folder).mapInArrow(digest, "file string, doc_id long, start long, n_tokens long, ids_crc32 long")
    return rows.join(bases, "file").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes ``docs`` to a new folder in the shared one, and gives the digests of what is read back from the files."""
    spark = docs.sparkSession
    folder = scratch(spark, "tokens")
    return digests(spark, folder, write(docs, folder, tokenizer, end_id))
