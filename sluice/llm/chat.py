"""Transcript parsing by a hidden Markov model, and canonical turn rendering.

A transcript is a run of lines. Each line shows a speaker marker (or none) and features of its own; hidden are who speaks and
whether the line begins a turn. The states are (role, begins / goes on); transition and emission chances are counted in
labelled transcripts, and Viterbi's algorithm finds the likeliest states.

Input comes in pieces (conversation, place, text) of any number of lines, and each piece gives one row of output, so neither
side needs a whole conversation in one cell. Conversations of up to ``long`` pieces are decoded where a shuffle by conversation
puts them, many abreast in numpy. A longer one, however long, is dealt by ranges of its places into segments; each segment
gives the best score from every state before it to every state at its end (a max-plus matrix), the matrices are chained, and
the segments are decoded with their ends fixed: the same path as in one go. Turns are counted in the states, never in the
rendered text, and control marks that a text itself holds are escaped, so no text can forge a turn.

A piece is a cell of its own and is decoded whole, so a worker's memory follows its longest piece (about 60 bytes a line).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import release, slices, written

ROLES = ("system", "user", "assistant")
#: Begins, then goes on, for each role.
STATES = 2 * len(ROLES)
#: Conversations that make the model, the first by a hash, and what is taken of each: its first turns, and their first characters.
SAMPLE = 400
SAMPLE_TURNS = 64
SAMPLE_CHARS = 1000
#: Bytes of text that are decoded abreast, but for a conversation that has more.
ABREAST = 8 << 20
#: Pieces of a conversation that one task decodes at once.
LONG = 4096
#: Speaker markers at the start of a line, by role.
MARKERS = (
    ("system", r"(?:#+\s*)?(?:system|instructions?|context)"),
    ("user", r"(?:#+\s*)?(?:user|human|customer|question|q|me|you)"),
    ("assistant", r"(?:#+\s*)?(?:assistant|ai|bot|agent|answer|a|model)"),
)
_MARKER = re.compile(r"^\s*(?:" + "|".join(f"(?P<{r}>{p})" for r, p in MARKERS) + r")\s*[:>]\s*", re.I)
_OTHER = re.compile(r"^\s*[\w#][\w #]{0,20}:\s+")
_CONTROL = re.compile(r"<(\\*)\|(?=(?:system|user|assistant|end)\|>)")
_ESCAPED = re.compile(r"<\\(\\*)\|(?=(?:system|user|assistant|end)\|>)")
#: Values of each feature: marker (none, a role's, another), length class, ends in a question mark, begins in lower case.
SIZES = (5, 4, 2, 2)


def line_features(line: str) -> tuple[int, int, int, int]:
    m = _MARKER.match(line)
    marker = 1 + ROLES.index(m.lastgroup) if m else 4 if _OTHER.match(line) else 0
    body = line[m.end() :] if m else line
    size = 0 if not body.strip() else 1 if len(body) < 80 else 2 if len(body) < 240 else 3
    return marker, size, int(body.rstrip().endswith("?")), int(body[:1].islower())


def lines_of(text: str | None) -> list[str]:
    """At least one line, be it empty."""
    return (text or "").split("\n")


def learn(pieces: list[list[tuple[str, str | None]]], smoothing: float = 1.0) -> dict[str, np.ndarray]:
    """Log chances from conversations of (role, raw text) pieces. A piece begins a turn; pieces of other roles don't count."""
    start, move = np.full(STATES, smoothing), np.full((STATES, STATES), smoothing)
    emit = [np.full((STATES, n), smoothing) for n in SIZES]
    for conversation in pieces:
        before = -1
        for role, text in conversation:
            if role not in ROLES:
                before = -1
                continue
            for k, line in enumerate(lines_of(text)):
                state = 2 * ROLES.index(role) + (k > 0)
                if before < 0:
                    start[state] += 1
                else:
                    move[before, state] += 1
                for table, value in zip(emit, line_features(line), strict=True):
                    table[state, value] += 1
                before = state
    for r in range(len(ROLES)):
        other = [2 * s + 1 for s in range(len(ROLES)) if s != r]
        move[2 * r, other] = move[2 * r + 1, other] = 1e-9  # only the one who speaks goes on
    start[1::2] = 1e-9
    log = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
    return {"start": log(start), "move": log(move)} | {f"emit{i}": log(x) for i, x in enumerate(emit)}


def scores(features: np.ndarray, model: dict[str, np.ndarray]) -> np.ndarray:
    """Log chance of each line's features in each state."""
    return sum(model[f"emit{i}"][:, features[:, i]].T for i in range(len(SIZES)))


def viterbi(emissions: list[np.ndarray], model: dict[str, np.ndarray], entries: list[int] | None = None, exits: list[int] | None = None) -> list[np.ndarray]:
    """The likeliest states of each sequence of lines, all sequences abreast. ``entries``: the state before the first line
    (-1: none, it is the start of all); ``exits``: the state of the last line (-1: free). The first of equal states wins."""
    n = len(emissions)
    sizes = np.array([len(e) for e in emissions])
    by = np.argsort(-sizes, kind="stable")
    entries = np.array(entries if entries is not None else [-1] * n)[by]
    exits = exits if exits is not None else [-1] * n
    steps = int(sizes.max(initial=0))
    live = np.searchsorted(-sizes[by], -np.arange(steps), side="left")
    first = np.concatenate((model["move"], model["start"][None]))  # entry -1 takes the last row
    score = first[entries] + np.array([emissions[i][0] for i in by]).reshape(-1, STATES)
    back = []
    for t in range(1, steps):
        k = live[t]
        through = score[:k, :, None] + model["move"]
        best = through.argmax(axis=1)
        score[:k] = np.take_along_axis(through, best[:, None], axis=1)[:, 0] + np.array([emissions[i][t] for i in by[:k]])
        back.append(best.astype(np.int8))
    out: list[np.ndarray] = [np.empty(0, np.int8)] * n
    for place, i in enumerate(by.tolist()):
        path = np.empty(sizes[i], np.int8)
        path[-1] = exits[i] if exits[i] >= 0 else score[place].argmax()
        for t in range(sizes[i] - 1, 0, -1):
            path[t - 1] = back[t - 1][place, path[t]]
        out[i] = path
    return out


def transfer(emission: np.ndarray, model: dict[str, np.ndarray]) -> np.ndarray:
    """The best score from each state before a segment (the last row: from the start of all) to each state of its last line."""
    score = np.concatenate((model["move"], model["start"][None])) + emission[0]
    for e in emission[1:]:
        score = (score[:, :, None] + model["move"]).max(axis=1) + e
    return score


def chain(matrices: list[np.ndarray]) -> list[int]:
    """The state at the end of each segment on the best path through all of them."""
    score, back = matrices[0][-1], []
    for m in matrices[1:]:
        through = score[:, None] + m[:STATES]
        back.append(through.argmax(axis=0))
        score = through.max(axis=0)
    ends = [int(score.argmax())]
    for b in reversed(back):
        ends.append(int(b[ends[-1]]))
    return ends[::-1]


def escape(text: str) -> str:
    """A body without control marks of its own: one more backslash in each. unescape() takes it out again."""
    return _CONTROL.sub(r"<\1\\|", text) if "|>" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def render(lines: list[str], states: np.ndarray, opened: bool) -> str:
    """Canonical turns: a header for each line that begins one, bodies without markers and escaped, a footer before the next
    header. ``opened``: a turn goes on from the piece before."""
    out = []
    for line, s in zip(lines, states.tolist(), strict=True):
        if s % 2 == 0:
            if opened:
                out.append("<|end|>")
            out.append(f"<|{ROLES[s // 2]}|>")
            opened = True
            m = _MARKER.match(line)
            line = line[m.end() :] if m else line
        out.append(escape(line))
    return "\n".join(out)


def raw(role: Column, conversation: Column, place: Column, text: Column) -> Column:
    """A turn as transcripts have it: the conversation has one of four habits of marking speakers, the last of which leaves
    out every other marker or so."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    names = (("User: ", "Assistant: ", "System: "), ("Human: ", "AI: ", "Instruction: "), ("Q: ", "A: ", "### System: "), ("user> ", "bot> ", "context: "))
    habit = F.pmod(F.xxhash64(conversation), F.lit(4))
    bare = (habit == 3) & (F.pmod(F.xxhash64(conversation, place), F.lit(2)) == 0)
    marker = F.lit("")
    for k, (user, assistant, system) in enumerate(names):
        own = F.when(role == "user", user).when(role == "assistant", assistant).when(role == "system", system).otherwise("")
        marker = F.when(habit == k, own).otherwise(marker)
    return F.concat(F.when(bare, "").otherwise(marker), text)


_ROWS = "key string, place long, text string"


def _groups(batches: Iterator[pa.RecordBatch], most: int = ABREAST) -> Iterator[pd.DataFrame]:
    """Whole groups (equal keys, that lie together) of about ``most`` bytes of text at a time."""
    held: list[pd.DataFrame] = []
    size = 0
    for batch in slices(batches, "text"):
        rows = batch.to_pandas(integer_object_nulls=True)
        if size >= most:
            new = np.flatnonzero(rows["key"].to_numpy() != held[-1]["key"].iloc[-1])
            if len(new):
                yield pd.concat([*held, rows.iloc[: new[0]]], ignore_index=True)
                held, size, rows = [], 0, rows.iloc[new[0] :]
        held.append(rows)
        size += 64 * len(rows) + batch.column("text").nbytes
    if held:
        yield pd.concat(held, ignore_index=True)


def _decoded(rows: pd.DataFrame, model: dict[str, np.ndarray]) -> pd.DataFrame:
    """Rows (key, place, text, and maybe entry, exit), equal keys together, with their roles, turns and renderings. Turns are
    counted from 0 in what is given of a conversation; ``begun``: how many begin in the piece."""
    lines = [lines_of(t) for t in rows["text"]]
    counts = np.array([len(x) for x in lines])
    emission = scores(np.array([line_features(x) for piece in lines for x in piece]), model)
    firsts = np.flatnonzero(np.append(True, rows["key"].to_numpy()[1:] != rows["key"].to_numpy()[:-1]))
    at = np.concatenate(([0], np.cumsum(counts)))
    cuts = [*at[firsts].tolist(), at[-1]]
    has = "entry" in rows
    entries = rows["entry"].to_numpy()[firsts].tolist() if has else [-1] * len(firsts)
    exits = rows["exit"].to_numpy()[firsts].tolist() if has else [-1] * len(firsts)
    states = np.concatenate(viterbi([emission[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], model, entries, exits))
    begun = np.concatenate(([0], np.cumsum(states % 2 == 0)))
    group = np.repeat(np.arange(len(firsts)), np.diff([*firsts, len(rows)]))
    base = begun[at[firsts]][group]
    # Whether a turn was begun before the piece, be it in another segment.
    opened = (begun[at[:-1]] - base > 0) | (np.array(entries)[group] >= 0)
    return pd.DataFrame({
        "key": rows["key"], "place": rows["place"], "n_lines": counts,
        "role": [ROLES[s // 2] for s in states[at[:-1]]],
        "turn_no": begun[at[:-1] + 1] - base - 1,
        "begun": np.diff(begun[at]),
        "rendered": [render(x, states[a:b], o) for x, a, b, o in zip(lines, at[:-1].tolist(), at[1:].tolist(), opened.tolist(), strict=True)],
    })


_OUT = "key string, place long, n_lines long, role string, turn_no long, rendered string"
_ARROW = pa.schema([("key", pa.string()), ("place", pa.int64()), ("n_lines", pa.int64()), ("role", pa.string()), ("turn_no", pa.int64()), ("rendered", pa.string()), ("segment", pa.int64()), ("begun", pa.int64())])
_SHORT = pa.schema(list(_ARROW)[:6])


def _short(model):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for rows in _groups(batches):
            yield pa.RecordBatch.from_pandas(_decoded(rows, model.value), schema=_SHORT, preserve_index=False)

    return decode


def _segmenter(long: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Numbers the segments: at most ``long`` pieces, of one conversation and one partition."""
        from pyspark import TaskContext

        segment, key, size = TaskContext.get().partitionId() << 32, None, 0
        for batch in batches:
            numbers, places = [], []
            for k in batch.column("key").to_pylist():
                if k != key or size >= long:
                    segment, key, size = segment + 1, k, 0
                numbers.append(segment)
                places.append(size)
                size += 1
            yield pa.record_batch([*batch.columns, pa.array(numbers, pa.int64()), pa.array(places, pa.int64())], names=[*batch.schema.names, "segment", "at"])

    return cut


def _transfers(model):
    def matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        renamed = (b.rename_columns(["name" if n == "key" else "key" if n == "segment" else n for n in b.schema.names]) for b in batches)
        for rows in _groups(renamed, 1):
            for (name, segment), own in rows.groupby(["name", "key"], sort=False, dropna=False):
                found = scores(np.array([line_features(x) for t in own["text"] for x in lines_of(t)]), model.value)
                yield pa.record_batch([[name], [segment], pa.array([transfer(found, model.value).reshape(-1).tolist()])], names=["key", "segment", "matrix"])

    return matrix


def _chained(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("segment")
    ends = chain([np.array(m).reshape(STATES + 1, STATES) for m in rows["matrix"]])
    return pd.DataFrame({"segment": rows["segment"], "entry": [-1, *ends[:-1]], "exit": ends})


def parse(pieces: DataFrame, model: dict[str, np.ndarray], long: int = LONG) -> DataFrame:
    """(key, place, n_lines, role of the piece's first line, turn_no, rendered) for every piece (key, place, text).

    ``key`` and ``text`` are strings, ``place`` a long. Places order a conversation, null ones first; pieces of one place
    are ordered by text. Null texts are one empty line. Null keys are one conversation. No pieces give no rows.
    """
    spark = pieces.sparkSession
    held = spark.sparkContext.broadcast(model)
    pieces = pieces.select(F.coalesce("key", F.lit("")).alias("key"), "place", "text")
    sizes = written(pieces.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > long).select("key"), "long-conversations")
    if sizes.isEmpty():
        return pieces.repartition("key").sortWithinPartitions("key", "place", "text").mapInArrow(_short(held), _OUT)
    short = pieces.join(sizes, "key", "left_anti").repartition("key").sortWithinPartitions("key", "place", "text").mapInArrow(_short(held), _OUT)
    dealt = pieces.join(sizes, "key", "left_semi").repartitionByRange("key", "place", "text").sortWithinPartitions("key", "place", "text")
    cut = written(dealt.mapInArrow(_segmenter(long), _ROWS + ", segment long, at long"), "segments")
    near = cut.repartition("segment").sortWithinPartitions("segment", "at")
    matrices = written(near.mapInArrow(_transfers(held), "key string, segment long, matrix array<double>"), "transfers")
    ends = written(matrices.groupBy("key").applyInPandas(_chained, "segment long, entry int, exit int"), "segment-ends")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups((b.rename_columns(["name" if n == "key" else "key" if n == "segment" else n for n in b.schema.names]) for b in batches), 1):
            found = _decoded(rows, held.value)
            found["segment"], found["key"] = rows["key"], rows["name"]
            yield pa.RecordBatch.from_pandas(found, schema=_ARROW, preserve_index=False)

    local = written(cut.join(ends, "segment").repartition("segment").sortWithinPartitions("segment", "at").mapInArrow(decode, _OUT + ", segment long, begun long"), "decoded-segments")
    # A segment's turns are counted from its own start; the number begun in the segments before is added.
    each = local.groupBy("key", "segment").agg(F.sum("begun").alias("begun"))
    before = Window.partitionBy("key").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    offsets = each.select("segment", F.coalesce(F.sum("begun").over(before), F.lit(0)).alias("before"))
    whole = local.join(offsets, "segment").withColumn("turn_no", F.col("turn_no") + F.col("before"))
    return short.union(whole.select(*short.columns))


def held_out(conversation: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(conversation.cast("string")), F.lit(3)) == 1, F.lit(False))


def train(turns: DataFrame, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """The model from labelled turns (conv_id, turn, role, text): the raw forms of the first SAMPLE_TURNS turns of up to
    ``sample`` conversations, SAMPLE_CHARS characters of each. Only learning is bounded so; parse() reads all."""
    ids = [x.conv_id for x in turns.where(F.col("conv_id").isNotNull()).select("conv_id").distinct().orderBy(F.xxhash64("conv_id"), "conv_id").limit(sample).collect()]
    if not ids:
        return learn([])
    own = turns.where(F.col("conv_id").isin(ids)).withColumn("text", F.substring("text", 1, SAMPLE_CHARS))
    first = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = own.withColumn("k", F.row_number().over(first)).where(F.col("k") <= SAMPLE_TURNS)
    rows = rows.select("conv_id", "k", "role", raw(F.col("role"), F.col("conv_id"), F.col("turn"), F.col("text")).alias("raw"))
    found: dict = {}
    for x in sorted(rows.collect(), key=lambda x: (x.conv_id, x.k)):
        found.setdefault(x.conv_id, []).append((x.role, x.raw))
    return learn(list(found.values()))


def report(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, held_out, n_lines, role, turn_no, rendered) for every turn of ``conversations`` (conv_id, turn, role,
    text): each is put into its conversation's raw form, and the roles are recovered from the lines alone. Learns from the
    conversations that aren't held out."""
    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    model = train(turns.where(~held_out(F.col("conv_id"))))
    lines = turns.select(F.col("conv_id").cast("string").alias("key"), F.col("turn").alias("place"), raw(F.col("role"), F.col("conv_id"), F.col("turn"), F.col("text")).alias("text"))
    found = parse(lines, model)
    conv = F.when(F.col("key") != "", F.col("key")).cast("long")
    return found.select(conv.alias("conv_id"), F.col("place").alias("turn"), held_out(conv).alias("held_out"), "n_lines", "role", "turn_no", "rendered")
