"""Secret scans: fixed patterns, and character Markov models of random strings and of ordinary identifiers.

Two first-order models are trained from labelled samples: the chance of a character given the one before, in random
strings and in identifiers and words. A token is a secret if its log-likelihood ratio is at least ``LEAST_TOTAL`` nats, and
``LEAST_MEAN`` nats a character; it is added unless it lies wholly in a span that a pattern has taken.

All of it is DataFrame expressions. A text is split by a pattern once; the pieces between matches and the matches themselves
give every position by running sums. Spans are merged in one fold over their order, and a redacted text is joined from blocks
of the text, so the time is in proportion to the text and its spans.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import unused

ASSIGN = r"""(?=[pPsStTaA])(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs are maximal, so a shorter run is dropped by the pattern itself just as by a look at its length afterwards.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
KINDS = ("assign", "access", "hex", "markov")
MASK = "[SECRET]"

#: Characters with a place of their own in the models; any other one shares place 0.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
WIDTH = len(ALPHABET) + 1
LEAST_MEAN = 0.35
LEAST_TOTAL = 8.0
#: Labelled samples: random strings of each kind, and pairs of words for identifiers.
SAMPLES = 3000
#: Elements of a block in a running sum, and characters of a block of text.
_BLOCK = 256
_TEXT_BLOCK = 4096

#: Word parts of ordinary identifiers and texts.
WORDS = """
access account action active add address alias align all amount and anchor animation any api app apply archive are area array
assert asset async attribute audio auth author auto available back background balance bar base batch before bind bit block board body
book border bottom bound box branch bridge browser buffer build builder bundle button byte cache calendar call cancel card case cell
center chain change channel character chart check child city class clean clear click client clock close cluster code color column
command comment commit common compare complete component condition config connect connection constant container content context
control convert copy core count counter country create current cursor customer data database date day debug decode default delete
delta depth description design detail device dialog digest dimension direct directory disable display document domain down download
draft drive driver duration edge edit element email enable encode end engine entity entry enum error event example exception execute
export expression extension external factory feature fetch field file filter final find first flag float flow focus folder font
footer for form format forward frame free from function general generate get global graph grid group handle handler hash header
height help history home host http icon identifier image import index info init inner input insert install instance integer interface
internal invalid invoice item iterator job join json key keyboard label language large last layer layout leaf left length level
library license limit line link list listener load local location lock log login long loop machine main manager map margin mark
match matrix maximum member memory menu merge message metadata method metric middle minimum mode model module monitor month mouse
move multi name native network new next node normal note null number object offset open operation operator option order origin
other output overflow owner package padding page panel parameter parent parse parser part password path pattern payment pending
permission phone pixel platform player plugin point policy pool port position prefix preview previous price primary print priority
private process product profile program progress project property protocol provider proxy public query queue random range rate
read reader ready record reference region register release remove render repeat replace report request require reset resource
response result return right role root route row rule run safe sample save scale schedule schema scope screen script scroll search
second section select sender sequence server service session set setting shape share sheet shift show side signal simple single size
slice small socket sort source space span split stack stage standard start state static status step stop storage store stream string
strip structure style subject submit success sum super support switch symbol sync system table tag target task template test text
that the then theme thread time timeout timer title toggle token tool top total trace track transaction transfer transform tree
trigger type union unique unit update upload user utility valid validate value variable vector version video view visible volume
wait warning watch week weight wheel when width window with word work worker wrapper write writer year zone
the ation ing tion er ed est and that with from nder eres ther ention ble ness ment able ly ous ful ship hood ward
der die das und ein eine nicht ist von mit sich auf für werden schaft ung heit keit lich isch chen ver ent ge be zer über unter
le la les de des du que une dans pour qui sur avec est eau eaux elle ette tion ment aire eur euse ique oir ance ence ouvre
el los las del una para con por que ción mente ado ada ando iendo oso osa dad ista ero era aron aba llo rra
""".split()  # fmt: skip


def samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """(text, label): n strings of each kind of random string (label random), and 3 n identifiers (label ordinary), by rule."""
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 512)
    size = (20 + F.pmod("id", F.lit(21))).cast("int")
    b64 = F.translate(F.base64(F.unhex(digest)), "\r\n", "")
    rows = spark.range(n)
    strings = [F.substr(b64, F.lit(1), size), F.regexp_replace(F.substr(b64, F.lit(30), size), "[+/=]", ""), F.substr(digest, F.lit(1), size), F.upper(F.regexp_replace(F.substr(b64, F.lit(9), size), "[+/=]", ""))]
    random = rows.select(F.explode(F.array(*strings)).alias("text"), F.lit("random").alias("label"))
    words = F.split(F.lit(" ".join(WORDS)), " ")
    word = lambda salt: F.element_at(words, (F.pmod(F.xxhash64(F.lit(salt), F.col("id")), F.lit(len(WORDS))) + 1).cast("int"))
    a, b, c, d = map(word, ("a", "b", "c", "d"))
    number = F.pmod(F.xxhash64(F.lit("n"), F.col("id")), F.lit(100)).cast("string")
    forms = [F.concat(a, F.initcap(b), F.initcap(c)), F.concat_ws("_", a, b, c, number), F.concat(a, b, c, d), F.upper(F.concat_ws("_", a, b, c)), F.concat_ws("-", a, b, c), F.concat(F.initcap(a), b, c), F.upper(F.concat(a, b, c)), F.concat_ws("/", a, b, c, number)]
    ordinary = rows.select(F.explode(F.array(*forms)).alias("text"), F.lit("ordinary").alias("label"))
    return random.union(ordinary)


def _codes(text: Column) -> Column:
    return F.transform(F.split(text, ""), lambda c: F.when(c == "", F.lit(0)).otherwise(F.instr(F.lit(ALPHABET), c)))


def train(labelled: DataFrame, smoothing: float = 0.5) -> list[float]:
    """Log ratios of the two models by (character before, character): random over ordinary, from (text, label) rows.

    Pairs are counted in the data frame; what comes to the driver has WIDTH * WIDTH rows a label at most. Null texts and
    other labels count nothing; without samples of a label its model is even.
    """
    codes = labelled.where(F.col("label").isin("random", "ordinary") & F.col("text").isNotNull()).select("label", _codes(F.col("text")).alias("c"))
    pairs = F.zip_with(F.slice("c", F.lit(1), F.size("c") - 1), F.slice("c", F.lit(2), F.size("c") - 1), lambda a, b: a * WIDTH + b)
    counted = codes.where(F.size("c") > 1).select("label", F.explode(pairs).alias("pair")).groupBy("label", "pair").agg(F.count(F.lit(1)).alias("n"))
    counts = {"random": [smoothing] * WIDTH * WIDTH, "ordinary": [smoothing] * WIDTH * WIDTH}
    for x in counted.collect():
        counts[x.label][x.pair] += x.n
    logs = {}
    for label, n in counts.items():
        sums = [sum(n[a * WIDTH : (a + 1) * WIDTH]) for a in range(WIDTH)]
        logs[label] = [math.log(n[i] / sums[i // WIDTH]) for i in range(WIDTH * WIDTH)]
    return [round(r - o, 4) for r, o in zip(logs["random"], logs["ordinary"], strict=True)]


def log_ratio(token: Column, ratios: list[float]) -> Column:
    """The token's log-likelihood ratio, random over ordinary."""
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")
    start = F.struct(F.lit(-1).alias("before"), F.lit(0.0).alias("sum"))
    step = lambda s, c: F.struct(c.alias("before"), (s["sum"] + F.when(s["before"] < 0, 0.0).otherwise(F.get(table, s["before"] * WIDTH + c))).alias("sum"))
    return F.aggregate(_codes(token), start, step, lambda s: s["sum"])


def is_random(token: Column, ratios: list[float]) -> Column:
    total = log_ratio(token, ratios)
    return (total >= LEAST_TOTAL) & (total >= LEAST_MEAN * F.length(token))


def _named(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, step) -> Column:
    """For each element of an array of longs, what ``step`` has made of 0 and all before it: a fold of each block, and one over
    the blocks' results, so that no array is copied more than a block's length."""
    zero = F.lit(0).cast("long")

    def fold(start, x):
        first = F.struct(start.alias("now"), F.array().cast("array<bigint>").alias("all"))
        return F.aggregate(x, first, lambda s, v: F.struct(step(s["now"], v).alias("now"), F.array_append(s["all"], s["now"]).alias("all")), lambda s: s["all"])

    def folded(x):
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / _BLOCK).cast("int")), lambda b: F.slice(x, b * _BLOCK + 1, F.lit(_BLOCK)))

        def both(parts):
            starts = fold(zero, F.transform(parts, lambda p: F.aggregate(p, zero, step)))
            return F.flatten(F.zip_with(starts, parts, fold))

        return F.when(F.size(x) <= _BLOCK, fold(zero, x)).otherwise(_named(blocks, both))

    return F.when(F.size(values) == 0, F.array().cast("array<bigint>")).otherwise(_named(values, folded))


def running_sums(values: Column) -> Column:
    """For each element, the sum of those before it."""
    return running(values, lambda s, v: s + v)


def _spans(text: Column, pattern: str, kind: int, wanted=None, group: int | None = None) -> Column:
    """Spans (start, kind, stop) of the pattern's matches that are wanted, in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    pieces = F.split(text, pattern, -1)
    lengths = F.zip_with(F.slice(pieces, F.lit(1), F.size(pieces) - 1), found, lambda p, m: (F.length(p) + F.length(m)).cast("long"))
    rows = F.arrays_zip(running_sums(lengths).alias("before"), lengths.alias("both"), found.alias("match"), inner.alias("inner"))
    if wanted is not None:
        rows = F.filter(rows, lambda x: wanted(x["inner"]))
    span = lambda x: F.struct((x["before"] + x["both"] - F.length(x["match"])).alias("start"), F.lit(kind).alias("kind"), (x["before"] + x["both"]).alias("stop"))
    none = F.array().cast("array<struct<start:bigint,kind:int,stop:bigint>>")
    return F.when(text.rlike(pattern), F.transform(rows, span)).otherwise(none)


def by_place(spans: Column) -> Column:
    """Spans by start, longer ones first, each with ``upto``: the furthest end of those before it."""
    order = lambda x: F.struct(x["start"].alias("start"), (-x["stop"]).alias("minus"), x["kind"].alias("kind"))

    def followed(x):
        upto = running(F.transform(x, lambda s: -s["minus"]), lambda s, v: F.greatest(s, v))
        return F.zip_with(x, upto, lambda s, u: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), (-s["minus"]).alias("stop"), u.alias("upto")))

    return _named(F.sort_array(F.transform(spans, order)), followed)


def _plain(found: Column) -> Column:
    return F.array_sort(F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["stop"].alias("stop"))))


def _within(text: Column, ratios: list[float]) -> Column:
    """(assign, access, hex, added): the spans of each pattern, and those that the models add."""

    def added(found):
        base = F.concat(found["assign"], found["access"], found["hex"])
        # What lies wholly in base spans that meet is told apart by place: a base span is never behind what it holds.
        placed = by_place(F.concat(F.transform(base, lambda x: x.withField("kind", F.lit(-1))), found["markov"]))
        new = _plain(F.filter(placed, lambda x: (x["kind"] == 3) & (x["stop"] > x["upto"])))
        return F.struct(found["assign"].alias("assign"), found["access"].alias("access"), found["hex"].alias("hex"), F.when(F.size(found["markov"]) > 0, new).otherwise(found["markov"]).alias("added"))

    patterns = F.struct(
        _spans(text, ASSIGN, 0, lambda v: F.length(v) >= 12, 2).alias("assign"), _spans(text, ACCESS, 1).alias("access"), _spans(text, HEX, 2).alias("hex"),
        _spans(text, TOKEN, 3, lambda t: is_random(t, ratios)).alias("markov"),
    )
    return _named(patterns, added)


def spans(docs: DataFrame, ratios: list[float]) -> DataFrame:
    """``docs`` with __assign, __access, __hex, __base (all of these) and __added: arrays of (start, kind, stop), code points
    with an exclusive end, by start.

    Kinds are places in KINDS. Null texts are empty. Added spans don't lie wholly in an earlier span, but may overlap one.
    """
    found = docs.withColumn("__found", _within(F.coalesce(F.col("text").cast("string"), F.lit("")), ratios))
    found = found.withColumns({f"__{k}": F.col("__found")[k] for k in ("assign", "access", "hex", "added")})
    return found.withColumn("__base", F.array_sort(F.concat("__assign", "__access", "__hex"))).drop("__found")


def _joined(found: Column) -> Column:
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", name(x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def report(docs: DataFrame, ratios: list[float]) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every row."""
    found = spans(docs.select("doc_id", "text"), ratios)
    return found.select(
        "doc_id", F.size("__assign").cast("long").alias("n_assign"), F.size("__access").cast("long").alias("n_access"), F.size("__hex").cast("long").alias("n_hex"),
        F.sha2(_joined(F.col("__base")), 256).alias("base_sha256"), _joined(F.array_sort(F.concat("__base", "__added"))).alias("spans"),
    )


def masked(text: Column, found: Column) -> Column:
    """``text`` with MASK in place of each stretch that spans cover; spans that overlap or meet are one stretch."""

    def joined(x):
        chunks, placed = x["chunks"], x["placed"]

        def between(a, b):
            """Characters a to b, from the blocks that hold them."""
            i, j = F.floor(a / _TEXT_BLOCK).cast("int"), F.floor(b / _TEXT_BLOCK).cast("int")
            at = lambda k: F.coalesce(F.get(chunks, k), F.lit(""))
            head, tail = (a - i * _TEXT_BLOCK).cast("int"), (b - j * _TEXT_BLOCK).cast("int")
            far = F.concat(F.substring(at(i), head + 1, F.lit(_TEXT_BLOCK)), F.array_join(F.slice(chunks, i + 2, F.greatest(F.lit(0), j - i - 1)), ""), F.substring(at(j), F.lit(1), tail))
            return F.when(i == j, F.substring(at(i), head + 1, tail - head)).otherwise(far)

        heads = F.filter(placed, lambda s, k: (k == 0) | (s["start"] > s["upto"]))
        end = F.aggregate(placed, F.lit(0).cast("long"), lambda m, s: F.greatest(m, s["stop"]))
        before = F.array_join(F.transform(heads, lambda s: F.concat(between(s["upto"], s["start"]), F.lit(MASK))), "")
        return F.concat(before, between(end, x["size"]))

    parts = F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_TEXT_BLOCK}}}"), F.lit(0)).alias("chunks"), by_place(found).alias("placed"), F.length(text).cast("long").alias("size"))
    return F.when(F.size(found) > 0, _named(parts, joined)).otherwise(text)


def redact(docs: DataFrame, ratios: list[float]) -> DataFrame:
    """``docs`` with each stretch of text that spans() lists replaced by MASK, and n_chars counted anew where text changed. No
    row goes, and texts without a secret (null ones too) are unchanged. Other columns may have any name."""

    def of(text):
        return _named(_within(text, ratios), lambda x: masked(text, F.concat(x["assign"], x["access"], x["hex"], x["added"])))

    text = F.when(F.col("text").isNotNull(), _named(F.col("text").cast("string"), of))
    old, = unused(docs, "__old")
    found = docs.withColumns({"text": text, old: F.col("text")})
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.col("text") != F.col(old), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return found.select(*docs.columns)
