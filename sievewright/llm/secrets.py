"""Secret scanning in DataFrame expressions only.

Base rules give three kinds of spans: ``assign`` (a key word, a sign, a value of 12 characters or more), ``access``
(key ids) and ``hex`` (runs of 16 hex digits or more). The method adds ``random`` spans: runs of token characters outside
base spans (what is left of a run that a base span overlaps is judged by itself), scored by two first-order character Markov models, one of random
strings and one of ordinary identifiers. A run is a secret if the log-likelihood ratio per transition reaches ``THRESHOLD``.

The models are trained by a DataFrame job from labelled samples. Random strings are made by rule: hashes in base64, in its
form for addresses, in letters and digits, capitals, and hex. Ordinary identifiers are words joined in eight shapes (camel case, snake
case, paths, numbered names); the words are ``WORDS`` and those of the whole corpus: every distinct word is in one identifier, beside
two of ``WORDS``. Only the table of log ratios comes to the driver: 128 x 128 numbers for any input.

Matches are found in whole texts: ``split`` gives the pieces between matches and ``regexp_extract_all`` the matches, so that
running lengths are the positions, in code points. The scan is a map without a shuffle.

Defined cases: null text is empty; an empty text has no spans; a text of any length is scanned in time linear in its
length for a given number of matches; repeated rows are scanned each; spans of different kinds with one start are in the
order of ``KINDS``; an empty table gives an empty result; the only added column is the struct ``found``, and a column of that name is replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fresh

#: Fixed patterns of the base rules; a value or run that is too short is dropped after matching.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}
#: What a text must hold for a match of the kind that is long enough.
HINT = {"assign": r"(?i:passw|secret|token|api_?key)", "access": r"AKIA[A-Z0-9]{14}", "hex": r"[0-9a-f]{16}", "random": r"[A-Za-z0-9+/_=-]{20}"}
KINDS = ["assign", "access", "hex", "random"]

RUN = r"[A-Za-z0-9+/_=-]{20,}"
THRESHOLD = 0.6
SIZE = 128
SAMPLES = 8000
SMOOTHING = 0.05
#: Fixed words that ordinary identifiers are joined from, besides those of the corpus.
WORDS = (
    "account action active address agent array async batch block buffer button cache call change check child class clear client close code column command "
    "comment config content context control count create current cursor data date default delete depth detail device directory document domain edit email "
    "enable encode entry error event export factory field file filter find format frame function global group handle header height hidden history image "
    "import index info input insert instance item iterator journal key label language last layer layout length level library limit line link list load "
    "local lock logger manager map margin match member memory menu merge message method model module mount move name network node number object offset "
    "option order output package page panel parent parse path pattern point policy port prefix process product profile project property query queue "
    "range reader record region release remote render report request reset resource response result return role root route sample schema score screen "
    "script search section select server service session shape size source stack state status storage stream string style system table target task "
    "template text thread time title tree type update upload user value version view visible volume warning width window worker writer"
).split()


def corpus_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word``: every distinct word of 3 to 14 ASCII letters of all documents, in lower case."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"(?<![a-z0-9])[a-z]{3,14}(?![a-z0-9])"), F.lit(0))
    return docs.select(F.explode(F.array_distinct(words)).alias("word")).distinct()


def _identifier(shape: Column, number: Column, a: Column, b: Column, c: Column, d: Column) -> Column:
    """Four words joined in one of eight shapes, some with a number."""
    return (
        F.when(shape == 0, F.concat(a, F.initcap(b), F.initcap(c), F.initcap(d)))
        .when(shape == 1, F.concat_ws("_", a, b, c, number))
        .when(shape == 2, F.concat_ws("/", a, b, c, F.concat(d, number)))
        .when(shape == 3, F.upper(F.concat_ws("_", a, b, c)))
        .when(shape == 4, F.concat_ws("-", a, b, c, d))
        .when(shape == 5, F.concat(F.initcap(a), F.initcap(b), F.initcap(c), number))
        .when(shape == 6, F.concat(F.lit("https/"), a, F.lit("/"), b, F.lit("="), number, F.lit("/"), c))
        .otherwise(F.concat(a, b, c, d))
    )


def labelled_samples(spark: SparkSession, docs: DataFrame | None = None, n: int = SAMPLES) -> DataFrame:
    """``sample string, random boolean``: ``n`` strings of either label, and an ordinary one for every distinct word of ``docs``."""
    words = F.split(F.lit(" ".join(WORDS)), " ")
    i = F.col("id")
    pick = lambda key, salt: F.get(words, F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(len(WORDS))).cast("int"))
    number = lambda key: F.pmod(F.xxhash64(key, F.lit(9)), F.lit(2000)).cast("string")
    digest = F.sha2(F.concat(F.lit("sample"), i.cast("string")), 256)
    raw = F.base64(F.unhex(digest))
    letters = F.regexp_replace(raw, "[+/=]", "")
    random = (
        F.when(i % 6 == 0, letters)
        .when(i % 6 == 1, raw)
        .when(i % 6 == 2, F.substr(digest, F.lit(1), F.lit(40)))
        .when(i % 6 == 3, F.upper(letters))
        .when(i % 6 == 4, F.translate(F.regexp_replace(raw, "=", ""), "+/", "-_"))
        .otherwise(F.lower(letters))
    )
    ordinary = _identifier(i % 8, number(i), *[pick(i, k) for k in range(4)])
    both = F.array(F.struct(random.alias("sample"), F.lit(True).alias("random")), F.struct(ordinary.alias("sample"), F.lit(False).alias("random")))
    fixed = spark.range(n).select(F.explode(both)).select("col.*")
    if docs is None:
        return fixed
    w = F.col("word")
    of_words = _identifier(F.pmod(F.xxhash64(w), F.lit(8)), number(w), w, pick(w, 1), w, pick(w, 3))
    return fixed.unionByName(corpus_words(docs).select(of_words.alias("sample"), F.lit(False).alias("random")))


def train(samples: DataFrame) -> list[float]:
    """Log ratio of each transition, random over ordinary: entry ``SIZE * code(first) + code(second)``.

    ``samples(sample string, random boolean)``; characters beyond ASCII are ignored.
    """
    chars = F.filter(F.split("sample", ""), lambda c: (F.ascii(c) > 0) & (F.ascii(c) < SIZE))
    pairs = F.transform(F.sequence(F.lit(0), F.size("chars") - 2), lambda k: F.ascii(F.get("chars", k)) * SIZE + F.ascii(F.get("chars", k + 1)))
    counted = samples.filter("sample is not null and random is not null").select("random", chars.alias("chars")).filter(F.size("chars") > 1)
    counted = counted.select("random", F.explode(pairs).alias("pair")).groupBy("random", "pair").count()
    # bounded: 2 * SIZE * SIZE rows at most
    counts = {(r["random"], r["pair"]): r["count"] for r in counted.collect()}
    used = sorted({c for _, p in counts for c in divmod(p, SIZE)})
    totals = {(kind, a): sum(counts.get((kind, a * SIZE + b), 0) for b in used) for kind in (True, False) for a in used}
    table = [0.0] * (SIZE * SIZE)
    for a in used:
        for b in used:
            chance = [(counts.get((kind, a * SIZE + b), 0) + SMOOTHING) / (totals[kind, a] + SMOOTHING * len(used)) for kind in (True, False)]
            table[a * SIZE + b] = log(chance[0] / chance[1])
    return table


def _positions(text: Column, pattern: str, size: Column | None = None, least: int = 0) -> Column:
    """Array of ``struct(start, end)`` of the matches; ``size`` gives each match's deciding length, in the order of matches."""
    pieces, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.transform(hits if size is None else size, F.char_length)
    rows = F.arrays_zip(F.transform(F.slice(pieces, F.lit(1), F.size(hits)), F.char_length).alias("gap"), F.transform(hits, F.char_length).alias("length"), sizes.alias("size"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(a: Column, r: Column) -> Column:
        begin = a["at"] + r["gap"]
        end = begin + r["length"]
        return F.struct(end.alias("at"), F.when(r["size"] >= least, F.concat(a["out"], F.array(F.struct(begin.alias("start"), end.alias("end"))))).otherwise(a["out"]).alias("out"))

    return F.aggregate(rows, start, step, lambda a: a["out"])


def _named(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end")))


EMPTY = "array<struct<start:int,kind:int,end:int>>"


def scan(df: DataFrame, model: list[float], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``found``: ``base`` and ``spans``, arrays of ``struct(start, kind, end)`` in the order of start, then kind.

    ``kind`` counts in ``KINDS``; ``spans`` holds base and random spans.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    nothing = F.array().cast(EMPTY)
    size = {"assign": F.regexp_extract_all(body, F.lit(ASSIGN), F.lit(2))}
    base = [F.when(body.rlike(HINT[k]), _named(k, _positions(body, rx, size.get(k), LEAST[k]))).otherwise(nothing) for k, rx in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX))]
    spans, clear = fresh(df.columns, "base_spans"), fresh(df.columns, "clear_text")
    df = df.withColumn(spans, F.array_sort(F.concat(*base)))
    # base spans become blanks, so that no run touches one
    df = df.withColumn(clear, F.when(F.size(spans) == 0, body).otherwise(_replaced(body, F.col(spans), lambda s: F.repeat(F.lit(" "), s["end"] - s["start"]))))
    ratios = F.split(F.lit(",".join(f"{x:.6g}" for x in model)), ",").cast("array<double>")

    def score(s: Column) -> Column:
        chars = F.split(F.substr(F.col(clear), s["start"] + 1, s["end"] - s["start"]), "")
        total = F.aggregate(chars, F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum")), lambda a, c: F.struct(F.ascii(c).alias("last"), (a["sum"] + F.when(a["last"] < 0, 0.0).otherwise(F.get(ratios, a["last"] * SIZE + F.ascii(c)))).alias("sum")), lambda a: a["sum"])
        return total / (s["end"] - s["start"] - 1)

    runs = F.filter(_positions(F.col(clear), RUN), lambda s: score(s) >= threshold)
    added = F.when(F.col(clear).rlike(HINT["random"]), _named("random", runs)).otherwise(nothing)
    return df.withColumn("found", F.struct(F.col(spans).alias("base"), F.array_sort(F.concat(spans, added)).alias("spans"))).drop(spans, clear)


def _replaced(text: Column, spans: Column, mark: Callable[[Column], Column]) -> Column:
    """``text`` with spans (in order of start) replaced by ``mark``; of overlapping ones the first is, the others' rest is cut, as long as ``mark`` is for the rest."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        rest = F.struct(F.greatest(a["at"], s["start"]).alias("start"), s["end"].alias("end"))
        fresh_one = F.concat(a["out"], F.array(F.substr(text, a["at"] + 1, s["start"] - a["at"]), mark(rest)))
        longer = F.concat(a["out"], F.array(F.lit(""), mark(rest)))
        out = F.when(s["start"] >= a["at"], fresh_one).when(s["end"] > a["at"], longer).otherwise(a["out"])
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), out.alias("out"))

    return F.aggregate(spans, start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substr(text, a["at"] + 1, F.char_length(text))))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(df: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``text`` with every found span replaced by ``mark``, spans that overlap by one; needs ``found``. Null text stays null."""
    # spans that overlap become one first
    start = F.array().cast("array<struct<start:int,end:int>>")

    def step(a: Column, s: Column) -> Column:
        last = F.element_at(a, -1)
        own = F.struct(s["start"].alias("start"), s["end"].alias("end"))
        joined_one = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when(F.size(a) == 0, F.array(own)).when(s["start"] < last["end"], F.concat(F.slice(a, 1, F.size(a) - 1), F.array(joined_one))).otherwise(F.concat(a, F.array(own)))

    whole = _replaced(F.col(text), F.aggregate("found.spans", start, step), lambda s: F.lit(mark))
    return df.withColumn(text, F.when(F.size("found.spans") > 0, whole).otherwise(F.col(text)))
