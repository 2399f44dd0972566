"""URL filters: host and path rules, and logistic regression on hashed character n-grams, in DataFrame expressions only.

A url's host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lowered; its path is what follows up to ``?``, ``#`` or the end.
A rule (verdict, host, path) fits a url if the url's host is the rule's or a subdomain of it, and the url's path starts with the rule's;
the rule with the longest host and path together decides (then that with the longer host, then ``block`` before ``allow``).
Where no rule fits, the model decides: n-grams of ``ORDERS`` characters of host and path, each between marks of
its beginning and end, are hashed by CRC-32 to ``BUCKETS`` places; a url is the vector of their counts by the root of their number. The score is the
logistic function of its product with the weights; ``block`` from ``THRESHOLD`` on.

The model is fitted to a small table of labelled urls by the limited-memory quasi-Newton method: each step is one aggregation of the written vectors
by place, summed in each task before the shuffle, and brings at most ``BUCKETS + 2`` rows to the driver. The weights, the same bounded number, go back as a
constant of the plan. ``labelled_urls`` makes such a table by rule from word lists; a user brings their own.

Data movement: urls are judged in the scan of two columns; nothing is shuffled.

Defined cases: a null url and one without ``://`` have an empty host and path, which no rule fits and whose score is the model's constant term alone; urls are judged whole, in pieces
of ``PIECE`` characters, so that memory does not grow with their n-grams; labels that are null or neither 0 nor 1 are not learned from; repeated rows count
each; if a label has no rows, every score is 0.5; an empty table gives an empty result; other columns of any name are kept, those named ``host``,
``path``, ``rule``, ``score`` or ``verdict`` are replaced.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bind
from ..session import discard, stored

ORDERS = (3, 4, 5)
BUCKETS = 4096
PIECE = 1000
THRESHOLD = 0.5
#: Steps at most, the changes that the method remembers, the penalty of squared weights, and the largest slope that is flat enough.
STEPS, MEMORY, PENALTY, ENOUGH = 20, 8, 3e-5, 2e-5
#: Rules are a constant of the plan, tried one after the other.
MOST_RULES = 1000

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Fixed values, words of urls to block and of others, from which labelled examples are made.
BLOCKED_WORDS = (
    "ads adserver banner popup click track tracker casino bets betting poker slots jackpot lottery pills pharmacy viagra payday loans crack keygen warez "
    "xxx porn adult cams escort dating phish malware replica forex spam"
)
ORDINARY_WORDS = (
    "news blog wiki docs library school science museum weather garden recipes travel history research university journal press forum code health music "
    "books city council sports radio theatre maps energy law family nature"
)
LURES = "cheap free best hot win easy super instant"
ENDINGS = "example.com example.net example.org com net org info de fr es"
PREFIXES = "www. m. blog. shop. cdn. en."
SYLLABLES = "ba ce di fo gu ha ile jo ka len mi nor ou pa que ra ster tion un va wer th ed ing"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), CAPITALS, SMALL)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    return F.when(at > 0, F.substr(u, at + 3)).otherwise("")


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The deciding rule as ``(verdict, host, path)``, null where none fits."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules are more than {MOST_RULES}")
    if wrong := [r for r in rules if r[0] not in ("allow", "block")]:
        raise ValueError(f"a rule says allow or block: {wrong}")
    order = sorted(set(rules), key=lambda r: (-len(r[1]) - len(r[2]), -len(r[1]), r[0] != "block", r))
    shape = "array<struct<verdict: string, host: string, path: string>>"
    table = F.from_json(F.lit(json.dumps([dict(zip(("verdict", "host", "path"), r, strict=True)) for r in order])), shape)
    fits = lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"])
    return F.get(F.filter(table, fits), F.lit(0))


def over_pieces(text: Column, mark: str, use: Callable[[Column], Column]) -> Column:
    """``use`` of the places of all n-grams that begin in a piece of ``text``, for each piece. ``mark`` tells hosts from paths."""

    def places(chars: Column, own: Column, n: int) -> Column:
        starts = F.least(own, F.size(chars) - (n - 1))
        gram = lambda i: F.concat(F.lit(mark), *[F.get(chars, i + k) for k in range(n)])
        return F.when(starts > 0, F.transform(F.sequence(F.lit(0), starts - 1), lambda i: (F.crc32(gram(i)) % BUCKETS).cast("int"))).otherwise(F.array().cast("array<int>"))

    def of(pieces: Column, i: Column) -> Column:
        own = F.get(pieces, i)
        more = F.substring(F.coalesce(F.get(pieces, i + 1), F.lit("")), 1, max(ORDERS) - 1)
        chars = F.regexp_extract_all(F.concat(own, more), F.lit("(?s)."), F.lit(0))
        return bind(chars, lambda c: use(F.concat(*[places(c, F.char_length(own), n) for n in ORDERS])))

    whole = F.concat(F.lit("^"), text, F.lit("$"))
    return bind(F.regexp_extract_all(whole, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), lambda p: F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda i: of(p, i)))


def _grams(text: Column) -> Column:
    """The number of n-grams of a text between its marks; an empty text has none."""
    size = F.char_length(text) + 2
    return F.when(size == 2, 0).otherwise(sum((F.greatest(size - n + 1, F.lit(0)) for n in ORDERS), F.lit(0)))


def scale(host: Column, path: Column) -> Column:
    return 1 / F.sqrt(F.greatest(_grams(host) + _grams(path), F.lit(1)).cast("double"))


def vector(host: Column, path: Column) -> Column:
    """All places of a url, one for each n-gram."""
    none = F.array().cast("array<int>")
    one = lambda text, mark: F.when(text == "", none).otherwise(F.flatten(over_pieces(text, mark, lambda p: p)))
    return F.concat(one(host, "h"), one(path, "p"))


def constant(weights: list[float]) -> Column:
    """An array that the optimizer folds to one value."""
    return F.from_json(F.lit(json.dumps(weights)), "array<double>")


def dot(places: Column, weights: Column) -> Column:
    return F.aggregate(places, F.lit(0.0), lambda a, b: a + F.get(weights, b))


def logistic(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def score(host: Column, path: Column, weights: list[float]) -> Column:
    """``weights`` has ``BUCKETS`` numbers and then the constant term."""
    w = constant(weights)
    add = lambda values: F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    one = lambda text, mark: F.when(text == "", F.lit(0.0)).otherwise(add(over_pieces(text, mark, lambda p: dot(p, w))))
    return logistic((one(host, "h") + one(path, "p")) * scale(host, path) + F.lit(weights[BUCKETS]))


def _dot(a: list[float], b: list[float]) -> float:
    return math.fsum(x * y for x, y in zip(a, b, strict=True))


def _direction(gradient: list[float], pairs: list[tuple[list[float], list[float]]]) -> list[float]:
    """The step of the limited-memory quasi-Newton method from the latest changes of weights and of gradients."""
    out, used = [-g for g in gradient], []
    for s, y in reversed(pairs):
        a = _dot(s, out) / _dot(s, y)
        out = [v - a * u for v, u in zip(out, y, strict=True)]
        used.append(a)
    if pairs:
        s, y = pairs[-1]
        size = _dot(s, y) / _dot(y, y)
        out = [v * size for v in out]
    for (s, y), a in zip(pairs, reversed(used), strict=True):
        b = _dot(y, out) / _dot(s, y)
        out = [v + (a - b) * u for v, u in zip(out, s, strict=True)]
    return out


def fit(labelled: DataFrame, steps: int = STEPS) -> list[float]:
    """Weights of ``BUCKETS`` places and the constant term from ``url, label`` (1: block); both labels count alike."""
    rows = labelled.filter("label in (0, 1)").select(host_of(F.col("url")).alias("h"), path_of(F.col("url")).alias("p"), F.col("label").cast("double").alias("y"))
    x = scale(F.col("h"), F.col("p"))
    terms = bind(x, lambda v: F.transform(vector(F.col("h"), F.col("p")), lambda b: F.struct(b.alias("place"), v.alias("x"))))
    # the constant term is one more place, whose value is 1 in every row
    work = stored(rows.select("y", F.concat(terms, F.array(F.struct(F.lit(BUCKETS).alias("place"), F.lit(1.0).alias("x")))).alias("terms")), "url-vectors")
    sizes = {r.y: r.n for r in work.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    weights = [0.0] * (BUCKETS + 1)
    if len(sizes) < 2:
        discard(work)
        return weights
    share = F.when(F.col("y") == 1, 0.5 / sizes[1.0]).otherwise(0.5 / sizes[0.0])

    def judged(w: list[float]) -> tuple[float, list[float]]:
        """The penalised loss and its gradient."""
        z = F.aggregate("terms", F.lit(0.0), lambda a, t: a + t["x"] * F.get(constant(w), t["place"]))
        rows = work.select(z.alias("z"), share.alias("s"), "y", "terms")
        loss = F.greatest(F.col("z"), F.lit(0.0)) + F.log1p(F.exp(-F.abs("z"))) - F.col("y") * F.col("z")
        wrong = rows.select(((logistic(F.col("z")) - F.col("y")) * F.col("s")).alias("r"), (loss * F.col("s")).alias("loss"), "terms")
        # the loss is counted as one place more
        parts = wrong.select("r", "loss", F.explode(F.concat("terms", F.array(F.struct(F.lit(BUCKETS + 1).alias("place"), F.lit(1.0).alias("x"))))).alias("t"))
        value = F.when(F.col("t.place") > BUCKETS, F.col("loss")).otherwise(F.col("r") * F.col("t.x"))
        found = {r.place: r.v for r in parts.groupBy(F.col("t.place").alias("place")).agg(F.sum(value).alias("v")).collect()}  # BUCKETS + 2 rows at most
        penalised = [*w[:BUCKETS], 0.0]
        return found[BUCKETS + 1] + PENALTY / 2 * _dot(penalised, penalised), [found.get(i, 0.0) + PENALTY * p for i, p in enumerate(penalised)]

    pairs: list[tuple[list[float], list[float]]] = []
    loss, gradient = judged(weights)
    way, length = _direction(gradient, pairs), 1.0
    for _ in range(steps):
        slope = _dot(gradient, way)
        there = [w + length * d for w, d in zip(weights, way, strict=True)]
        new_loss, new_gradient = judged(there)
        if new_loss > loss + 1e-4 * length * slope:  # too far
            length /= 4
            continue
        change = [a - b for a, b in zip(there, weights, strict=True)]
        bend = [a - b for a, b in zip(new_gradient, gradient, strict=True)]
        weights, loss, gradient = there, new_loss, new_gradient
        if max(map(abs, gradient)) < ENOUGH:
            break
        if _dot(change, bend) > 0:
            pairs = [*pairs, (change, bend)][-MEMORY:]
        way, length = _direction(gradient, pairs), 1.0
    discard(work)
    # sums differ in their last digits by the order of tasks
    return [round(w, 6) for w in weights]


def labelled_urls(spark: SparkSession, rows: int = 1500, seed: int = 42) -> DataFrame:
    """``id, url, label``: half of the urls hold a word of ``BLOCKED_WORDS`` in host or path, the others ordinary or made-up words only."""

    def pick(words: str, k: int) -> Column:
        listed = F.split(F.lit(words), " ")
        return F.get(listed, F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id"), F.lit(len(words.split()))).cast("int"))

    made_up = F.concat(pick(SYLLABLES, 1), pick(SYLLABLES, 2), F.when(F.col("id") % 3 > 0, pick(SYLLABLES, 3)).otherwise(""))
    label = (F.col("id") % 2).cast("int")
    ordinary = F.when(F.col("id") % 4 < 2, pick(ORDINARY_WORDS, 4)).otherwise(made_up)
    blocked = F.when(F.col("id") % 3 == 0, F.concat(pick(LURES, 5), F.lit("-"), pick(BLOCKED_WORDS, 6))).when(F.col("id") % 3 == 1, F.concat_ws("-", pick(BLOCKED_WORDS, 6), pick(BLOCKED_WORDS, 7))).otherwise(pick(BLOCKED_WORDS, 6))
    # one in five blocked urls tells it by its path
    by_path = F.col("id") % 5 == 0
    name = F.when((label == 1) & ~by_path, blocked).otherwise(ordinary)
    host = F.concat(F.when(F.col("id") % 7 < 3, pick(PREFIXES, 8)).otherwise(""), name, F.lit("."), pick(ENDINGS, 9))
    word = F.when((label == 1) & by_path, blocked).otherwise(F.when(F.col("id") % 6 < 2, pick(ORDINARY_WORDS, 10)).otherwise(pick("en de fr es", 11)))
    number = F.pmod(F.xxhash64(F.lit(seed), F.lit(12), "id"), F.lit(1000)).cast("string")
    path = F.concat(F.lit("/"), word, F.lit("/"), F.when(F.col("id") % 8 < 7, number).otherwise(pick(ORDINARY_WORDS, 13)), pick("/ .html", 14))
    return spark.range(rows).select("id", F.concat(F.lit("https://"), host, path).alias("url"), label.alias("label"))


def judge(df: DataFrame, rules: list[tuple[str, str, str]], weights: list[float], url: str = "url") -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` (its host and path together, null where none fits), ``score`` and ``verdict``."""
    added = ("host", "path", "rule", "score", "verdict")
    work = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in added], F.lit(None).alias("_")).alias("row"), host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    work = work.select("*", rule_of(F.col("host"), F.col("path"), rules).alias("fits"), score(F.col("host"), F.col("path"), weights).alias("score"))
    said = F.coalesce("fits.verdict", F.when(F.col("score") >= THRESHOLD, "block").otherwise("allow"))
    kept = [F.col("row").getField(c).alias(c) for c in df.columns if c not in added]
    return work.select(*kept, "host", "path", F.concat("fits.host", "fits.path").alias("rule"), "score", said.alias("verdict"))
