"""An interpolated Kneser-Ney language model as tables, perplexity over sliding windows, and what follows from whole predicted distributions.

The probability of ``w`` after ``(u, v)`` is what is left of its count after a discount, by the context's count, and the context's back-off weight times the probability
after ``v`` alone, whose counts are numbers of distinct left neighbours; and so on down to an even share of the vocabulary, which has one more place
for unknown tokens. A context that was never seen backs off with weight 1. Orders are 2 (pairs have plain counts) and 3.

Tokens are told apart by 64 bits (``xxhash64``), so that only numbers are shuffled. Grams are counted in each document first; tables are joined by context or by gram, and AQE
can split each join's frequent contexts, as the other side has one row for each.

Sums over a whole distribution never meet a row for each context and word: a context's seen words are summed as they are, and the rest has the lower order's
probabilities times one weight, so that its sums are totals over the vocabulary less those over the seen words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bind
from ..functions.numbers import sane_perplexity
from ..session import stored
from .contexts import scored
from .features import counted, over_cores

DISCOUNT = 0.75
#: Sliding windows: tokens that a window holds, and how far it moves.
MAX_LENGTH, STRIDE = 1024, 512


@dataclass
class BackOff:
    """``words(w, p1)``; ``pairs(v, w, seen)`` and ``backs(v, back)``; for order 3 ``triples(u, v, w, seen)`` and ``triple_backs(u, v, back)``; ``unknown``, the probability of a word of no place."""

    order: int
    words: DataFrame
    unknown: float
    pairs: DataFrame
    backs: DataFrame
    triples: DataFrame | None = None
    triple_backs: DataFrame | None = None


def window_start(place: Column, max_length: int, stride: int) -> Column:
    """Where the first window that holds a place begins: windows begin at multiples of ``stride`` (``max_length`` at most)."""
    s = min(stride, max_length)
    return F.greatest(F.ceil((place - (max_length - 1)) / F.lit(s)), F.lit(0)) * s


def window_grams(df: DataFrame, key: str, tokens: Column, max_length: int = MAX_LENGTH, stride: int = STRIDE) -> DataFrame:
    """``key, u, v, w, seen, n``: each token after the first with the one or two before it, counted in its document.

    ``u`` is null for a document's second token. ``seen`` is how many of the tokens before it (2 at most) lie in its window; a token is scored in the first window that holds it.
    """
    def of(t: Column) -> Column:
        places = F.filter(F.sequence(F.lit(1), F.size(t)), lambda i: i < F.size(t))
        seen = lambda i: F.least(i - window_start(i, max_length, stride), F.lit(2)).cast("int")
        return F.transform(places, lambda i: F.struct(F.when(i > 1, F.get(t, i - 2)).alias("u"), F.get(t, i - 1).alias("v"), F.get(t, i).alias("w"), seen(i).alias("seen")))

    # numbers of few distinct values are small files, their grams are not: each reader cuts them up again
    ids = stored(over_cores(df).select(key, F.transform(tokens, lambda x: F.xxhash64(x)).alias("_t")), "token-ids")
    long = ids.select(key, F.explode(counted(bind(F.col("_t"), of))).alias("_c"))
    return long.select(key, "_c.term.*", "_c.n")


def _level(counts: DataFrame, context: list[str], discount: float) -> tuple[DataFrame, DataFrame]:
    """From ``context.., w, c``: the share of each gram that its discounted count gives, and the back-off weight of each context."""
    own = counts.groupBy(*context).agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("types"))
    backs = own.select(*context, "total", (discount * F.col("types") / F.col("total")).alias("back"))
    shares = counts.join(backs, context).select(*context, "w", (F.greatest(F.col("c") - discount, F.lit(0.0)) / F.col("total")).alias("seen"))
    return shares, backs.select(*context, "back")


def vocabulary_of(*grams: DataFrame) -> DataFrame:
    """All tokens of the grams' documents that hold two or more, once each: ``w``."""
    out = None
    for g in grams:
        part = g.select("w").unionByName(g.select(F.col("v").alias("w")))
        out = part if out is None else out.unionByName(part)
    return stored(out.distinct(), "vocabulary")


def fit_backoff(grams: DataFrame, order: int = 2, vocabulary: DataFrame | None = None, discount: float = DISCOUNT) -> BackOff:
    """The model of these ``window_grams``, over their own vocabulary or a given one (which must hold it)."""
    if order not in (2, 3):
        raise ValueError(f"orders are 2 and 3, not {order}")
    vocabulary = vocabulary_of(grams) if vocabulary is None else vocabulary
    triples = stored(grams.groupBy("u", "v", "w").agg(F.sum("n").alias("c")), "triples")
    if order == 3:  # the beginning of a document is a left neighbour like any other
        pairs = triples.groupBy("v", "w").agg(F.count(F.lit(1)).alias("c"))
    else:
        pairs = triples.groupBy("v", "w").agg(F.sum("c").alias("c"))
    pairs = stored(pairs, "pairs")
    before = pairs.groupBy("w").agg(F.count(F.lit(1)).alias("c"))
    total, types = before.agg(F.sum("c"), F.count(F.lit(1))).head()
    size = vocabulary.count() + 1
    even = discount * (types or 0) / total / size if total else 1.0 / size
    share = F.coalesce(F.greatest(F.col("c") - discount, F.lit(0.0)) / F.lit(float(total or 1)), F.lit(0.0))
    words = stored(vocabulary.join(before, "w", "left").select("w", (share + even).alias("p1")), "words")
    shares, backs = _level(pairs, ["v"], discount)
    model = BackOff(order, words, even, stored(shares, "shares"), stored(backs, "backs"))
    if order == 3:
        shares, backs = _level(triples.filter("u is not null"), ["u", "v"], discount)
        model.triples, model.triple_backs = stored(shares, "shares"), stored(backs, "backs")
    return model


def pair_probabilities(pairs: DataFrame, model: BackOff, name: str = "p") -> DataFrame:
    """Adds the probability of ``w`` after ``v``."""
    joined = pairs.join(model.pairs, ["v", "w"], "left").join(model.backs, "v", "left").join(model.words, "w", "left")
    p = F.coalesce("seen", F.lit(0.0)) + F.coalesce("back", F.lit(1.0)) * F.coalesce("p1", F.lit(model.unknown))
    return joined.select(*pairs.columns, p.alias(name))


def triple_probabilities(triples: DataFrame, model: BackOff, name: str = "p") -> DataFrame:
    """Adds the probability of ``w`` after ``u, v``."""
    lower = stored(pair_probabilities(triples.select("v", "w").distinct(), model, "_lower"), "lower")
    joined = triples.join(model.triples, ["u", "v", "w"], "left").join(model.triple_backs, ["u", "v"], "left").join(lower, ["v", "w"])
    return joined.select(*triples.columns, (F.coalesce("seen", F.lit(0.0)) + F.coalesce("back", F.lit(1.0)) * F.col("_lower")).alias(name))


def perplexities(grams: DataFrame, model: BackOff, key: str) -> DataFrame:
    """``key, tokens, nll, perplexity``: scored tokens, their mean negative log-probability and its exponential, weighted by tokens over all windows.

    Tokens at the beginning of a window are not scored; with a context of one token in the window the probability is that after it alone. Only documents with scored tokens have a row.
    """
    log = lambda p: F.log(F.col(p))
    wide = (F.col("seen") == 2) & (F.lit(model.order) == 3)
    one, two = grams.filter((F.col("seen") > 0) & ~wide), grams.filter(wide)
    parts = one.join(stored(pair_probabilities(one.select("v", "w").distinct(), model), "probabilities"), ["v", "w"]).select(key, "n", log("p").alias("lp"))
    if model.order == 3:
        p = stored(triple_probabilities(two.select("u", "v", "w").distinct(), model), "probabilities")
        parts = parts.unionByName(two.join(p, ["u", "v", "w"]).select(key, "n", log("p").alias("lp")))
    nll = -F.sum(F.col("lp") * F.col("n")) / F.sum("n")
    return parts.groupBy(key).agg(F.sum("n").alias("tokens"), nll.alias("nll")).withColumn("perplexity", sane_perplexity(F.exp("nll")))


def kn_perplexity(df: DataFrame, key: str, tokens: Column, order: int = 3, max_length: int = MAX_LENGTH, stride: int = STRIDE) -> DataFrame:
    """``key, tokens, perplexity`` of every row under the model of all rows; 0 and 1 for rows without a scored token."""
    found = scored(df, key, tokens, order, max_length, stride, DISCOUNT).select(key, "tokens", sane_perplexity(F.exp("nll")).alias("perplexity"))
    return df.select(key).join(found, key, "left").select(key, F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("perplexity", F.lit(1.0)).alias("perplexity"))


def own_ratio(df: DataFrame, key: str, tokens: Column, model: Column, max_length: int = MAX_LENGTH, stride: int = STRIDE) -> DataFrame:
    """``perplexity_ratio`` of every row where the rows themselves make the models: the observer those where ``model`` is 0, the performer those where it is 1."""
    found = scored(df, key, tokens, 2, max_length, stride, DISCOUNT, model)
    return found.select(key, "tokens", "nll", F.col("ce").alias("cross_entropy"), F.try_divide("nll", "ce").alias("ratio"))


def own_entropies(df: DataFrame, key: str, tokens: Column, max_length: int = MAX_LENGTH, stride: int = STRIDE) -> DataFrame:
    """``predicted_entropies`` of every row under the pairs of all rows."""
    return scored(df, key, tokens, 2, max_length, stride, DISCOUNT).select(key, "tokens", F.col("ce").alias("entropy"))


def _xlogy(x: Column, y: Column) -> Column:
    return F.when(x == 0, F.lit(0.0)).otherwise(x * F.log(y))


def cross_entropies(contexts: DataFrame, observer: BackOff, performer: BackOff) -> DataFrame:
    """``v, ce``: for each of ``contexts(v)`` the mean of the performer's negative log-probability of the next word, as the observer expects it.

    Both models are pairs over one vocabulary. The entropy of a model is its cross-entropy with itself.
    """
    both = observer.words.select("w", F.col("p1").alias("a1")).join(performer.words.select("w", F.col("p1").alias("b1")), "w")
    both = stored(both, "words")
    all_a, all_x = both.agg(F.sum("a1"), F.sum(_xlogy(F.col("a1"), F.col("b1")))).head()
    # the place of unknown words
    all_a, all_x = (all_a or 0.0) + observer.unknown, (all_x or 0.0) + observer.unknown * float(_log(performer.unknown))
    one = observer.pairs.select("v", "w", F.col("seen").alias("a"), F.lit(0.0).alias("b"))
    seen = one.unionByName(performer.pairs.select("v", "w", F.lit(0.0).alias("a"), F.col("seen").alias("b"))).groupBy("v", "w").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    backs = observer.backs.select("v", F.col("back").alias("ka")).join(performer.backs.select("v", F.col("back").alias("kb")), "v", "full")
    backs = stored(backs.select("v", F.coalesce("ka", F.lit(1.0)).alias("ka"), F.coalesce("kb", F.lit(1.0)).alias("kb")), "backs")
    known = seen.join(backs, "v").join(both, "w")
    pa, pb = F.col("a") + F.col("ka") * F.col("a1"), F.col("b") + F.col("kb") * F.col("b1")
    sums = known.groupBy("v").agg(F.sum(_xlogy(pa, pb)).alias("own"), F.sum("a1").alias("a1"), F.sum(_xlogy(F.col("a1"), F.col("b1"))).alias("x1"))
    rest = F.col("ka") * (F.log("kb") * (all_a - F.coalesce("a1", F.lit(0.0))) + (all_x - F.coalesce("x1", F.lit(0.0))))
    found = backs.join(sums, "v", "left").select("v", (-(F.coalesce("own", F.lit(0.0)) + rest)).alias("ce"))
    # a context that neither model knows has the words' own distribution
    return contexts.join(found, "v", "left").select("v", F.coalesce("ce", F.lit(-all_x)).alias("ce"))


def _log(x: float) -> float:
    import math

    return math.log(x)


def perplexity_ratio(grams: DataFrame, observer: BackOff, performer: BackOff, key: str) -> DataFrame:
    """``key, tokens, nll, cross_entropy, ratio``: the performer's mean negative log-probability of the tokens, by the mean cross-entropy of what observer and performer expect at their places."""
    own = grams.filter("seen > 0")
    ce = stored(cross_entropies(own.select("v").distinct(), observer, performer), "cross-entropies")
    expected = own.groupBy(key, "v").agg(F.sum("n").alias("n")).join(ce, "v").groupBy(key).agg((F.sum(F.col("ce") * F.col("n")) / F.sum("n")).alias("cross_entropy"))
    found = perplexities(own.withColumn("seen", F.lit(1)), performer, key).select(key, "tokens", "nll")
    return found.join(expected, key).withColumn("ratio", F.try_divide("nll", "cross_entropy"))


def predicted_entropies(grams: DataFrame, model: BackOff, key: str) -> DataFrame:
    """``key, tokens, entropy``: the mean entropy, in nats, of the distribution that the model predicts at each scored place."""
    own = grams.filter("seen > 0").groupBy(key, "v").agg(F.sum("n").alias("n"))
    e = stored(cross_entropies(own.select("v").distinct(), model, model), "entropies")
    return own.join(e, "v").groupBy(key).agg(F.sum("n").alias("tokens"), (F.sum(F.col("ce") * F.col("n")) / F.sum("n")).alias("entropy"))
