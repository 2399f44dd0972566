"""Long-form TF-IDF, vocabularies, an n-gram language model and detector features."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..functions import bind
from ..functions.numbers import sane_perplexity
from ..functions.text import normalize_space, sentences
from ..session import stored
from .cutting import REMEMBERED, WORDS, CharTerms, WordTerms, pieces, tallies
from .ranges import numbered

#: Word tokens: runs of two or more word characters; the second finds the same in texts of one byte a character, and faster.
TOKEN, PLAIN_TOKEN = r"(?U)(\w\w+)", r"([A-Za-z0-9_]{2,})"


def _accents() -> tuple[str, str]:
    """Characters of the basic plane and their compatibility forms without combining marks, matched by place, and last the marks themselves, which have none.

    Characters whose form has several others (ligatures, fractions, Hangul syllables) are not among them.
    """
    pairs, marks = [], []
    for c in map(chr, range(0x80, 0x10000)):
        if unicodedata.combining(c):
            marks.append(c)
        elif (form := unicodedata.normalize("NFKD", c)) != c:
            plain = [x for x in form if not unicodedata.combining(x)]
            if len(plain) == 1:
                pairs.append((c, plain[0]))
            elif not plain:
                marks.append(c)
    return "".join(c for c, _ in pairs) + "".join(marks), "".join(p for _, p in pairs)


ACCENTS = _accents()


def fold(c: Column) -> Column:
    """Lower case without accents, in every script."""
    return bind(F.lower(F.coalesce(c, F.lit(""))), lambda t: F.when(_one_byte(t), t).otherwise(F.translate(t, *ACCENTS)))


def _one_byte(c: Column) -> Column:
    """Whether every character of a text takes one byte; such texts have no accents."""
    return F.octet_length(c) == F.length(c)


def word_tokens(c: Column) -> Column:
    return bind(c, lambda t: F.when(_one_byte(t), F.regexp_extract_all(t, F.lit(PLAIN_TOKEN), F.lit(1))).otherwise(F.regexp_extract_all(t, F.lit(TOKEN), F.lit(1))))


def ngrams(tokens: Column, low: int, high: int) -> Column:
    """All n-grams of an array, joined by blanks, for n from low to high."""

    def of(t: Column, n: int) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(t)), lambda i: i + n <= F.size(t))
        return F.transform(starts, lambda i: F.array_join(F.slice(t, i + 1, F.lit(n)), " "))

    return bind(tokens, lambda t: F.concat(*[of(t, n) for n in range(low, high + 1)]))


def char_ngrams(c: Column, low: int, high: int) -> Column:
    """n-grams inside words that are padded by a blank on either side; a word no longer than n gives itself once and no longer ones."""
    padded = F.transform(F.filter(F.split(normalize_space(c), " "), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def of(w: Column, n: int) -> Column:
        size = F.length(w)
        windows = F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substr(w, i, F.lit(n)))
        whole_once = (size <= n) & (F.lit(True) if n == low else size > n - 1)
        return F.when(size > n, windows).when(whole_once, F.array(w)).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(padded, lambda w: F.concat(*[of(w, n) for n in range(low, high + 1)])))


def counted(terms: Column) -> Column:
    """``struct(term, n)`` for each distinct item of an array without nulls: counted in the row, so that nothing is shuffled or hashed for it."""

    def ends(t: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(t)), lambda i: (i < F.size(t)) & ((i + 1 == F.size(t)) | (F.get(t, i) != F.get(t, i + 1))))

    def runs(t: Column) -> Column:
        return bind(ends(t), lambda e: F.transform(e, lambda at, k: F.struct(F.get(t, at).alias("term"), (at - F.when(k > 0, F.get(e, k - 1)).otherwise(F.lit(-1))).cast("long").alias("n"))))

    return bind(F.sort_array(terms), runs)


def over_cores(df: DataFrame) -> DataFrame:
    """``df`` itself, or dealt out anew where it has fewer partitions than there are cores: small files lie in one, and rows stay where they are after it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def term_lists(df: DataFrame, key: str, terms: Column, apart: bool = False) -> DataFrame:
    """``key, terms``: one row a key with all its terms, on request with a null after those of each of several rows. Rows whose key no other row has stay where they are; only the others are shuffled."""
    rows = over_cores(df).select(F.col(key), terms.alias("terms"))
    repeated = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col(key).alias("_key"))
    if repeated.isEmpty():
        return rows
    same = F.col(key).eqNullSafe(F.col("_key"))
    own = F.concat("terms", F.array(F.lit(None).cast("string"))) if apart else F.col("terms")
    several = rows.join(repeated, same, "left_semi").groupBy(key).agg(F.flatten(F.collect_list(own)).alias("terms"))
    return rows.join(repeated, same, "left_anti").unionByName(several)


def list_counts(lists: DataFrame, key: str) -> DataFrame:
    """``key, term, n`` of ``term_lists``."""
    # the outer form, as a plain one makes Spark count twice: once to see whether there is anything
    return lists.select(key, F.explode_outer(counted(F.col("terms"))).alias("_c")).filter("_c is not null").select(key, "_c.term", "_c.n")


def term_counts(df: DataFrame, key: str, terms: Column) -> DataFrame:
    return list_counts(term_lists(df, key, terms), key)


def char_term_counts(df: DataFrame, key: str, text: Column, low: int, high: int) -> DataFrame:
    """``key, term, n`` of character n-grams inside words."""
    return term_counts(df, key, char_ngrams(text, low, high))


def vocabulary(counts: DataFrame, least_df: int, most: int) -> DataFrame:
    """``term, df, total`` of terms in ``least_df`` documents or more, the ``most`` most frequent; ties by term."""
    return most_frequent(counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("total")), least_df, most)


def most_frequent(totals: DataFrame, least_df: int, most: int) -> DataFrame:
    """``vocabulary`` from ``term, df, total``."""
    v = totals.filter(F.col("df") >= least_df)
    return v.orderBy(F.desc("total"), "term").limit(most)


WEIGHTS = ArrayType(StructType([StructField("term", StringType()), StructField("weight", DoubleType())]))


#: Most terms that a task weighs at once, unless one row has more: a batch of rows may hold many millions.
PIECE = 500_000


def _idf(known: pa.Table, documents: int) -> tuple[pa.Array, np.ndarray]:
    """The terms of ``known(term, df)`` and their smoothed inverse document frequencies."""
    return pa.array(known["term"].to_pylist(), pa.string()), np.log((1 + documents) / (1 + known["df"].to_numpy())) + 1


def _scaled(row: np.ndarray, at: np.ndarray, n: np.ndarray, idf: np.ndarray, rows: int) -> np.ndarray:
    """The TF-IDF weights of a row's terms, ``n`` of each; unit length per row."""
    w = (1 + np.log(n)) * idf[at]
    return w / np.sqrt(np.bincount(row, w * w, rows))[row]


def _weighted(lists: pa.ListArray, terms: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, number among ``terms`` and TF-IDF weight of each known term of each list, by row and number."""
    rows, n_terms = len(lists), max(len(terms), 1)
    row = np.repeat(np.arange(rows), np.diff(lists.offsets.to_numpy()))
    at = pc.index_in(lists.flatten(), value_set=terms)
    hit = at.is_valid().to_numpy(zero_copy_only=False)
    # a row's terms side by side, counted
    code, n = np.unique(row[hit] * n_terms + at.drop_null().to_numpy(), return_counts=True)
    row, at = code // n_terms, code % n_terms
    return row, at, _scaled(row, at, n, idf, rows)


def _weights(keys: pa.Array, key: str, terms: pa.Array, row: np.ndarray, at: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(keys)))])
    out = pa.StructArray.from_arrays([terms.take(pa.array(at)), pa.array(w)], ["term", "weight"])
    return pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), out)], names=[key, "weights"])


def tfidf_lists(lists: DataFrame, vocab: DataFrame, documents: int, key: str) -> DataFrame:
    """``key, weights`` from ``term_lists``: damped counts by smoothed inverse document frequency, unit length per document; ``weights`` in the order of the vocabulary.

    ``vocab(term, df)`` is bounded by its ``most``: the driver gets it and every task. A document is weighted in its own row, so that no term is shuffled.
    """
    known = vocab.select("term", "df").toArrow().combine_chunks()
    terms, idf = _idf(known, documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole, ["terms"], PIECE)):
            yield _weights(batch[key], key, terms, *_weighted(batch["terms"], terms, idf))

    return lists.select(key, "terms").mapInArrow(run, StructType([lists.schema[key], StructField("weights", WEIGHTS)]))


def tfidf(lists: DataFrame, vocab: DataFrame, documents: int, key: str) -> DataFrame:
    """``key, term, weight`` of ``tfidf_lists``."""
    return tfidf_lists(lists, vocab, documents, key).select(key, F.explode("weights").alias("_w")).select(key, "_w.term", "_w.weight")


def char_words(text: Column) -> Column:
    """The words whose character n-grams count; an empty one has none."""
    return F.split(normalize_space(text), " ")


#: The two blocks of the stacked features: the words of a text, what cuts them into terms, least number of documents, most terms.
BLOCKS = {
    "word": (lambda text: word_tokens(fold(F.col(text))), WordTerms, 2, 20_000),
    "char": (lambda text: char_words(fold(F.col(text))), lambda known=None: CharTerms(3, 5, known), 2, 15_000),
}
STACKED = sum(most for *_, most in BLOCKS.values())


def word_lists(df: DataFrame, key: str, words: Column) -> DataFrame:
    """``term_lists`` of words, with a null between those of rows that share a key: they are no neighbours."""
    return term_lists(df, key, words, apart=True)


def term_totals(lists: DataFrame, make: Callable[[], CharTerms | WordTerms]) -> DataFrame:
    """``term, df, total`` of the terms that are cut from ``word_lists``: summed in the task, so that a task gives a term once or a few times."""
    sums = lists.select("terms").mapInArrow(lambda batches: tallies(batches, "terms", make, WORDS, REMEMBERED), "term string, df long, total long")
    return sums.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def char_term_totals(df: DataFrame, key: str, text: Column, low: int, high: int) -> DataFrame:
    """``term, df, total`` of character n-grams inside words."""
    return term_totals(word_lists(df, key, char_words(text)), lambda: CharTerms(low, high))


def stacked_terms(df: DataFrame, key: str, text: str) -> dict[str, DataFrame]:
    """``word_lists`` of both blocks. Nothing is written: each reader cuts the texts again."""
    return {name: word_lists(df, key, words(text)) for name, (words, *_) in BLOCKS.items()}


def stacked_vocabulary(lists: dict[str, DataFrame], key: str) -> DataFrame:
    """``block, term, df, place`` from ``stacked_terms``: the terms of both blocks, numbered from 0 through both; bounded by the blocks' sizes."""
    out, start = None, 0
    for name, (_, make, least, most) in BLOCKS.items():
        v = most_frequent(term_totals(lists[name], make), least, most)
        # a window over at most ``most`` terms
        v = v.select(F.lit(name).alias("block"), "term", "df", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("term")) - 1 + start).alias("place"))
        out, start = v if out is None else out.unionByName(v), start + most
    return stored(out, "vocabulary")


def stacked_lists(lists: dict[str, DataFrame], vocab: DataFrame, documents: int, key: str) -> DataFrame:
    """``key, block, weights``: TF-IDF of both blocks, each of length 1 in every document; a row a block."""
    out = None
    for name, (_, make, *_) in BLOCKS.items():
        terms, idf = _idf(vocab.filter(F.col("block") == name).select("term", "df").toArrow().combine_chunks(), documents)

        def run(batches: Iterator[pa.RecordBatch], make=make, terms=terms, idf=idf) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            cutter = make(terms)
            for batch in (piece for whole in batches for piece in pieces(whole, ["terms"], WORDS)):
                cutter = cutter if cutter.size() < REMEMBERED else make(terms)
                row, at, n = cutter.counts(batch["terms"])
                yield _weights(batch[key], key, terms, row, at, _scaled(row, at, n, idf, batch.num_rows))

        w = lists[name].select(key, "terms").mapInArrow(run, StructType([lists[name].schema[key], StructField("weights", WEIGHTS)])).withColumn("block", F.lit(name))
        out = w if out is None else out.unionByName(w)
    return out.select(key, "block", "weights")


def stacked_tfidf(lists: dict[str, DataFrame], vocab: DataFrame, documents: int, key: str) -> DataFrame:
    """``key, block, place, term, weight`` of ``stacked_lists``.

    The vocabulary and number of documents may be those of other rows, which the features are then fitted to.
    """
    long = stacked_lists(lists, vocab, documents, key).select(key, "block", F.explode("weights").alias("_w")).select(key, "block", "_w.term", "_w.weight")
    # the vocabulary is bounded by the blocks' sizes
    return long.join(F.broadcast(vocab.select("block", "term", "place")), ["block", "term"]).select(key, "block", "place", "term", "weight")


def stacked_rows(df: DataFrame, text: str, vocab: DataFrame, documents: int) -> DataFrame:
    """``df`` with ``places``, ascending, and their ``weights``: what ``stacked_tfidf`` gives for each row, weighted in the row, so that no term or weight is shuffled."""
    known = vocab.orderBy("place").toArrow()
    fitted = {name: known.filter(pc.equal(known["block"], name)) for name in BLOCKS}
    fitted = {name: (*_idf(v, documents), v["place"].to_numpy()) for name, v in fitted.items()}
    names, lists = df.columns, {name: f"_terms_{name}" for name in BLOCKS}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutters: dict = {}
        for batch in (piece for whole in batches for piece in pieces(whole, [*lists.values()], min(PIECE, 2 * WORDS))):
            row, place, w = [], [], []
            for name, (terms, idf, places) in fitted.items():
                if name not in cutters or cutters[name].size() > REMEMBERED:
                    cutters[name] = BLOCKS[name][1](terms)
                r, at, n = cutters[name].counts(batch[lists[name]])
                row, place, w = [*row, r], [*place, places[at]], [*w, _scaled(r, at, n, idf, batch.num_rows)]
            row, place, w = np.concatenate(row), np.concatenate(place), np.concatenate(w)
            order = np.lexsort((place, row))
            offsets = pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=batch.num_rows))), pa.int32())
            out = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (place[order].astype(np.int32), w[order])]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in names], *out], names=[*names, "places", "weights"])

    cut = over_cores(df).select("*", *[words(text).alias(lists[name]) for name, (words, *_) in BLOCKS.items()])
    return cut.mapInArrow(run, StructType([*df.schema.fields, StructField("places", ArrayType(IntegerType())), StructField("weights", ArrayType(DoubleType()))]))


# ---- language model


def unigram_model(df: DataFrame, tokens: Column, k: float = 1.0) -> DataFrame:
    """``token, n, logp``: add-k smoothed; written once, so that its readers do not count again and their joins can be split."""
    own = df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    totals = own.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("types"))
    scored = own.join(F.broadcast(totals))  # one row
    return stored(scored.select("token", "n", F.log((F.col("n") + k) / (F.col("total") + k * F.col("types"))).alias("logp")), "tokens")


def with_rank(model: DataFrame) -> DataFrame:
    """Adds ``rank``, from 1 by frequency, then token."""
    return numbered(model, [], [F.desc("n"), F.col("token")], "rank")


def model_means(counts: DataFrame, model: DataFrame, key: list[str], values: dict[str, Column]) -> DataFrame:
    """``key, tokens`` and the means of ``values`` over the tokens of each key, from ``counts(key.., term, n)``; frequent tokens are one row a key and not one an occurrence."""
    joined = counts.withColumnRenamed("term", "token").withColumnRenamed("n", "_n").join(model, "token")
    return joined.groupBy(*key).agg(F.sum("_n").alias("tokens"), *[(F.sum(c * F.col("_n")) / F.sum("_n")).alias(name) for name, c in values.items()])


def entropies(lists: DataFrame, key: str) -> DataFrame:
    """``key, entropy`` of each row's terms from ``term_lists``; rows without terms are left out."""

    def of(t: Column) -> Column:
        p = lambda x: x["n"] / F.size(t)
        return F.when(F.size(t) > 0, F.array(-F.aggregate(counted(t), F.lit(0.0), lambda a, x: a + p(x) * F.log(p(x)))))

    # a filter on the terms would find them twice; one after this form cannot move before it
    return lists.select(key, F.explode_outer(bind(F.col("terms"), of)).alias("entropy")).filter("entropy is not null")


#: Tokens that every task holds with their log-probabilities.
FREQUENT = 200_000


def part_sums(df: DataFrame, key: str, tokens: Column, model: DataFrame, parts: int) -> DataFrame:
    """``key, k, lp, n``: the sum of log-probabilities under ``model(token, n, logp)`` and the number of a key's tokens whose place, from 1, leaves ``k`` when divided by ``parts``; tokens that the model lacks do not count.

    The ``FREQUENT`` most frequent tokens are summed in their document's row; only others are shuffled.
    """
    known = model.orderBy(F.desc("n"), "token").limit(FREQUENT).select("token", "logp").toArrow()
    names, logp = pa.array(known["token"].to_pylist(), pa.string()), np.array(known["logp"].to_pylist(), np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rows = np.diff(batch["t"].offsets.to_numpy()), batch.num_rows
            row = np.repeat(np.arange(rows), size)
            k = (np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + 1) % parts
            items = batch["t"].flatten()
            at = pc.index_in(items, value_set=names)
            hit = at.is_valid().to_numpy(zero_copy_only=False)
            to = (row * parts + k)[hit]
            lp, n = np.bincount(to, logp[at.drop_null().to_numpy()], rows * parts).astype(np.float64), np.bincount(to, minlength=rows * parts)
            every = pa.array(np.arange(rows + 1) * parts, pa.int32())
            rest = pa.StructArray.from_arrays([items.filter(pa.array(~hit)), pa.array(k[~hit].astype(np.int32))], ["token", "k"])
            ends = pa.array(np.append(0, np.cumsum(np.bincount(row[~hit], minlength=rows))), pa.int32())
            yield pa.RecordBatch.from_arrays([batch[key], pa.ListArray.from_arrays(every, pa.array(lp)), pa.ListArray.from_arrays(every, pa.array(n)), pa.ListArray.from_arrays(ends, rest)], names=[key, "lp", "n", "rest"])

    rest = StructType([StructField("token", StringType()), StructField("k", IntegerType())])
    schema = StructType([df.schema[key], StructField("lp", ArrayType(DoubleType())), StructField("n", ArrayType(LongType())), StructField("rest", ArrayType(rest))])
    own = stored(over_cores(df).select(key, tokens.alias("t")).mapInArrow(run, schema), "part-sums")
    sums = own.select(key, F.posexplode(F.arrays_zip("lp", "n")).alias("k", "s")).select(key, "k", "s.lp", "s.n").filter("n > 0")
    rare = own.select(key, F.explode("rest").alias("r")).select(key, "r.k", "r.token").join(model.select("token", "logp"), "token")
    both = sums.unionByName(rare.select(key, "k", F.col("logp").alias("lp"), F.lit(1).cast("long").alias("n")))
    return both.groupBy(key, "k").agg(F.sum("lp").alias("lp"), F.sum("n").alias("n"))


def pairs_of(tokens: Column) -> Column:
    """``struct(a, b)`` of each token and the one after it."""
    return bind(tokens, lambda t: F.transform(F.filter(F.sequence(F.lit(1), F.size(t)), lambda i: i < F.size(t)), lambda i: F.struct(F.get(t, i - 1).alias("a"), F.get(t, i).alias("b"))))


def bigram_scores(df: DataFrame, key: str, tokens: Column, k: float = 1.0) -> DataFrame:
    """``key, tokens, ll``: mean log-probability of each token after the one before, add-k smoothed; the first token is not scored.

    Tokens are told apart by 64 bits. Pairs are counted in their document's row. The logarithm is that of a pair's count less that of its first token's: the rows meet
    the pairs' counts by one number, and those of first tokens are few. Only token numbers are written.
    """
    ids = stored(over_cores(df).select(key, F.transform(tokens, lambda x: F.xxhash64(x)).alias("t")), "token-ids")
    long = ids.select(key, F.explode(counted(pairs_of(F.col("t")))).alias("_c")).select(key, F.col("_c.term.a").alias("a"), F.col("_c.term.b").alias("b"), F.col("_c.n").alias("m"))
    pair = F.xxhash64("a", "b").alias("pair")
    both = long.groupBy(pair).agg(F.sum("m").alias("n"))
    heads = ids.select(key, F.explode(counted(F.slice("t", F.lit(1), F.greatest(F.size("t") - 1, F.lit(0))))).alias("_c")).select(key, F.col("_c.term").alias("a"), F.col("_c.n").alias("m"))
    first = heads.groupBy("a").agg(F.sum("m").alias("na"))
    types = ids.select(F.explode(F.array_distinct(F.slice("t", F.lit(2), F.greatest(F.size("t") - 1, F.lit(0))))).alias("b")).distinct().count()
    up = long.select(key, pair, "m").join(both, "pair").select(key, "m", (F.col("m") * F.log(F.col("n") + k)).alias("lp"))
    down = heads.join(first, "a").select(key, F.lit(0).cast("long").alias("m"), (-F.col("m") * F.log(F.col("na") + k * types)).alias("lp"))
    return up.unionByName(down).groupBy(key).agg(F.sum("m").alias("tokens"), (F.sum("lp") / F.sum("m")).alias("ll"))


def sentence_perplexities(df: DataFrame, key: str, text: str, model: DataFrame, scored_only: bool = False) -> DataFrame:
    """Document and sentence perplexities under a token model: the detector's features.

    ``doc_perplexity``, mean and population deviation over sentences, and their ratio, for every document. The perplexity
    of a sentence or document without tokens is 1; a document without sentences counts as one sentence. With ``scored_only``
    sentences without tokens are left out, and so are documents that have no others.
    """
    parts = over_cores(df).select(key, F.posexplode_outer(sentences(F.col(text))).alias("s", "sentence"))
    # a sentence without tokens, or a document without sentences, keeps a row that adds nothing
    long = parts.select(key, "s", F.explode_outer(counted(word_tokens(fold(F.col("sentence"))))).alias("_c")).select(key, "s", F.col("_c.term").alias("token"), "_c.n")
    long = long.join(model.select("token", "logp"), "token", "left")
    per = long.groupBy(key, "s").agg(F.coalesce(F.sum(F.col("logp") * F.col("n")), F.lit(0.0)).alias("lp"), F.sum(F.when(F.col("logp").isNull(), 0).otherwise(F.col("n"))).alias("n"))
    per = per.select(key, "s", "lp", "n", sane_perplexity(F.exp(-F.try_divide("lp", "n"))).alias("ppl"))
    if scored_only:
        per = per.filter("n > 0")
    mean, spread = F.avg("ppl"), F.stddev_pop("ppl")
    return per.groupBy(key).agg(
        sane_perplexity(F.exp(-F.try_divide(F.sum("lp"), F.sum("n")))).alias("doc_perplexity"),
        mean.alias("sentence_perplexity_mean"),
        spread.alias("sentence_perplexity_std"),
        F.when((F.count(F.lit(1)) < 2) | (mean <= 0), 0.0).otherwise(spread / mean).alias("burstiness"),
    )


def perturbation_statistics(df: DataFrame, key: str, ll: str) -> DataFrame:
    """Mean and population deviation over a sample's perturbations; the deviation is 1 for a single one."""
    return df.groupBy(key).agg(F.avg(ll).alias("mean_ll"), F.when(F.count(ll) > 1, F.stddev_pop(ll)).otherwise(1.0).alias("std_ll"))
