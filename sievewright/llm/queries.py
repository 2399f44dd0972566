"""The registered query of each operator: thin applications to whole tables with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import chat, codes, embeddings, jaccard, media, mixing, packing, quality, secrets, suffixes, trie, url_filters, warc


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public vocabulary files lie: ``SIEVEWRIGHT_TOKENIZERS``, or the installed package's own folder."""
    if folder := os.environ.get("SIEVEWRIGHT_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP1_SQL = """
WITH d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents
), n AS (
  SELECT doc_id, b, octet_length(b) AS n FROM d
), w AS (
  SELECT doc_id, p, md5(b[p + 1 : p + 200]) AS h FROM (SELECT doc_id, b, unnest(range(0, n - 199)) AS p FROM n WHERE n >= 200)
), r AS (
  SELECT h FROM w GROUP BY h HAVING count(*) > 1
), x AS (
  SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 200 THEN 0 ELSE 1 END AS fresh FROM w JOIN r USING (h)
), g AS (
  SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM x
), i AS (
  SELECT doc_id, g, min(p) AS a, max(p) + 200 AS z FROM g GROUP BY doc_id, g
), k AS (
  SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS s, a AS e FROM i UNION ALL SELECT doc_id, max(z), NULL FROM i GROUP BY doc_id
), kept AS (
  SELECT k.doc_id, string_agg(CASE WHEN s < coalesce(e, n) THEN hex(b[s + 1 : coalesce(e, n)]) ELSE '' END, '' ORDER BY s) AS h FROM k JOIN n USING (doc_id) GROUP BY k.doc_id
), c AS (
  SELECT doc_id, sum(z - a) AS removed, count(*) AS spans FROM i GROUP BY doc_id
)
SELECT n.doc_id, n.n::BIGINT AS n_bytes, coalesce(c.removed, 0)::BIGINT AS n_removed, coalesce(c.spans, 0)::BIGINT AS n_spans,
       CASE WHEN c.doc_id IS NULL THEN sha256(n.b) ELSE sha256(unhex(kept.h)) END AS kept_sha256
FROM n LEFT JOIN c USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_sets(table(spark, sf_dir, "documents"), words=3, percent=90)


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w
), n AS (
  SELECT doc_id, len(s) AS n FROM s
), t AS (
  SELECT doc_id, hash(unnest(s)) AS h, unnest(s) AS t FROM s
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM t a JOIN t b ON a.h = b.h AND a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_ >= 90 * (x.n + y.n - both_)
), either AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT a, b AS r FROM either UNION SELECT reach.a, either.b FROM reach JOIN either ON reach.r = either.a
), c AS (
  SELECT a, min(r) AS r FROM reach GROUP BY a
)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, least(n.doc_id, coalesce(c.r, n.doc_id)) AS component_id FROM n LEFT JOIN c ON c.a = n.doc_id
"""


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_archive(table(spark, sf_dir, "pages"))
    return warc.read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
), d AS (
  SELECT page_id, octet_length(body) AS n, sha1(body) AS digest, sha256(body) AS strong FROM p
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY digest, strong, n) AS top FROM d
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM m
"""


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing, root = media.write_media(table(spark, sf_dir, "documents"), "doc_id", "text")
    return media.read_media(listing, root).select(
        F.col("key").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"
    )


#: The conversation that the op9 contract adds: both turns say this.
PROBE = "\\### Assistant: </turn> ok"


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    messages = rows.unionByName(probe).withColumn("parts", chat.text_part(F.col("text")))
    done = chat.format_conversations(messages).select("*", chat.read_turns(F.col("formatted")).alias("read"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    spoken = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(F.encode(spoken, "UTF-8"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP9_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, length(text) + (length(text) - length(replace(text, '\', ''))) + (length(text) - length(replace(text, '#', '')))
            + (length(text) - length(replace(text, '<', ''))) AS escaped,
         length(role) + (length(role) - length(replace(role, '\', ''))) + (length(role) - length(replace(role, '#', '')))
            + (length(role) - length(replace(role, '<', ''))) + (length(role) - length(replace(role, ':', ''))) AS escaped_role
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(4 + escaped_role + 2 + escaped + 8) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.classify(docs, model).select("doc_id", "held_out", "score", "predicted")


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON len(a.e) = len(b.e) AND a.vec_id < b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9
), either AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT a, b AS r FROM either UNION SELECT reach.a, either.b FROM reach JOIN either ON reach.r = either.a
), c AS (
  SELECT a, min(r) AS r FROM reach GROUP BY a
), m AS (
  SELECT a, count(*) AS n FROM either GROUP BY a
)
SELECT v.vec_id, coalesce(m.n, 0)::BIGINT AS n_links, least(v.vec_id, coalesce(c.r, v.vec_id)) AS component_id, v.vec_id <= coalesce(c.r, v.vec_id) AS kept
FROM v LEFT JOIN c ON c.a = v.vec_id LEFT JOIN m ON m.a = v.vec_id
"""


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = secrets.train(secrets.labelled_samples(spark, docs))
    found = secrets.scan(docs, model)
    count = lambda kind: F.size(F.filter("found.base", lambda s: s["kind"] == secrets.KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(k) for k in ("assign", "access", "hex")],
        F.sha2(secrets.joined(F.col("found.base")), 256).alias("base_sha256"),
        secrets.joined(F.col("found.spans")).alias("spans"),
    )


#: Production parameters of the mix: the budget as a share of all tokens, epochs at most, weights of domains and languages.
MIX_SHARE, MIX_EPOCHS = 0.8, 2
DOMAIN_WEIGHTS = {"d0": 4, "d1": 3, "d2": 2, "d3": 1}
LANGUAGE_WEIGHTS = {"en": 4, "fr": 2, "de": 2, "es": 2}


def with_domain(docs: DataFrame) -> DataFrame:
    """Adds ``domain``, one of ``d0`` to ``d3`` by the number of the source; sources without a number are ``d0``."""
    number = F.nullif(F.regexp_extract(F.coalesce("source", F.lit("")), r"(\d{1,9})$", 1), F.lit(""))
    return docs.withColumn("domain", F.concat(F.lit("d"), F.coalesce(number.cast("int") % 4, F.lit(0)).cast("string")))


def mix_weights(spark: SparkSession) -> list[DataFrame | None]:
    values = lambda d: ", ".join(f"('{k}', {v}.0D)" for k, v in d.items())
    domains = spark.sql(f"SELECT * FROM VALUES {values(DOMAIN_WEIGHTS)} AS t(domain, weight)")
    languages = spark.sql(f"SELECT * FROM VALUES {values(LANGUAGE_WEIGHTS)} AS t(lang, weight)")
    return [domains, domains.select("domain").crossJoin(languages), None]  # 4 by 4 constants


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_domain(table(spark, sf_dir, "documents"))
    taken = mixing.mix(docs, ["domain", "lang", "source"], MIX_SHARE, mix_weights(spark), MIX_EPOCHS)
    return taken.select("doc_id", "domain", "lang", "source", "tokens", "epochs")


def _share_sql(name: str, source: str, parent: str, own: str) -> str:
    """CTEs that grant ``budget`` to the rows of ``source(parent, own, capacity, weight, budget)``."""
    keys, order = ", ".join(dict.fromkeys(f"{parent}, {own}".split(", "))), ", ".join(own.split(", "))
    w = f"PARTITION BY {parent} ORDER BY CASE WHEN weight > 0 THEN capacity / weight ELSE 'Infinity'::DOUBLE END, {order}"
    return f"""
{name}_a AS (
  SELECT *, budget - coalesce(sum(capacity) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS rest,
         sum(weight) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM {source}
), {name}_b AS (
  SELECT *, weight > 0 AND rest * weight >= capacity * weights AS filled FROM {name}_a
), {name}_c AS (
  SELECT *, max(CASE WHEN NOT filled AND weights > 0 THEN rest / weights END) OVER (PARTITION BY {parent}) AS factor,
         max(CASE WHEN filled THEN 0 ELSE 1 END) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS opened
  FROM {name}_b
), {name} AS (
  SELECT {keys}, CASE WHEN opened = 0 THEN capacity WHEN weight > 0 THEN least(capacity, greatest(0.0, coalesce(factor, 0.0)) * weight) ELSE 0.0 END AS granted
  FROM {name}_c
)"""


def _case_sql(column: str, weights: dict) -> str:
    return f"CASE {column} {' '.join(f"WHEN '{k}' THEN {v}.0" for k, v in weights.items())} ELSE 1.0 END"


OP10_SQL = f"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS l, coalesce(source, '') AS s, lang, source, coalesce(text, '') AS text,
         'd' || coalesce(CAST(try_cast(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) AS INTEGER) % 4 AS VARCHAR), '0') AS d,
         CAST(ceil(length(coalesce(text, '')) / 4.0) AS BIGINT) AS tokens, md5('42|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), leaves AS (
  SELECT d, l, s, CAST(sum(tokens) AS BIGINT) AS tokens FROM docs GROUP BY d, l, s
), top AS (
  SELECT 0 AS r, d, CAST(sum(tokens) * {MIX_EPOCHS} AS DOUBLE) AS capacity, {_case_sql("d", DOMAIN_WEIGHTS)}::DOUBLE AS weight FROM leaves GROUP BY d
), top2 AS (
  SELECT *, least(sum(capacity) OVER (), floor(sum(capacity) OVER () / {MIX_EPOCHS} * {MIX_SHARE}::DOUBLE)) AS budget FROM top
), {_share_sql("g1", "top2", "r", "d")}, mid AS (
  SELECT d, l, CAST(sum(tokens) * {MIX_EPOCHS} AS DOUBLE) AS capacity, {_case_sql("l", LANGUAGE_WEIGHTS)}::DOUBLE AS weight, any_value(granted) AS budget
  FROM leaves JOIN g1 USING (d) GROUP BY d, l
), {_share_sql("g2", "mid", "d", "d, l")}, low AS (
  SELECT d, l, s, CAST(sum(tokens) * {MIX_EPOCHS} AS DOUBLE) AS capacity, 1.0::DOUBLE AS weight, any_value(granted) AS budget
  FROM leaves JOIN g2 USING (d, l) GROUP BY d, l, s
), {_share_sql("g3", "low", "d, l", "d, l, s")}, plan AS (
  SELECT d, l, s, CASE WHEN tokens > 0 THEN CAST(floor(granted + 1e-6) AS BIGINT) // tokens ELSE 0 END AS whole,
         CASE WHEN tokens > 0 THEN CAST(floor(granted + 1e-6) AS BIGINT) % tokens ELSE 0 END AS rest
  FROM g3 JOIN leaves USING (d, l, s)
), placed AS (
  SELECT *, sum(tokens) OVER (PARTITION BY d, l, s ORDER BY h, doc_id, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM docs JOIN plan USING (d, l, s)
)
SELECT doc_id, d AS domain, lang, source, tokens, CAST(whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS epochs
FROM placed WHERE whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END > 0
"""


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    done = codes.with_total(coded, "label", "error", "label_error")
    return done.select("vec_id", "code", "error", "label_error", F.lit(codes.digest(books)).alias("codebooks_sha256"))


def _lloyd_sql(i: int) -> str:
    """CTEs of round ``i``: ``s{i}`` assigns to the codebooks ``b{i}``; ``b{i + 1}`` are those of the next one."""
    return f"""
d{i} AS (
  SELECT r, v.p, b.e, sum((v.x - b.x) * (v.x - b.x))::BIGINT AS d FROM c v JOIN b{i} b ON v.p = b.p AND v.j = b.j GROUP BY r, v.p, b.e
), s{i} AS (
  SELECT r, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM d{i} GROUP BY r, p
), t{i} AS (
  SELECT p, e, j, sum(x)::BIGINT AS x, count(*) AS n FROM c JOIN s{i} USING (r, p) GROUP BY p, e, j
), b{i + 1} AS (
  SELECT b.p, b.e, b.j, CASE WHEN t.n IS NULL THEN b.x ELSE (t.x - ((t.x % t.n) + t.n) % t.n) // t.n END AS x FROM b{i} b LEFT JOIN t{i} t USING (p, e, j)
)"""


OP11_SQL = f"""
WITH v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL
), k AS (
  SELECT vec_id, label, list_transform(e, lambda x: CAST(floor(x * 256) AS BIGINT)) AS e, len(e) // 16 AS m FROM v
  WHERE len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), n AS (
  SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, e) - 1 AS r FROM k
), c AS (
  SELECT r, (i - 1) // m AS p, (i - 1) % m AS j, e[i] AS x FROM (SELECT r, m, e, unnest(range(1, len(e) + 1)) AS i FROM n)
), b0 AS (
  SELECT p, r AS e, j, x FROM c WHERE r < 64
), {_lloyd_sql(0)}, {_lloyd_sql(1)}, {_lloyd_sql(2)}, o AS (
  SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM s2 GROUP BY r
), h AS (
  SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, j)) AS h FROM b2
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h.h AS codebooks_sha256 FROM n JOIN o USING (r), h
"""


#: Verdict, host and path of each rule.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = url_filters.fit(url_filters.labelled_urls(spark))
    judged = url_filters.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES, weights)
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


OP13_SQL = r"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL
), o AS (
  SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, left(text, 32), left(sha256(length(role)::VARCHAR || ':' || role || text), 32)) AS p FROM t
), k AS (
  SELECT DISTINCT c, c - c % 100 AS base FROM o
), f AS (
  SELECT c, base, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length(c::VARCHAR) + 1), lambda i: ascii((c::VARCHAR)[i])::UBIGINT)),
    lambda s, b: list_reduce(list_prepend(xor(s, b), list_transform(range(8), lambda z: 0::UBIGINT)), lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END)) AS crc FROM k
), h AS (
  SELECT c, base, xor(crc, 4294967295::UBIGINT) % 6 AS h FROM f
), r AS (
  SELECT h.c, 0 AS part, o.p, o.role, o.text FROM h JOIN o ON o.c = h.base AND o.p <= h.h
  UNION ALL SELECT h.c, 1, o.p, o.role, o.text FROM h JOIN o ON o.c = h.c AND o.p > h.h
), n AS (
  SELECT c, row_number() OVER w AS d, sha256(length(role)::VARCHAR || ':' || role || text) AS item, length(text) AS len FROM r WINDOW w AS (PARTITION BY c ORDER BY part, p)
), s AS (
  SELECT c, d, len, sha256(string_agg(item, '' ORDER BY d) OVER (PARTITION BY c ORDER BY d)) AS node FROM n
  UNION ALL SELECT c, 0, 0, 'root' FROM k
), u AS (
  SELECT *, lag(node) OVER (PARTITION BY c ORDER BY d) AS parent, lead(node) OVER (PARTITION BY c ORDER BY d) IS NULL AS last FROM s
), g AS (
  SELECT node, any_value(d) AS depth, any_value(parent) AS parent, min(c) AS conv_id, count(*) AS n_convs, any_value(len) AS len,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '')) AS ends_sha256 FROM u GROUP BY node
), m AS (
  SELECT parent AS node, count(*) AS n FROM g WHERE parent IS NOT NULL GROUP BY parent
), x AS (
  SELECT g.*, coalesce(m.n, 0) AS n_children, q.conv_id AS parent_conv_id FROM g LEFT JOIN m ON m.node = g.node LEFT JOIN g q ON q.node = g.parent
), a AS (
  SELECT DISTINCT v.node AS top, w.node FROM u v JOIN u w ON v.c = w.c AND v.d <= w.d
), b AS (
  SELECT a.top AS node, count(*) FILTER (x.n_children = 0) AS n_leaves, sum((x.n_convs - 1) * x.len) AS saved FROM a JOIN x ON x.node = a.node GROUP BY a.top
)
SELECT x.conv_id, x.depth::BIGINT AS depth, x.parent_conv_id, x.n_convs, x.n_children, b.n_leaves, b.saved::BIGINT AS saved_tokens, x.ends_sha256 FROM x JOIN b ON b.node = x.node
"""


QUERIES = {
    "op1_suffixes": op1_suffixes,
    "op2_jaccard": op2_jaccard,
    "op3_warc": op3_warc,
    "op4_quality": op4_quality,
    "op5_embeddings": op5_embeddings,
    "op6_secrets": op6_secrets,
    "op7_packing": op7_packing,
    "op8_media": op8_media,
    "op9_chat": op9_chat,
    "op10_mixing": op10_mixing,
    "op11_codes": op11_codes,
    "op12_url_filters": op12_url_filters,
    "op13_trie": op13_trie,
}

ORACLES = {
    "op1_suffixes": OP1_SQL,
    "op5_embeddings": OP5_SQL,
    "op2_jaccard": OP2_SQL,
    "op3_warc": OP3_SQL,
    "op9_chat": OP9_SQL,
    "op10_mixing": OP10_SQL,
    "op11_codes": OP11_SQL,
    "op13_trie": OP13_SQL,
}
