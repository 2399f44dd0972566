"""The pipeline against a brute-force version on the smallest table."""

import hashlib
import math
import re
from collections import defaultdict

import corpus_pipeline as P
from sievewright.llm import quality
from sievewright.llm.queries import DOMAIN_WEIGHTS, LANGUAGE_WEIGHTS

from . import test_packing
from .test_jaccard import brute as groups
from .test_mixing import fill
from .test_secrets import RULES

SF = "/root/testdata/sf0.001"


def redacted(text):
    spans = sorted((m.start(), m.end()) for rx, keep in RULES.values() for m in rx.finditer(text) if keep(m))
    out, at = "", 0
    for a, b in spans:
        if a >= at:
            out += text[at:a] + "[secret]"
        at = max(at, b)
    return out + text[at:]


def mixed(docs):
    tree = defaultdict(lambda: defaultdict(lambda: defaultdict(list)))
    tokens = {i: math.ceil(len(d["text"]) / 4) for i, d in docs.items()}
    for i, d in docs.items():
        tree[f"d{int(re.search(r'[0-9]+$', d['source'])[0]) % 4}"][d["lang"]][d["source"]].append(i)
    size = lambda node: sum(tokens[i] for i in node) if isinstance(node, list) else sum(map(size, node.values()))
    kept = set()
    for d, budget in fill(math.floor(size(tree) * P.MIX_SHARE), {k: (size(v), DOMAIN_WEIGHTS.get(k, 1)) for k, v in tree.items()}).items():
        for lang, part in fill(budget, {k: (size(v), LANGUAGE_WEIGHTS.get(k, 1)) for k, v in tree[d].items()}).items():
            for source, rest in fill(part, {k: (size(v), 1) for k, v in tree[d][lang].items()}).items():
                left = math.floor(rest + 1e-6)
                for i in sorted(tree[d][lang][source], key=lambda i: hashlib.md5(f"42|{i}".encode()).hexdigest()):
                    left -= tokens[i]
                    if left >= 0:
                        kept.add(i)
    return kept


def test_against_brute_force(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    docs = {r.doc_id: r.asDict() for r in table.collect()}
    model = quality.fit(table, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = [d["text"] for d in docs.values()]
    docs = {i: d for (i, d), score in zip(docs.items(), model.score(quality.features(texts), list(docs)), strict=True) if score >= 0.3}
    found = groups([(i, d["text"]) for i, d in docs.items()], 5, 80)
    docs = {i: d for i, d in docs.items() if found[i][1] == i}
    for d in docs.values():
        d["text"] = redacted(d["text"])
    kept = mixed(docs)
    rows = P.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == kept and kept
    test_packing.check(rows, {i: docs[i]["text"] for i in kept}, 0.02)


def test_stages_keep_columns_and_cope_with_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "src1", 0), (2, "a b c d e f g", "en", "odd", 13), (3, "a b c d e f g", None, None, 13), (3, "x", "en", "src1", 1)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)
    for start in (docs, docs.limit(0)):
        df = start
        for name, stage in P.STAGES:
            df = stage(spark, df, SF)
            if name != "packing":
                assert df.columns == docs.columns
            df.collect()


def test_columns_that_clash_are_carried_along(spark):
    names = ["score", "predicted", "held_out", "found", "domain", "tokens", "epochs", "row", "number", "base_spans", "clear_text", "_base", "_bin", "_hash", "level0", "fine", "odd name"]
    rows = [(i, f"text number {i} " + " ".join(f"w{i}x{k}" for k in range(30)) + (" password=abcdefghijklmnop" if i % 3 == 0 else ""), "en", f"src{i % 3}", 1, *[f"{n}-{i}" for n in names]) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        kept = out.collect()
        assert kept and all(r[n] == f"{n}-{r.doc_id}" for r in kept for n in names), name
    assert P.pack_sequences(spark, docs, SF).count() >= 12


def test_very_long_texts_and_ties(spark):
    long = " ".join(f"w{k}" for k in range(60_000))
    rows = [(1, long), (2, long + " end"), (3, "token = " + "a1b2" * 50_000), (4, long[: len(long) // 2]), (7, "short text of some words"), (7, "short text of some words")]
    docs = spark.createDataFrame([(*r, "en", "src1", len(r[1])) for r in rows], spark.read.parquet(f"{SF}/documents.parquet").schema)
    assert sorted(r.doc_id for r in P.keep_one_of_near_duplicates(spark, docs, SF).collect()) == [1, 3, 4, 7]
    clean = {r.doc_id: r for r in P.redact_secrets(spark, docs, SF).collect()}
    assert clean[3].text == "[secret]" and clean[3].n_chars == 8 and clean[1].text == long
    assert P.mix_sources(spark, docs, SF).count() > 0
    assert sum(r.length for r in P.pack_sequences(spark, docs, SF).collect() if r.doc_id == 1) > 60_000


def test_one_row_of_each_group_stays_where_ids_repeat_or_lack(spark):
    x, y, z, near = "a b c d e f g", "h i j k l m n", "o p q r s t u", " ".join(map(str, range(60)))
    rows = [(3, x), (5, x), (5, y), (7, y), (9, z), (9, z), (None, near), (None, near + " 60"), (None, "p"), (None, ""), (None, None), (11, ""), (11, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(*r, "en", "src1", 1) for r in rows], schema).repartition(3)
    out = P.keep_one_of_near_duplicates(spark, docs, SF)
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert out.columns == docs.columns
    either = near if (None, near) in got else near + " 60"
    assert got == sorted([(3, x), (5, y), (9, z), (None, either), (None, "p"), (None, ""), (None, None), (11, ""), (11, None)], key=str)
