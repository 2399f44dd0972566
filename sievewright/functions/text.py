"""Text, list-cell and label expressions. Everything here is a Column; nothing needs a Python worker."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import bind

# ---- white space, keys, ids

#: White space as Python's str methods see it: Java's Unicode class plus the four separator controls.
SPACE = r"(?U)[\s\x1c-\x1f]+"


def normalize_space(c: Column) -> Column:
    """Runs of white space become one blank; ends are trimmed. Null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), SPACE, " "))


def composite_key(*parts: Column) -> Column:
    return F.struct(*[normalize_space(p).alias(f"k{i}") for i, p in enumerate(parts)])


def stable_id(*parts: Column, size: int = 20) -> Column:
    """The first ``size`` hex digits of SHA-1 over the parts joined by ``||``; null parts count as empty."""
    return F.substring(F.sha1(F.concat_ws("||", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, size)


def slug(c: Column) -> Column:
    """Lower-cased alphanumerics, everything else collapsed to one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)[^\p{Alnum}]+", "_"), r"^_+|_+$", "")


def file_part(c: Column) -> Column:
    """A value as part of a file name: letters, digits, dot, dash and underscore stay."""
    return F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", "")


# ---- sentences, words, tokens


def sentences(c: Column, most: int | None = None) -> Column:
    """Sentences of the normalised text, at most the first ``most``; empty text has none."""
    n = normalize_space(c)
    parts = F.filter(F.split(n, r"(?<=[.!?])\s+"), lambda s: F.length(F.trim(s)) > 0)
    return parts if most is None else F.slice(parts, 1, most)


def words(c: Column) -> Column:
    """Pieces between single blanks, as a plain split gives them."""
    return F.split(c, " ")


def word_count_between(c: Column, low: int, high: int) -> Column:
    """Strictly between both bounds."""
    n = F.size(words(c))
    return (n > low) & (n < high)


def estimate_tokens(c: Column) -> Column:
    """A token for every four characters begun, at least one; blank text has none."""
    n = F.length(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.ceil(n / 4).cast("int"))).cast("long")


def drop_last_word(c: Column) -> Column:
    w = words(c)
    return F.array_join(F.slice(w, F.lit(1), F.size(w) - 1), " ")


def first_words(c: Column, n: Column) -> Column:
    return F.array_join(F.slice(words(c), F.lit(1), n), " ")


def truncate_at(c: Column, mark: str, count: int) -> Column:
    """The text before the ``count``-th occurrence of ``mark``."""
    return F.substring_index(c, mark, count)


def trim_pair(a: Column, b: Column) -> tuple[Column, Column]:
    """Both texts cut to the smaller word count."""
    n = F.least(F.size(words(a)), F.size(words(b)))
    return first_words(a, n), first_words(b, n)


def question_answer(question: Column, answer: Column) -> Column:
    """``Question: … Answer: …``; the answer alone where there is no question."""
    return F.when(F.coalesce(question, F.lit("")) != "", F.concat(F.lit("Question: "), question, F.lit(" Answer: "), answer)).otherwise(answer)


# ---- list cells

JSON_STRINGS = "array<string>"


def decode_list(c: Column, variant: str = "rewrite") -> Column:
    """A list kept as text in one cell, by the reader's variant.

    ``rewrite``: JSON, else single-quoted list, else the cell itself is the one item; blank items go, null items stay.
    ``strict``: as ``rewrite`` but items are stripped, null items go and the texts ``nan`` and ``null`` are empty lists.
    ``perturb``: null items go, blank ones and padding stay; ``nan`` and ``null`` are empty lists.
    ``json``: JSON lists only, anything else is empty; items are stripped, blank and null ones go.
    ``answers``: as ``strict``, but the texts ``nan`` and ``null`` are items.
    ``literal``: a list of quoted items as a program prints it, items as they are; anything else is the one item, null is a null item.

    Lists may be JSON or literals: items in single or double quotes, with escaped quotes, line ends and code points inside, and ``None``.
    """
    listed = F.from_json(c, JSON_STRINGS, {"allowSingleQuotes": "false"})
    loose = F.coalesce(listed, literal_list(c))
    empty = F.array().cast(JSON_STRINGS)
    blank = F.trim(F.coalesce(c, F.lit(""))) == ""
    if variant == "rewrite":
        scalar = F.when(F.trim(c) == "null", F.array(F.lit(None).cast("string"))).otherwise(F.array(c))
        return F.when(blank, empty).otherwise(F.filter(F.coalesce(loose, scalar), lambda x: x.isNull() | (F.trim(x) != "")))
    missing = blank | F.trim(c).isin("nan", "null")
    if variant == "strict":
        items = F.transform(F.filter(F.coalesce(loose, F.array(c)), lambda x: x.isNotNull()), normal_strip)
        return F.when(missing, empty).otherwise(F.filter(items, lambda x: x != ""))
    if variant == "perturb":
        return F.when(missing, empty).otherwise(F.filter(F.coalesce(loose, F.array(c)), lambda x: x.isNotNull()))
    if variant == "answers":
        items = F.transform(F.filter(F.coalesce(loose, F.array(c)), lambda x: x.isNotNull()), normal_strip)
        return F.when(blank, empty).otherwise(F.filter(items, lambda x: x != ""))
    if variant == "literal":
        return F.coalesce(literal_list(c), F.array(c))
    if variant == "json":
        items = F.transform(F.filter(F.coalesce(listed, empty), lambda x: x.isNotNull()), normal_strip)
        return F.filter(items, lambda x: x != "")
    raise ValueError(f"unknown variant {variant}")


#: One item of a literal list: quoted text in which a backslash takes the next character with it, a number or a constant.
ITEM = r"""(?s)'[^'\\]*+(?:\\.[^'\\]*+)*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+"|-?\d+(?:\.\d+)?|None|null|True|False"""


def unescaped(c: Column) -> Column:
    """Text with backslash escapes resolved, those of quotes, line ends, tabs and code points."""
    pieces = F.regexp_extract_all(c, F.lit(r"(?s)(\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}|\\.|[^\\]+)"), F.lit(1))
    known = F.create_map(*[F.lit(x) for kv in {"n": "\n", "t": "\t", "r": "\r", "\n": ""}.items() for x in kv])

    def one(x: Column) -> Column:
        mark = F.substr(x, F.lit(2), F.lit(1))
        # the code point's two bytes in UTF-16
        hexed = F.decode(F.unhex(F.lpad(F.substr(x, F.lit(3)), 4, "0")), "UTF-16BE")
        return F.when(F.substr(x, F.lit(1), F.lit(1)) != "\\", x).when((F.length(x) > 2) & mark.isin("u", "x"), hexed).otherwise(F.coalesce(F.try_element_at(known, mark), mark))

    return F.when(F.contains(c, F.lit("\\")), F.array_join(F.transform(pieces, one), "")).otherwise(c)


def literal_list(c: Column) -> Column:
    """The items of a list as a program prints it; null if the cell is none."""
    rest = F.regexp_replace(c, ITEM, "")  # of a list brackets, commas and blanks are left
    found = F.regexp_extract_all(c, F.lit(f"({ITEM})"), F.lit(1))

    def item(x: Column) -> Column:
        quoted = F.substr(x, F.lit(1), F.lit(1)).isin("'", '"')
        return F.when(quoted, unescaped(F.substr(x, F.lit(2), F.length(x) - 2))).when(~x.isin("None", "null"), x)

    fits = rest.rlike(r"^\s*\[[\s,]*\]\s*$") & (F.size(found) - F.regexp_count(rest, F.lit(","))).isin(0, 1)
    return F.when(fits, F.transform(found, item))


def normal_strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def encode_list(c: Column) -> Column:
    return F.to_json(c)


def non_blank(c: Column) -> Column:
    """Items that are not blank, normalised."""
    return F.filter(F.transform(c, normalize_space), lambda x: x != "")


# ---- labels

#: Names of both classes by the two readers.
HUMAN = ["human", "human_only", "0", "real"]
MACHINE = ["ai", "machine", "chatgpt", "gpt", "1", "llm"]
NUMERIC = {"human": 0, "ai": 1, "chatgpt": 1, "machine": 1}


def coerce_label(c: Column) -> Column:
    """``human`` or ``ai``; other values fail."""
    v = F.lower(F.trim(c.cast("string")))
    return F.when(v.isin(HUMAN), "human").when(v.isin(MACHINE), "ai").otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(v, F.lit("null")))))


def label_number(c: Column) -> Column:
    """0 or 1 from a name or a number; other values fail."""
    v = F.lower(F.trim(c.cast("string")))
    named = F.create_map(*[F.lit(x) for kv in NUMERIC.items() for x in kv])
    return F.coalesce(F.try_element_at(named, v), v.try_cast("double").cast("int"), F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(v, F.lit("null")))).cast("int"))


# ---- answers on a five-step scale

#: The steps' normalised names, in the order in which free text is searched for them.
LIKERT = {"strongly disagree": 1, "disagree": 2, "neutral neither agree nor disagree": 3, "agree": 4, "strongly agree": 5}
#: Short forms that only a label field may have.
LIKERT_FIELD = LIKERT | {"neutral": 3, "neither agree nor disagree": 3}
#: Fixed names of the fields that hold a score or a label.
SCORE_FIELDS, LABEL_FIELDS = ["score", "rating", "likert_score"], ["label", "answer", "choice"]


def normal_label(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))


def likert_score(c: Column) -> Column:
    """1 to 5, or null: a score field of JSON in the answer, its label field, a lone digit, then a name in the text."""
    body = F.coalesce(F.when(c.rlike(r"^\s*\{"), c), F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit("")))
    field = lambda names: F.coalesce(*[F.when(~F.get_json_object(body, f"$.{n}").isin("", "0", "false"), F.get_json_object(body, f"$.{n}")) for n in names])
    by_name = F.create_map(*[F.lit(x) for kv in LIKERT_FIELD.items() for x in kv])
    digit = lambda x: F.nullif(F.regexp_extract(x, r"\b([1-5])\b", 1), F.lit("")).cast("int")
    text, found = normal_label(c), F.lit(None).cast("int")
    for name, score in reversed(LIKERT.items()):
        found = F.when(F.contains(text, F.lit(name)), score).otherwise(found)
    return F.coalesce(digit(field(SCORE_FIELDS)), F.try_element_at(by_name, normal_label(field(LABEL_FIELDS))), digit(c), found)


# ---- style

DASH = "—–"


def drop_dashes(c: Column) -> Column:
    """Em and en dashes become commas; commas and blanks around them are tidied, runs of white space collapse."""
    for dash in DASH:
        c = F.regexp_replace(c, rf"(?U)\s+{dash}\s+", ", ")
        c = F.regexp_replace(c, rf"(?U){dash}\s*", ", ")
    c = F.regexp_replace(c, r"(?U),\s*,", ",")
    c = F.regexp_replace(c, r"(?U)^\s*,\s*", "")
    return F.trim(F.regexp_replace(c, r"(?U)\s{2,}", " "))


#: Fixed ranges of code points taken for emoji.
EMOJI = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2700}-\x{27BF}\x{1F900}-\x{1F9FF}\x{2600}-\x{26FF}]+"


def drop_emoji(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, EMOJI, ""), r"(?U)\s{2,}", " "))


def markdown_to_prose(c: Column) -> Column:
    """Headers end in a full stop, rules go, bold is unwrapped, and a run of list items becomes ``a. b. c.``; lines are joined by blanks."""

    def plain(line: Column) -> Column:
        header = F.trim(F.regexp_extract(line, r"^#{1,6}\s+(.+)", 1))
        line = F.when(header == "", line).when(header.rlike(r"[.!?]$"), header).otherwise(F.concat(header, F.lit(".")))
        line = F.when(line.rlike(r"^\s*[-*=]{3,}\s*$"), "").otherwise(line)
        line = F.regexp_replace(line, r"\*\*([^*]+?)\*\*", "$1")
        return normal_strip(F.regexp_replace(line, r"__([^_]+?)__", "$1"))

    def said(line: Column) -> Column:
        item = normal_strip(F.regexp_extract(line, r"^(?:[-*\u2022]|\d+\.)\s+(.+)", 1))
        # items that are joined by ". " and end in "." are items with a full stop each, joined as other lines are
        return F.when(item != "", F.concat(item, F.lit("."))).otherwise(line)

    lines = F.transform(F.split(c, "\n"), lambda x: bind(plain(x), said))
    return F.trim(F.regexp_replace(F.array_join(F.filter(lines, lambda x: x != ""), " "), r"(?U)\s{2,}", " "))


def cleanup_style(c: Column) -> Column:
    """Dashes, emoji, then Markdown, in this order."""
    return markdown_to_prose(drop_emoji(drop_dashes(c)))


#: Fixed tags of prompts.
PROMPT_TAGS = ["[ WP ]", "[ OT ]"]
#: Fixed replacements of a detokeniser, in order.
DETOKENIZE = [
    (" ,", ","), (" .", "."), (" ?", "?"), (" !", "!"), (" ;", ";"), (" '", "'"), (" ’ ", "'"), (" :", ":"), ("<newline>", "\n"), ("`` ", '"'),
    (" ''", '"'), ("''", '"'), (".. ", "... "), (" )", ")"), ("( ", "("), (" n't", "n't"), (" i ", " I "), (" i'", " I'"), ("\\'", "'"), ("\n ", "\n"),
]


def drop_prompt_tags(c: Column) -> Column:
    for tag in PROMPT_TAGS:
        c = F.replace(c, F.lit(tag), F.lit(""))
    return c


def detokenize(c: Column) -> Column:
    for old, new in DETOKENIZE:
        c = F.replace(c, F.lit(old), F.lit(new))
    return normal_strip(c)


# ---- masks

MASK = r"<extra_id_\d+>"


def count_masks(c: Column) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(f"({MASK})"), F.lit(1)))


def extract_fills(c: Column) -> Column:
    """The texts between the masks of a filler's answer."""
    body = F.trim(F.replace(F.replace(c, F.lit("<pad>"), F.lit("")), F.lit("</s>"), F.lit("")))
    parts = F.split(body, MASK)
    return F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), lambda x: F.trim(x))


def apply_fills(c: Column, fills: Column) -> Column:
    """Masks replaced in order; empty if there are fewer fills than masks."""

    def of(pieces: Column, f: Column) -> Column:
        n = F.size(pieces) - 1
        whole = F.array_join(F.transform(pieces, lambda p, i: F.when(i < n, F.concat(p, F.get(f, i))).otherwise(p)), "")
        return F.when(F.size(f) < n, F.lit("")).otherwise(whole)

    return bind(F.split(c, MASK), lambda pieces: bind(fills, lambda f: of(pieces, f)))


def seeded_positions(n: Column, most: int, count: int, *key: Column) -> Column:
    """``count`` distinct places below ``least(n, most)``, chosen by a hash of the key, ascending."""
    size = F.least(n, F.lit(most))
    ranked = F.array_sort(F.transform(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))), lambda i: F.struct(F.md5(F.concat_ws("|", *[k.cast("string") for k in key], i.cast("string"))).alias("h"), i.alias("i"))))
    return F.array_sort(F.transform(F.slice(ranked, 1, count), lambda r: r["i"]))


def replace_words(c: Column, places: Column, fill: Column) -> Column:
    """Words at the places replaced by ``fill``."""
    return bind(places, lambda at: F.array_join(F.transform(words(c), lambda w, i: F.when(F.array_contains(at, i), fill).otherwise(w)), " "))


def mask_words(c: Column, places: Column) -> Column:
    """Words at the (ascending) places replaced by masks numbered from the left."""
    mask = lambda at, i: F.concat(F.lit("<extra_id_"), (F.array_position(at, i) - 1).cast("string"), F.lit(">"))
    return bind(places, lambda at: F.array_join(F.transform(words(c), lambda w, i: F.when(F.array_contains(at, i), mask(at, i)).otherwise(w)), " "))


# ---- prompts and responses


def rewrite_prompt(text: Column, prefix: str, question: Column | None = None, domain: Column | None = None) -> Column:
    """Instruction, domain, question and the answer to rewrite, each under its heading."""
    lines = [F.lit(prefix.strip()), F.lit(""), F.concat(F.lit("Domain: "), F.coalesce(F.nullif(domain, F.lit("")) if domain is not None else F.lit(None), F.lit("unknown")))]
    lines += [F.lit("Question:"), normal_strip(F.coalesce(question, F.lit(""))) if question is not None else F.lit(""), F.lit(""), F.lit("Answer to rewrite:"), normal_strip(F.coalesce(text, F.lit("")))]
    return normal_strip(F.concat_ws("\n", *lines))


def quality_prompt(text: Column, statement: str) -> Column:
    """The prompt of a quality check: a statement, the five steps of the scale with their numbers, the form of the answer, the document."""
    steps = [f"{score} = {name.title()}" for name, score in LIKERT.items()]
    lines = ["Judge the document by the statement.", "", f'Statement: "{statement}"', *steps, "", 'Answer in JSON with "score" (1 to 5), "label" and "reason".', "", "Document:"]
    return normal_strip(F.concat_ws("\n", *[F.lit(x) for x in lines], normal_strip(F.coalesce(text, F.lit("")))))


def response_text(c: Column) -> Column:
    """The text of a response object: ``output_text``, else the parts of its output joined."""
    parts = F.from_json(F.get_json_object(c, "$.output"), "array<struct<content:array<struct<text:string>>>>")
    joined = F.array_join(F.flatten(F.transform(F.coalesce(parts, F.array().cast("array<struct<content:array<struct<text:string>>>>")), lambda o: F.transform(F.coalesce(o["content"], F.array().cast("array<struct<text:string>>")), lambda x: F.coalesce(x["text"], F.lit(""))))), "")
    return F.trim(F.coalesce(F.nullif(F.get_json_object(c, "$.output_text"), F.lit("")), joined))


def response_usage(c: Column) -> Column:
    """``struct(requests, input_tokens, output_tokens, total_tokens)`` of a response object; numbers that are missing are 0."""
    names = ["input_tokens", "output_tokens", "total_tokens"]
    return F.struct(F.lit(1).cast("long").alias("requests"), *[F.coalesce(F.get_json_object(c, f"$.usage.{n}").try_cast("double").cast("long"), F.lit(0).cast("long")).alias(n) for n in names])


# ---- filters

#: Fixed marks of texts that are left out, each as it is written.
EXCLUDED = ["nsfw", "NSFW"]


def not_excluded(c: Column) -> Column:
    """No mark of ``EXCLUDED`` in the text; upper and lower case are told apart."""
    keep = F.lit(True)
    for mark in EXCLUDED:
        keep = keep & ~F.contains(c, F.lit(mark))
    return keep


def rough_tokens(c: Column) -> Column:
    """Number of words and punctuation marks, which stands for a tokenizer's count."""
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\x09-\x0D\x20]"))


def within_tokens(*texts: Column, most: int = 512) -> Column:
    """Every one of the texts has at most ``most`` tokens."""
    keep = F.lit(True)
    for c in texts:
        keep = keep & (rough_tokens(c) <= most)
    return keep


# ---- spans


def span_starts(n: Column, span: int, buffer: int, share: float, *key: Column) -> Column:
    """Places, ascending, where spans of ``span`` of ``n`` words begin: ``share * n / (span + 2 * buffer)`` of them, rounded down.

    Words are dealt out in runs of ``span + 2 * buffer``; the runs are chosen by a hash of the key, and the words around a span
    are its buffer, so that two spans are at least twice ``buffer`` apart.
    """
    run = span + 2 * buffer

    def of(n: Column) -> Column:
        count = F.floor(F.lit(share) * n / run).cast("int")
        runs = F.filter(F.sequence(F.lit(0), F.floor(n / run).cast("int")), lambda i: (i + 1) * run <= n)
        ranked = F.array_sort(F.transform(runs, lambda i: F.struct(F.md5(F.concat_ws("|", *[k.cast("string") for k in key], i.cast("string"))).alias("h"), i.alias("i"))))
        return F.array_sort(F.transform(F.slice(ranked, F.lit(1), count), lambda r: r["i"] * run + buffer))

    return bind(n, of)


def mask_spans(c: Column, starts: Column, span: int) -> Column:
    """``span`` words from each of the (ascending) starts on become one mask; masks are numbered from the left."""
    return bind(words(c), lambda w: bind(starts, lambda at: F.array_join(F.flatten(_with_spans(w, at, span, lambda k: F.array(F.concat(F.lit("<extra_id_"), k.cast("string"), F.lit(">"))))), " ")))


def _with_spans(w: Column, at: Column, span: int, instead) -> Column:
    """Arrays of words: what lies before each span, what stands for it, and what follows the last."""
    begin = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(at, k - 1) + span)
    before = F.transform(at, lambda a, k: F.concat(F.slice(w, begin(k) + 1, a - begin(k)), instead(k)))
    rest = F.when(F.size(at) == 0, w).otherwise(F.slice(w, F.get(at, F.size(at) - 1) + span + 1, F.size(w)))
    return F.concat(before, F.array(rest))


def replace_spans(c: Column, starts: Column, span: int, fills: Column) -> Column:
    """``struct(text, log)``: each span replaced by its fill (any number of words); the log has a start, the old and the new words for each.

    A missing fill leaves its span as it is.
    """

    def of(w: Column, at: Column, put: Column) -> Column:
        old = lambda k: F.slice(w, F.get(at, k) + 1, F.lit(span))
        new = lambda k: F.coalesce(F.split(F.get(put, k), " "), old(k))
        text = F.array_join(F.flatten(_with_spans(w, at, span, new)), " ")
        log = F.transform(at, lambda a, k: F.struct(a.alias("start"), F.array_join(old(k), " ").alias("old"), F.array_join(new(k), " ").alias("new")))
        return F.struct(text.alias("text"), log.alias("log"))

    return bind(words(c), lambda w: bind(starts, lambda at: bind(fills, lambda put: of(w, at, put))))


# ---- times


def utc_iso(c: Column) -> Column:
    """A timestamp as ``2026-01-31T12:00:00Z``; session time zones other than UTC are converted."""
    return F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def run_id(c: Column) -> Column:
    """A timestamp as ``20260131T120000Z``."""
    return F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyyMMdd'T'HHmmss'Z'")
