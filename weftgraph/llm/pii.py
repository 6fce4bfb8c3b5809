"""Personal data: base patterns, and terms that disclose them; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import all_columns
from weftgraph.session import materialize

KINDS = ("email", "ip", "card", "phone", "term")

# Possessive forms of the stated patterns: they match the same strings without
# backtracking or recursion, so that a text of one endless run takes linear time. A
# run of letters is tried from its start, or from the end of the match before it.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    # Only whole runs of 14 to 19 digits; any other run would be dropped.
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTETS = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"
#: A term: letters between white space, before a mark of punctuation at most.
TERM = r"(?<!\S)\p{L}{3,40}+(?=[,.;:!?]?(?:\s|$))"

#: Up to so many disclosing terms, or hashes of texts, are broadcast (8 bytes and a short word each); more are joined by shuffle.
BROADCAST_ROWS = 500_000

#: Items of an array that one fold works on. A fold copies what it has for every item, so arrays are folded in blocks.
BLOCK = 64

SPAN = "struct<s:int,e:int,v:string>"
FOUND = "struct<s:int,k:int,e:int,remove:boolean>"


def let(value: Column, body) -> Column:
    """`body` of `value`, which is worked out once, however often `body` or a lambda in it refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blocks(items: Column, size: int = BLOCK) -> Column:
    """The array `items` as an array of arrays of `size` items; an empty one as one empty block."""
    last = lambda xs: F.greatest(F.ceil(F.size(xs) / size).cast("int") - 1, F.lit(0))
    return let(items, lambda xs: F.transform(F.sequence(F.lit(0), last(xs)), lambda i: F.slice(xs, i * size + 1, size)))


def before(parts: Column, of_block, combine) -> Column:
    """For each block the running value of all blocks before it, from 0 on: `combine` of it and `of_block`."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, b: F.struct(combine(acc["at"], of_block(b)).cast("int").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    return F.aggregate(parts, start, step, lambda acc: acc["out"])


def folded(items: Column, kind: str, of_item, combine, out) -> Column:
    """For each item the array `out(at, item)` of type `kind`, all in one; `at` is the running `combine` of `of_item` before the item."""

    def of_block(block: Column) -> Column:
        return F.aggregate(block, F.lit(0), lambda at, x: combine(at, of_item(x)).cast("int"))

    def fold(block: Column, at: Column) -> Column:
        start = F.struct(at.alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
        step = lambda acc, x: F.struct(combine(acc["at"], of_item(x)).cast("int").alias("at"), out(acc["out"], acc["at"], x).alias("out"))
        return F.aggregate(block, start, step, lambda acc: acc["out"])

    return let(blocks(items), lambda parts: F.flatten(F.zip_with(parts, before(parts, of_block, combine), fold)))


def plus(a: Column, b: Column) -> Column:
    return a + b


def located(text: Column, pattern: str, gate: Column) -> Column:
    """Array of (s, e, v): code points and string of each match, from one split and one extraction; empty unless `gate`."""
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    pairs = F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("v"))

    def out(found: Column, at: Column, x: Column) -> Column:
        s = (at + x["gap"]).cast("int")
        span = F.struct(s.alias("s"), (s + F.length(x["v"])).cast("int").alias("e"), x["v"].alias("v")).cast(SPAN)
        return F.when(x["v"].isNotNull(), F.concat(found, F.array(span))).otherwise(found)

    spans = folded(pairs, SPAN, lambda x: x["gap"] + F.coalesce(F.length(x["v"]), F.lit(0)), plus, out)
    return F.when(gate, spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    at = F.sequence(F.lit(1), F.length(number))

    def part(i: Column) -> Column:
        d = F.substring(number, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when((F.length(number) - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(at, part), F.lit(0), lambda a, x: a + x) % 10 == 0


def _of_kind(k: int):
    return lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), x["v"].alias("v"))


def _is_kind(k: int):
    return lambda x: x["k"] == k


def base_spans(text: Column) -> Column:
    """Array of (s, k, e, v) in order: start, index in KINDS, end, string of every base match in `text`."""
    parts = []
    gates = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(PATTERNS["ip"]), "card": text.rlike(PATTERNS["card"]), "phone": F.contains(text, F.lit("+"))}
    tests = {
        "email": None,
        "ip": lambda x: x["v"].rlike(OCTETS),
        "card": lambda x: luhn(digits(x["v"])),
        "phone": lambda x: F.length(digits(x["v"])).between(10, 15),
    }
    for k, kind in enumerate(KINDS[:4]):
        spans = located(text, PATTERNS[kind], gates[kind])
        spans = F.filter(spans, tests[kind]) if tests[kind] else spans
        parts.append(F.transform(spans, _of_kind(k)))
    return F.array_sort(F.concat(*parts))


def terms_of(text: Column, term: str = TERM) -> Column:
    """The distinct terms of `text`, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(term), F.lit(0)), lambda x: F.lower(x)))


def occurrences(text: Column, terms: Column, term: str = TERM) -> Column:
    """Array of (s, k, e, remove): every occurrence in `text` of a key of the map `terms`, whose value is `remove`."""
    pairs = F.arrays_zip(F.split(text, term, -1), F.regexp_extract_all(text, F.lit(term), F.lit(0)))
    items = F.transform(pairs, lambda x: F.struct(F.length(x["0"]).alias("gap"), F.coalesce(F.length(x["1"]), F.lit(0)).alias("n"), F.try_element_at(terms, F.lower(x["1"])).alias("remove")))

    def out(found: Column, at: Column, x: Column) -> Column:
        s = (at + x["gap"]).cast("int")
        span = F.struct(s.alias("s"), F.lit(4).alias("k"), (s + x["n"]).cast("int").alias("e"), x["remove"].alias("remove")).cast(FOUND)
        return F.when(x["remove"].isNotNull(), F.concat(found, F.array(span))).otherwise(found)

    return folded(items, FOUND, lambda x: x["gap"] + x["n"], plus, out)


def texts_of(found: DataFrame, hashes: DataFrame) -> DataFrame:
    """(body_hash, text) of the texts with one of the distinct `hashes`, once each; copies are combined where they lie, before rows move."""
    if hashes.count() <= BROADCAST_ROWS:
        return found.join(F.broadcast(hashes), "body_hash", "left_semi").groupBy("body_hash").agg(F.first("text").alias("text"))
    return found.groupBy("body_hash").agg(F.first("text").alias("text")).join(hashes, "body_hash", "left_semi")


def disclosing(found: DataFrame, base: DataFrame, min_texts: int, generalise_at: float, remove_at: float, term: str) -> DataFrame:
    """Pairs (entity, term) whose disclosure reaches `generalise_at`, with `remove` set from `remove_at` on.

    Disclosure is PMI(entity, term) / IC(entity), 1 where the term determines the
    entity: PMI = log2(N n(e,t) / (n(e) n(t))) and IC = log2(N / n(e)), counted in
    whole documents of the whole corpus, one a row. Pairs in fewer than `min_texts` different texts are no evidence, so entities
    in fewer are left out before pairs are made. Equal texts have equal pairs, which are made once and counted for each document.
    """
    bodies = base.where(F.size("spans") > 0).groupBy("body_hash").agg(F.count("*").alias("n_body"), F.first("spans").alias("spans"))
    entity = F.explode(F.array_distinct(F.transform("spans", lambda x: F.xxhash64(x["k"], F.lower(x["v"])))))
    owners = materialize(bodies.select("body_hash", "n_body", entity.alias("entity")))
    entities = materialize(owners.groupBy("entity").agg(F.sum("n_body").alias("n_entity"), F.count("*").alias("_texts")).where(F.col("_texts") >= min_texts).drop("_texts"))
    owners = materialize(owners.join(entities, "entity"))
    texts = texts_of(found, materialize(owners.select("body_hash").distinct()))
    near = owners.join(texts, "body_hash").select("entity", "n_entity", "n_body", F.explode(terms_of(F.col("text"), term)).alias("term"))
    pairs = near.groupBy("entity", "n_entity", "term").agg(F.sum("n_body").alias("n_pair"), F.count("*").alias("_texts")).where(F.col("_texts") >= min_texts)
    terms = found.select(F.explode(terms_of(F.col("text"), term)).alias("term")).groupBy("term").agg(F.count("*").alias("n_term")).where(F.col("n_term") >= min_texts)
    total = found.agg(F.count("*").alias("n_docs"))
    scored = pairs.join(terms, "term").crossJoin(F.broadcast(total))
    n = F.col("n_docs").cast("double")
    information = F.log2(n / F.col("n_entity"))
    mutual = F.log2(n * F.col("n_pair") / (F.col("n_entity") * F.col("n_term").cast("double")))
    scored = scored.withColumn("disclosure", F.when(information > 0, mutual / information).otherwise(0.0))
    return scored.where(F.col("disclosure") >= generalise_at).select("entity", "term", "disclosure", (F.col("disclosure") >= remove_at).alias("remove"))


def find(docs: DataFrame, min_texts: int = 3, generalise_at: float = 0.9, remove_at: float = 0.97, term: str = TERM) -> DataFrame:
    """Per row of `docs`: doc_id, body_hash and `spans`, an array of (s, k, e, remove) in order of start and kind.

    Base spans (kinds 0 to 3) are those of the patterns; kind 4 is a term that discloses an entity, wherever
    it stands: beside the entity, elsewhere in its documents or in any other. What may be a term is the pattern `term`:
    by default 3 to 40 letters between white space, so words of one or two letters and scripts without spaces are not judged.
    Two texts that share an entity are often near copies, which share all their rare words too; so evidence takes `min_texts`
    of three. Offsets are code points, end exclusive. Shuffled are
    counts of terms, combined on the map side, and texts only if they hold an entity that several documents
    share or a disclosing term.

    Null text counts as empty; a null doc_id is passed on; repeated rows get the same spans and count as documents of
    their own; an empty table gives an empty result; other columns are not read. A text is worked on whole, in time that
    grows with its length and matches, and has to fit in memory.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = docs.withColumn("body_hash", F.xxhash64("text"))
    base = materialize(found.select("doc_id", "body_hash", base_spans(F.col("text")).alias("spans")))
    pairs = disclosing(found, base, min_texts, generalise_at, remove_at, term)
    terms = materialize(pairs.groupBy("term").agg(F.max("remove").alias("remove")))
    # Both ways give the same rows; the broadcast spares a shuffle of every word of every document.
    near = F.broadcast(terms) if terms.count() <= BROADCAST_ROWS else terms
    held = found.select("body_hash", F.explode(terms_of(F.col("text"), term)).alias("term")).join(near, "term").distinct()
    held = materialize(held.groupBy("body_hash").agg(F.map_from_entries(F.collect_list(F.struct("term", "remove"))).alias("terms")))
    extra = texts_of(found, held.select("body_hash")).join(held, "body_hash")
    extra = materialize(extra.select(F.col("body_hash").alias("_b"), occurrences(F.col("text"), F.col("terms"), term).alias("more")))
    plain = F.transform("spans", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), F.lit(False).alias("remove")))
    rows = base.withColumn("spans", plain).join(extra, F.col("body_hash") == F.col("_b"), "left")
    return rows.select("doc_id", "body_hash", F.when(F.col("more").isNull(), F.col("spans")).otherwise(F.array_sort(F.concat("spans", F.coalesce("more", F.array().cast(f"array<{FOUND}>"))))).alias("spans"))


def joined(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["k"] + 1), x["s"], x["e"])), ",")


def digest(spans: DataFrame) -> DataFrame:
    """The columns of the op1 query from the spans of `find`."""
    base = F.filter("spans", lambda x: x["k"] < 4)
    counts = [F.size(F.filter("spans", _is_kind(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return spans.select("doc_id", *counts[:4], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), counts[4])


def masked(text: Column, spans: Column) -> Column:
    """`text` with each span replaced by its class in brackets, or nothing for terms to remove; where spans overlap, by the first.

    The class of a base span is its kind; of a term it is NAME where it starts with a capital letter, else TERM.
    """
    labels = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    edit = "struct<a:int,s:int,e:int,k:int,remove:boolean>"

    def out(found: Column, at: Column, x: Column) -> Column:
        one = F.struct(at.cast("int").alias("a"), x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"), x["remove"].alias("remove")).cast(edit)
        return F.when(x["s"] >= at, F.concat(found, F.array(one))).otherwise(found)

    edits = folded(spans, edit, lambda x: x["e"], F.greatest, out)

    def label(part: Column, x: Column, base: Column) -> Column:
        first = F.substring(part, x["s"] - base + 1, F.lit(1))
        kind = F.when((x["k"] == 4) & (F.lower(first) != first), F.lit("[NAME]")).otherwise(F.element_at(labels, x["k"] + 1))
        return F.when(x["remove"], F.lit("")).otherwise(kind)

    # A substring is sought from the start of its string, so the text is cut for blocks of blocks of edits first.
    def cut(part: Column, base: Column, xs: Column, sizes: tuple[int, ...]) -> Column:
        if not sizes:
            return F.array_join(F.transform(xs, lambda x: F.concat(F.substring(part, x["a"] - base + 1, x["s"] - x["a"]), label(part, x, base))), "")

        def inner(block: Column) -> Column:
            begin, end = F.get(block, F.lit(0))["a"], F.element_at(block, -1)["e"]
            return F.when(F.size(block) > 0, let(F.substring(part, begin - base + 1, end - begin), lambda p: cut(p, begin, block, sizes[1:]))).otherwise(F.lit(""))

        return F.array_join(F.transform(blocks(xs, sizes[0]), inner), "")

    rest = F.coalesce(F.array_max(F.transform(spans, lambda x: x["e"])), F.lit(0))
    return F.concat(let(edits, lambda xs: cut(text, F.lit(0), xs, (BLOCK * BLOCK, BLOCK))), F.substring(text, rest + 1, F.length(text)))


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """`docs` with personal data and disclosing terms masked in `text`; same rows and columns, n_chars brought up to date where there is one.

    Rows without spans keep their text. Null text stays null; columns of any name are carried along; other edge cases as in `find`.
    """
    spans = find(docs, **options).where(F.size("spans") > 0).groupBy("doc_id", "body_hash").agg(F.first("spans").alias("spans"))
    text = F.col("text").cast("string")
    rows = docs.select(F.struct(*all_columns(docs)).alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_hash"))
    rows = rows.join(spans, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_hash") == F.col("body_hash")), "left")
    changed = F.col("_row").withField("text", masked(F.col("_row.text").cast("string"), F.col("spans")))
    if "n_chars" in docs.columns:
        changed = let(changed, lambda row: row.withField("n_chars", F.length(row["text"]).cast(docs.schema["n_chars"].dataType)))
    return rows.select(F.when(F.col("spans").isNull(), F.col("_row")).otherwise(changed).alias("_row")).select("_row.*")
