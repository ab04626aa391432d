"""PII: base patterns and information-theoretic sanitisation.

Base spans are e-mail addresses, IP addresses, card and phone numbers. The corpus then says which terms reveal a protected
entity (one value of a base kind): with p over distinct texts, a term's disclosure of an entity is
PMI(term, entity) / IC(entity), 1 if the term occurs in texts with that entity only, at any distance. Terms that share `SUPPORT` distinct
texts with an entity and reach `DISCLOSURE` are generalised: they become spans of kind `term` wherever they occur.

Entities in under `SUPPORT` texts, and terms in more texts than any entity's threshold allows, leave before pairs are made; a text then gives
one pair for each of its entities and terms left. All counts are of distinct texts; copies of a text count once.

Nulls: a null text counts as empty and has no spans. Repeated rows give one row each. Long texts are read whole; the
patterns are possessive, so neither long digit runs nor long words cost more than linear time or stack.
"""

from pyspark.sql import Column, DataFrame, functions as F

from tracklens.llm.common import ROW, bound, digest, field_of, join_on_group, packed, scalar, table, text_of
from tracklens.llm.exact_dedup import flag_repeated, repeated_filter
from tracklens.llm.spans import matches
from tracklens.session import stage_table

LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(PATTERNS)
SUPPORT = 3
DISCLOSURE = 0.8
BROADCAST_TERMS = 200_000
TERM = r"[\p{L}][\p{L}\p{N}]{2,}+"
NOT_TERM = r"[^\p{L}\p{N}]+"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(number: Column) -> Column:
    def value(digits: Column, i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        doubled = d * 2
        return F.when(i % 2 == 1, d).otherwise(F.when(doubled > 9, doubled - 9).otherwise(doubled))

    return bound(number, lambda n: F.aggregate(F.sequence(F.lit(1), F.length(n)), F.lit(0), lambda acc, i: acc + value(n, i)) % 10 == 0)


def _passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3) & F.forall(F.split(value, r"\."), lambda p: F.lpad(F.ltrim(p, F.lit("0")), 3, "0") <= "255")
    if kind == "card":
        return F.when(F.length(_digits(value)).between(14, 19), _luhn(_digits(value))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Base spans sorted by start, then kind as listed: structs of start, rank, end, kind, value."""
    def spans(rank: int, kind: str) -> Column:
        kept = F.filter(matches(text, PATTERNS[kind]), lambda m: _passes(kind, m["value"]))
        return F.transform(kept, lambda m: _span(m, rank, kind))

    return F.array_sort(F.concat(*[spans(rank, kind) for rank, kind in enumerate(KINDS)]))


def _span(match: Column, rank: int, kind: str) -> Column:
    return F.struct(match["start"].alias("start"), F.lit(rank).alias("rank"), match["end"].alias("end"), F.lit(kind).alias("kind"), match["value"].alias("value"))


def joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def term_spans(text: Column, terms: Column) -> Column:
    """Every occurrence of the given lower-case terms as whole words."""
    found = F.filter(matches(text, TERM), lambda m: F.array_contains(terms, F.lower(m["value"])))
    return F.transform(found, lambda m: _span(m, len(KINDS), "term"))


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), NOT_TERM), lambda w: w.rlike("^" + TERM + "$"))


def _outside(text: Column) -> Column:
    """Distinct terms of a text outside its e-mail addresses, the only base spans that hold letters."""
    return F.array_distinct(_terms(F.regexp_replace(text, PATTERNS["email"], " ")))


def _most_texts(n: Column | float, with_entity: Column) -> Column:
    """Texts that a term can have to reach the threshold with an entity: from with_both <= with_entity; a little slack for rounding."""
    return F.pow(F.lit(n), F.lit(1 - DISCLOSURE)) * F.pow(with_entity, F.lit(DISCLOSURE)) * (1 + 1e-9)


def _spotted(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Staged facts of each row (id_, sha_, line_, spans_, and text_ where it has base spans), and the rows id_, sha_, hash_, text_, maybe_.

    `maybe_` is false for texts that the Bloom filter shows to occur once; only the others ever travel to meet their copies.
    """
    base = packed(docs).select(field_of(doc_id).alias("id_"), digest(text_of(text)).alias("sha_"), F.xxhash64(text_of(text)).alias("hash_"), text_of(text).alias("text_"))
    found = base.withColumn("spans_", base_spans(F.col("text_"))).withColumn("line_", F.monotonically_increasing_id())
    facts = stage_table(found.withColumn("text_", F.when(F.size("spans_") > 0, F.col("text_"))), "facts")
    rows = facts.count()
    blocks, size = repeated_filter(facts.select("hash_"), rows)
    return flag_repeated(facts, blocks, size, rows), flag_repeated(base, blocks, size, rows)


def _distinct_texts(rows: DataFrame, *columns: str) -> DataFrame:
    """One row of each text: those that occur once stay where they are."""
    few = rows.filter("maybe_").select(*dict.fromkeys(("sha_", *columns))).dropDuplicates(["sha_"]).select(*columns)
    return rows.filter("NOT maybe_").select(*columns).unionByName(few)


def revealing_terms(facts: DataFrame, texts: DataFrame) -> DataFrame:
    """Staged terms above the threshold with their disclosure: term_, disclosure_.

    A term and an entity meet in every distinct text that holds both, at any distance. Terms and entities are counted over distinct texts first; those
    that cannot reach the support or the threshold with any entity leave before pairs are made. Pairs carry numbers of texts and entities.
    """
    distinct_terms = F.array_distinct(_terms(F.col("text_")))
    by_term = _distinct_texts(texts, "text_").select(F.explode(distinct_terms).alias("term_")).groupBy("term_").agg(F.count(F.lit(1)).alias("with_term_"))
    n = float(scalar(facts.agg(F.count_distinct("sha_")))[0] or 1) + 1.0
    # Of equal texts the staged one with the smallest line stands for all.
    spotted = facts.filter("text_ IS NOT NULL")
    lines = spotted.filter("maybe_").groupBy("sha_").agg(F.min("line_").alias("line_")).select("line_").unionByName(spotted.filter("NOT maybe_").select("line_"))
    once = stage_table(lines, "once")
    chosen = spotted.join(once, "line_", "left_semi")
    entities = stage_table(chosen.select("line_", F.explode("spans_").alias("s_")).select("line_", F.concat_ws(":", "s_.kind", F.lower("s_.value")).alias("entity_")).distinct(), "entities")
    counted = entities.groupBy("entity_").agg(F.count(F.lit(1)).alias("with_entity_")).filter(F.col("with_entity_") >= SUPPORT)
    by_entity = stage_table(counted.withColumn("number_", F.monotonically_increasing_id()), "counts")
    size, most = scalar(by_entity.agg(F.sum("with_entity_"), F.max("with_entity_")))
    known = stage_table(join_on_group(entities, by_entity, "entity_", "with_entity_", ["with_entity_", "number_"], size or 0, ["line_"]).filter("number_ IS NOT NULL").drop("entity_"), "known")
    own = chosen.join(known.select("line_").distinct(), "line_", "left_semi")
    able = by_term.filter((F.col("with_term_") >= SUPPORT) & (F.col("with_term_") <= _most_texts(n, F.lit(float(most or 0)))))
    beside = own.select("line_", F.explode(_outside(F.col("text_"))).alias("term_")).join(able, "term_")
    met = beside.join(known, "line_").filter(F.col("with_term_") <= _most_texts(n, F.col("with_entity_")))
    pairs = met.groupBy("number_", "term_").agg(F.count(F.lit(1)).alias("both_"), F.first("with_term_").alias("with_term_"), F.first("with_entity_").alias("with_entity_")).filter(F.col("both_") >= SUPPORT)
    pmi = F.log(F.col("both_") * n / (F.col("with_term_") * F.col("with_entity_")))
    scored = pairs.select("term_", (pmi / F.log(n / F.col("with_entity_"))).alias("disclosure_")).filter(F.col("disclosure_") >= DISCLOSURE)
    return stage_table(scored.groupBy("term_").agg(F.max("disclosure_").alias("disclosure_")), "revealing")


def _added(facts: DataFrame, texts: DataFrame) -> DataFrame:
    """Staged spans of revealing terms by text: sha_, added_, copies_ (rows of that text). Each distinct text is searched once.

    A second Bloom filter, of the texts that hold a term, keeps all others where they are.
    """
    terms = revealing_terms(facts, texts).select("term_")
    few = terms.count() <= BROADCAST_TERMS
    words = _distinct_texts(texts, "sha_", "hash_", "text_").select("sha_", "hash_", F.explode(F.array_distinct(_terms(F.col("text_")))).alias("term_"))
    held = words.join(F.broadcast(terms) if few else terms, "term_", "left_semi").groupBy("sha_").agg(F.first("hash_").alias("hash_"), F.array_sort(F.collect_set("term_")).alias("terms_"))
    mine = stage_table(held.join(facts.groupBy("sha_").agg(F.count(F.lit(1)).alias("copies_")), "sha_"), "mine")
    hashes, rows = mine.select("hash_"), mine.count()
    blocks, size = repeated_filter(hashes.union(hashes), rows)  # every position is set twice, so the filter is one of members
    near = flag_repeated(texts.withColumnRenamed("maybe_", "copied_"), blocks, size, rows).filter("maybe_").drop("maybe_").withColumnRenamed("copied_", "maybe_")
    chosen = _distinct_texts(near, "sha_", "text_").join(mine.drop("hash_"), "sha_")
    return stage_table(chosen.select("sha_", "copies_", term_spans(F.col("text_"), F.col("terms_")).alias("added_")), "added")


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    facts, texts = _spotted(docs, doc_id, text)
    added = _added(facts, texts)
    joined = join_on_group(facts.select("id_", "sha_", "line_", "spans_"), added, "sha_", "copies_", ["added_"], facts.count(), ["line_"])
    every = F.array_sort(F.concat("spans_", F.coalesce("added_", F.array().cast(facts.schema["spans_"].dataType))))
    counts = [_count("spans_", kind).alias(f"n_{kind}") for kind in KINDS]
    return joined.select(F.col("id_").alias("doc_id"), *counts, F.sha2(joined_spans(F.col("spans_")), 256).alias("base_sha256"), joined_spans(every).alias("spans"))


def sanitise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with base spans and revealing terms replaced by their kind in brackets; other columns stay as they are."""
    facts, texts = _spotted(docs, doc_id, text)
    added = _added(facts, texts)
    rows = packed(docs).withColumn("text_", text_of(text)).withColumn("sha_", digest(F.col("text_")))
    joined = join_on_group(rows, added, "sha_", "copies_", ["added_"], facts.count(), [ROW])
    spans = F.array_sort(F.concat(base_spans(F.col("text_")), F.coalesce("added_", F.array().cast(facts.schema["spans_"].dataType))))
    walked = F.aggregate(
        "spans_", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(F.struct(
            s["end"].alias("at"), F.concat(acc["out"], F.substring(F.col("text_"), acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out"))),
    )
    done = joined.withColumn("spans_", spans).withColumn("walk_", walked)
    clean = F.concat(F.col("walk_.out"), F.expr("substring(text_, walk_.at + 1)"))
    columns = [F.when(field_of(name).isNull(), F.lit(None)).otherwise(clean).alias(name) if name == text else field_of(name).alias(name) for name in docs.columns]
    return done.select(*columns)


def op5_pii(spark, sf_dir) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents", "doc_id", "text"))
