"""Secret scan: candidate strings, then a random forest that removes false positives.

Candidates are runs of 16 or more key characters, and every value of four characters or more that is assigned to a name with a credential's
word in it, up to its quote or, without quotes, to the next quote or blank; where both differ, both are listed. The forest sees length, character transitions, dictionary
coverage, path and neighbouring words, and is trained on labelled findings. Everything is built from SQL functions and Spark's own
forest.

Dictionary coverage is the share of a candidate's letter trigrams that are frequent in the corpus' ordinary words; the trigram table is counted
over all texts and is bounded by the alphabet kept (a-z: 17,576 rows), so it is broadcast.
`seed_findings` labels candidates by fixed formats where no labelled findings are at hand. The fit reads at most `SAMPLE` findings.

Nulls: a null text counts as empty and has no candidate. Repeated rows repeat their findings. Without findings of both labels every candidate
scores the share of label 1 (1 if there are none, so nothing is hidden).
"""

from pyspark.sql import Column, DataFrame, functions as F

from tracklens.llm.common import bound, digest, field_of, packed, scalar, table, text_of
from tracklens.llm.spans import matches
from tracklens.session import stage_table

KEY = "[A-Za-z0-9+/_-]"
CANDIDATE = rf"(?<!{KEY}){KEY}{{16,}}+"
SAMPLE = 20_000
TREES = 24
DEPTH = 6
THRESHOLD = 0.5
AROUND = 40
FREQUENT = 1e-4
# Words that name a credential, and formats of well-known keys and of harmless strings.
KEY_WORDS = r"(?i)(passw(or)?d|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|credential|bearer|auth)"
KNOWN_KEYS = r"^(AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_-]{20,}|xox[baprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35})$"
HARMLESS = r"^([0-9-]+|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|[A-Za-z_-]+[0-9]{1,4})$"
ASSIGNED = KEY_WORDS + r"""[\w-]*+["']?\s*+[=:]\s*+(?:"[^"\n]{4,}+"|'[^'\n]{4,}+'|[^\s"']{4,}+)"""
ASSIGNMENT = r"""^[^=:]*[=:]\s*["']?"""
FEATURES = ["length", "digits", "upper", "lower", "hex", "changes", "distinct", "covered", "slashes", "named", "assigned", "quoted", "prefix_caps"]


def _assigned(text: Column) -> Column:
    """Values assigned to names that tell of a credential, in the form of `matches`."""
    def value(m: Column) -> Column:
        def cut(head: Column) -> Column:
            inner = F.substring(m["value"], F.length(head) + 1, F.length(m["value"]) - F.length(head) - head.rlike("[\"']$").cast("int"))
            return bound(inner, lambda v: F.struct((m["start"] + F.length(head)).alias("start"), (m["start"] + F.length(head) + F.length(v)).alias("end"), v.alias("value")))

        return bound(F.regexp_extract(m["value"], ASSIGNMENT, 0), cut)

    return F.transform(matches(text, ASSIGNED), value)


def candidates(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row per candidate: id_, sha_, start_, end_, value_, before_, after_."""
    base = packed(docs).select(field_of(doc_id).alias("id_"), digest(text_of(text)).alias("sha_"), text_of(text).alias("text_"))
    near = base.select("id_", "sha_", bound(F.col("text_"), lambda t: F.transform(
        F.array_distinct(F.concat(matches(t, CANDIDATE), _assigned(t))),
        lambda m: F.struct(
            m["start"].alias("start_"), m["end"].alias("end_"), m["value"].alias("value_"),
            F.substring(t, F.greatest(m["start"] - AROUND, F.lit(0)) + 1, F.least(m["start"], F.lit(AROUND))).alias("before_"),
            F.substring(t, m["end"] + 1, F.lit(AROUND)).alias("after_"),
        ))).alias("found_"))
    return near.select("id_", "sha_", F.explode("found_").alias("f_")).select("id_", "sha_", "f_.*")


def _trigrams(word: Column) -> Column:
    letters = F.regexp_replace(F.lower(word), "[^a-z]", "")
    return F.when(F.length(letters) >= 3, bound(letters, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def dictionary(docs: DataFrame, text: str) -> DataFrame:
    """Letter trigrams of the corpus' words that reach the frequency `FREQUENT`: staged column gram_, at most 26^3 rows.

    Words are counted first, so trigrams are cut from distinct words only.
    """
    words = packed(docs).select(F.explode(F.split(F.lower(text_of(text)), "[^a-z]+")).alias("word_")).filter("length(word_) BETWEEN 3 AND 15")
    counted = words.groupBy("word_").agg(F.count(F.lit(1)).alias("n_"))
    grams = stage_table(counted.select(F.explode(_trigrams(F.col("word_"))).alias("gram_"), "n_").groupBy("gram_").agg(F.sum("n_").alias("n_")), "grams")
    total = scalar(grams.agg(F.sum("n_")))[0] or 1
    return grams.filter(F.col("n_") >= FREQUENT * total).select("gram_")


def described(found: DataFrame, grams: DataFrame) -> DataFrame:
    """Add the features of each candidate as columns f_<name>."""
    value, size = F.col("value_"), F.length("value_").cast("double")

    def share(pattern: str) -> Column:
        return F.regexp_count(value, F.lit(pattern)) / size

    known = F.broadcast(grams.agg(F.array_sort(F.collect_set("gram_")).alias("known_")))
    covered = F.size(F.filter("grams_", lambda g: F.array_contains("known_", g))) / F.greatest(F.size("grams_"), F.lit(1))
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[0-9]+", "9"), "[a-z]+", "a"), "[A-Z]+", "A")
    return found.withColumn("grams_", _trigrams(value)).join(known).select(
        *found.columns, size.alias("f_length"), share("[0-9]").alias("f_digits"), share("[A-Z]").alias("f_upper"), share("[a-z]").alias("f_lower"), share("[0-9a-fA-F]").alias("f_hex"),
        (F.length(kinds) / size).alias("f_changes"), (F.size(F.array_distinct(F.split(value, ""))) / size).alias("f_distinct"), covered.alias("f_covered"), share("[/]").alias("f_slashes"),
        F.col("before_").rlike(KEY_WORDS).cast("double").alias("f_named"), F.col("before_").rlike("[=:]\\s*[\"']?$").cast("double").alias("f_assigned"),
        (F.col("before_").rlike("[\"']$") & F.col("after_").rlike("^[\"']")).cast("double").alias("f_quoted"), value.rlike("^[A-Z]{4}").cast("double").alias("f_prefix_caps"),
    )


def seed_findings(found: DataFrame) -> DataFrame:
    """Labelled findings by fixed formats: known keys and named assignments are secrets, harmless formats are not, nor are letters only without a name; others get no label."""
    named = F.col("before_").rlike(KEY_WORDS + "[\\w-]*[\"']?\\s*[=:]\\s*[\"']?$")
    harmless = F.col("value_").rlike(HARMLESS)
    letters = F.col("value_").rlike("^[A-Za-z/_+-]+$")
    label = F.when(F.col("value_").rlike(KNOWN_KEYS) | (named & ~harmless & ~letters), F.lit(1)).when(harmless | (letters & ~named), F.lit(0))
    return found.withColumn("label_", label).filter("label_ IS NOT NULL")


def scan_secrets(docs: DataFrame, findings: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per candidate: doc_id, start, end (code points), score, is_secret.

    `findings` has doc_id, start, end and label (0 or 1) of judged candidates; without it the seed formats label them.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = stage_table(described(candidates(docs, doc_id, text), dictionary(docs, text)), "candidates")
    if findings is None:
        judged = seed_findings(rows)
    else:
        told = packed(findings).select(field_of("doc_id").alias("told_id_"), field_of("start").alias("told_start_"), field_of("end").alias("told_end_"), field_of("label").cast("int").alias("label_"))
        judged = rows.join(told.filter("label_ IN (0, 1)"), (F.col("id_") == F.col("told_id_")) & (F.col("start_") == F.col("told_start_")) & (F.col("end_") == F.col("told_end_")))
    # Copies of a text repeat its findings; each value and neighbourhood is learned from once.
    assemble = VectorAssembler(inputCols=[f"f_{n}" for n in FEATURES], outputCol="features_")
    once = judged.withColumn("draw_", F.xxhash64("value_", "before_")).groupBy("draw_").agg(F.max("label_").alias("label_"), *[F.first(f"f_{n}").alias(f"f_{n}") for n in FEATURES])
    drawn = stage_table(once.orderBy("draw_").limit(sample), "findings")
    counts = {r.label_: r.n for r in drawn.groupBy("label_").agg(F.count(F.lit(1)).alias("n")).collect()}
    columns = [F.col("id_").alias("doc_id"), F.col("start_").alias("start"), F.col("end_").alias("end"), F.col("score_").alias("score"), (F.col("score_") >= THRESHOLD).alias("is_secret")]
    if len(counts) < 2:
        share = counts.get(1, 0) / sum(counts.values()) if counts else 1.0
        return rows.withColumn("score_", F.lit(share)).select(*columns)
    forest = RandomForestClassifier(featuresCol="features_", labelCol="label_", numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="sqrt", seed=11).fit(assemble.transform(drawn).select("features_", "label_"))
    return forest.transform(assemble.transform(rows)).withColumn("score_", vector_to_array("probability")[1]).select(*columns)


def op3_secrets(spark, sf_dir) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents", "doc_id", "text"))
