"""Fill-in-the-middle transformation as a pyarrow.compute pipeline.

A text is cut into units: runs of letters A-Z, a-z, and single other characters. Two draws of the row's id place the cuts between
units; the three parts are put out as prefix-suffix-middle (psm) or suffix-prefix-middle (spm). A text that is empty or holds a marker, and a share of
all others, stays plain, so every output can be taken back to its text.

Inside a task each slice of rows runs whole-array steps only: units are marked and split into list arrays, flattened with
their parents' indices, numbered inside their parent, filtered by role, made lists again and joined. A slice has about `SLICE_BYTES` of text, so
memory does not grow with rows; a longer text is a slice of its own (some 60 bytes a unit while it is cut).

Units are cut on UTF-8 bytes: the mark 0xFF occurs in no UTF-8 text.

Nulls: a null text counts as empty (plain, no units). A null id draws as the empty string. Rows of equal id draw alike. An empty
table gives an empty result. A column of the caller named like one of the result's gives way to it.
"""

from pyspark.sql import Column, DataFrame, functions as F

from tracklens.llm.common import ROW, field_of, packed, table, text_of

SEED = 1
PLAIN_FROM = 90  # of 100: draws from here on stay plain
SUFFIX_FIRST = 20  # of 100: draws below put the suffix first
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SLICE_BYTES = 2 << 20
MARK = b"\xff"
UNIT = rb"([A-Za-z]+|[\x00-\x7F]|[\xC0-\xFF][\x80-\xBF]*)"
ADDED = ["n", "form", "prefix_chars", "middle_chars", "output"]


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four whole numbers below 2^32 from the SHA-256 of seed and id."""
    hexed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hexed, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _form(text: Column, third: Column, fourth: Column) -> Column:
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    plain = (text == "") | marked | (third % 100 >= PLAIN_FROM)
    return F.when(plain, F.lit("plain")).when(fourth % 100 < SUFFIX_FIRST, F.lit("spm")).otherwise(F.lit("psm"))


def _slices(texts):
    """Starts and lengths of runs of rows with about `SLICE_BYTES` of text each."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    block = (np.cumsum(sizes) - sizes) // SLICE_BYTES
    starts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    return zip(starts.tolist(), np.diff(np.append(starts, len(sizes))).tolist())


def _modulo(value, base):
    import pyarrow.compute as pc

    return pc.subtract(value, pc.multiply(pc.divide(value, base), base))


def _rebuilt(flat, keep, counts):
    """The kept units of each row, joined: lists again by their counts."""
    import pyarrow as pa
    import pyarrow.compute as pc

    offsets = pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(counts)]).cast(pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, pc.filter(flat, keep)), b"").cast(pa.string())


def transformed(texts, form, first, second):
    """Arrow arrays n, prefix_chars, middle_chars, output of equally long arrays of texts, forms and draws; no text is null."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    units = pc.split_pattern(pc.replace_substring_regex(texts.cast(pa.binary()), pattern=UNIT, replacement=MARK + rb"\1"), pattern=MARK)
    n = pc.subtract(pc.list_value_length(units).cast(pa.int64()), 1)  # every list begins with the empty part before its first mark
    each = pc.add(n, 1)
    one, two = _modulo(first, each), _modulo(second, each)
    low, high = pc.min_element_wise(one, two), pc.max_element_wise(one, two)
    flat, parent = pc.list_flatten(units), pc.list_parent_indices(units)
    ordinal = pc.subtract(pa.array(np.arange(len(flat))), pc.take(units.offsets.cast(pa.int64()), parent))
    until, after = pc.less_equal(ordinal, pc.take(low, parent)), pc.greater(ordinal, pc.take(high, parent))
    prefix = _rebuilt(flat, until, pc.add(low, 1))
    middle = _rebuilt(flat, pc.invert(pc.or_(until, after)), pc.subtract(high, low))
    suffix = _rebuilt(flat, after, pc.subtract(n, high))
    psm = pc.binary_join_element_wise(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle, "")
    spm = pc.binary_join_element_wise(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle, "")
    plain = pc.equal(form, "plain")
    output = pc.if_else(plain, texts, pc.if_else(pc.equal(form, "psm"), psm, spm))
    none = pa.scalar(None, pa.int64())
    chars = [pc.if_else(plain, none, pc.utf8_length(part).cast(pa.int64())) for part in (prefix, middle)]
    return n, *chars, output


def _cut(rows: DataFrame) -> DataFrame:
    """Replace text_, first_, second_ (the last columns after form_) by n_, prefix_chars_, middle_chars_, output_."""
    import pyarrow as pa

    from pyspark.sql import types as T

    kept = rows.schema.names[:-3]
    schema = T.StructType([rows.schema[name] for name in kept])
    schema = schema.add("n_", T.LongType()).add("prefix_chars_", T.LongType()).add("middle_chars_", T.LongType()).add("output_", T.StringType())

    def run(batches):
        for batch in batches:
            whole = pa.Table.from_batches([batch])
            for start, length in _slices(batch.column("text_")) if batch.num_rows else []:
                part = whole.slice(start, length).combine_chunks()
                form, text, first, second = (part.column(name).chunk(0) for name in ("form_", "text_", "first_", "second_"))
                out = transformed(text, form, first, second)
                yield pa.RecordBatch.from_arrays([*(part.column(name).chunk(0) for name in kept), *out], names=[*kept, "n_", "prefix_chars_", "middle_chars_", "output_"])

    return rows.mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text, from output and form alone: the parts of a marked output hold no marker."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def _filled(docs: DataFrame, doc_id: str, text: str, seed: int, kept: Column) -> DataFrame:
    """Rows kept_, form_, n_, prefix_chars_, middle_chars_, output_."""
    first, second, third, fourth = draws(field_of(doc_id), seed)
    rows = packed(docs).select(kept.alias("kept_"), _form(text_of(text), third, fourth).alias("form_"), text_of(text).alias("text_"), first.alias("first_"), second.alias("second_"))
    return _cut(rows)


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """The documents without their text column, with n (units), form, prefix_chars, middle_chars and the `output` text."""
    names = [name for name in docs.columns if name != text and name not in ADDED]
    filled = _filled(docs, doc_id, text, seed, F.struct(*[field_of(name).alias(name) for name in names]) if names else F.struct(F.lit(0)))
    return filled.select(*[F.col(f"kept_.`{name}`").alias(name) for name in names], *[F.col(f"{name}_").alias(name) for name in ADDED])


def op13_fill_middle(spark, sf_dir) -> DataFrame:
    filled = _filled(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", SEED, field_of("doc_id"))
    return filled.select(
        F.col("kept_").alias("doc_id"), F.col("n_").alias("n"), F.col("form_").alias("form"), F.col("prefix_chars_").alias("prefix_chars"), F.col("middle_chars_").alias("middle_chars"),
        F.sha2("output_", 256).alias("output_sha256"), F.sha2(restored(F.col("output_"), F.col("form_")), 256).alias("restored_sha256"),
    )


OP13_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2, CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid, coalesce(array_to_string(u[b + 1:n], ''), '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p"""
