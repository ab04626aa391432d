"""One track with most rows: operators cut it into blocks of time, with results as over the whole track."""

from pyspark.sql import functions as F

from tracklens.operators import selection as sel

HOUR = 3_600_000_000


def _rows(spark, n=600):
    # Nine tenths of the rows belong to one track, over many hours, some hours empty; two short tracks, one with one row.
    made = [("hot", (i * 7 + (i // 50) * 13) * 200_000_000, i, float(i % 17)) for i in range(n)]
    made += [("cold", i * HOUR * 5, 10_000 + i, float(i)) for i in range(5)] + [("one", HOUR, 20_000, 1.0)]
    return made, spark.createDataFrame(made, "t string, us long, id long, v double").repartition(5)


def test_deltas_and_next_rows_cross_blocks(spark):
    made, df = _rows(spark)
    before, after = {}, {}
    for track in ("hot", "cold", "one"):
        line = sorted(r[1:] for r in made if r[0] == track)
        for a, b in zip(line, line[1:]):
            before[b[1]], after[a[1]] = a, b[1]
    got = {r.id: r for r in sel.track_deltas(df, ["t"], "us", ["v"]).collect()}
    assert len(got) == len(made)
    for _, us, key, v in made:
        a = before.get(key)
        assert (got[key].track_dt_s, got[key].track_dv) == ((None, None) if a is None else ((us - a[0]) / 1e6, v - a[2]))
    assert {r.id: r.n for r in sel.next_row(df, ["t"], ["us"], "id", "n").collect()} == {r[2]: after.get(r[2]) for r in made}


def test_spans_do_not_depend_on_blocks(spark):
    _, df = _rows(spark, 201)
    def spans(**block):
        return sorted(map(tuple, sel.masked_spans(df, ["t"], ["us"], 7, "s", ["t"], **block).select("id", "span", "masked").collect()))

    assert spans() == spans(block_us=10 ** 15)
    hot = {i: s for i, s, _ in spans() if i < 10_000}
    assert hot == {i: i // 4 - (i == 200) for i in range(201)}


def test_sequential_splits_do_not_depend_on_blocks(spark):
    files = spark.range(103).select(F.lit("A").alias("g"), F.col("id").alias("n"))
    got = {r.n: r.split for r in sel.sequential_splits(files, "g", ["n"], 10).collect()}
    assert got == {i: "train" if i < 61 else "validation" if i < 82 else "test" for i in range(103)}
