"""Aircraft sent to tiles grow with the aircraft of a scene, not with its pairs."""

from pyspark.sql import functions as F

from tracklens.operators import features as ft
from tracklens.operators.ticks import TICK


def test_an_aircraft_of_a_crowded_scene_is_sent_four_times(spark):
    fields = [F.lit("X").alias("airport_id"), F.lit("d").alias("source_day"), F.lit(11).cast("long").alias("k"), F.concat(F.lit("A"), "id").alias("aircraft_id")]
    for n, copies in ((200, 1), (600, 3), (5_000, 4), (60_000, 4)):
        rows = spark.range(n).select(*fields, F.lit(n).cast("long").alias("n_aircraft"))
        tiles = ft.scene_tiles(rows, ["aircraft_id"])
        assert tiles.count() == copies * (copies + 1) // 2
        assert tiles.agg(F.sum(F.size("members"))).first()[0] == copies * n
        assert tiles.select(*TICK).distinct().count() == 1
    assert spark.range(1).select(F.lit(1_000_000).alias("n_aircraft")).select(ft.tile_count(None)).first()[0] == 62
