"""State runs against a plain loop, and the number of times their input is read."""

import random

import pytest
from pyspark.sql import functions as F

from tracklens.operators import duplicates as D

COLUMNS = "airport_id string, aircraft_id string, timestamp_us long, place_us long, source_file_id string, lat double, lon double, altitude double, speed double, heading double, age double"


def given(n):
    draw = random.Random(n)
    for i in range(n):
        yield ("AP", f"A{draw.randrange(3)}", draw.randrange(12), i, draw.choice(["S0", "S1", None]), float(draw.randrange(2)), 0.0,
               draw.choice([None, 1.0]) if i % 9 == 0 else 1.0, 5.0, 0.0, draw.choice([None, -1.0, 2.0, 3.0, float("nan")]))


def by_hand(rows):
    found = []
    for key in sorted({r[:2] for r in rows}):
        runs = []
        for row in sorted((r for r in rows if r[:2] == key), key=lambda r: r[2:4]):
            if runs and runs[-1][-1][5:10] == row[5:10]:
                runs[-1].append(row)
            else:
                runs.append([row])
        for at, run in enumerate(runs):
            ages = [r[10] for r in run if r[10] is not None and r[10] == r[10]]
            later = runs[at + 1][0][2] if at + 1 < len(runs) else None
            relation = "end_of_aircraft" if later is None else "same_timestamp_update" if later == run[-1][2] else "later_timestamp_update"
            found.append((*key, at, len(run), run[0][2], run[-1][2], len({r[2] for r in run}), len({r[4] for r in run}) > 1, len(ages),
                          ages[0] if ages else None, ages[-1] if ages else None, relation))
    return found


@pytest.mark.parametrize("width", [1, 3, 100])
def test_runs_equal_a_plain_loop_for_any_block(spark, width):
    rows = list(given(120))
    got = D.state_runs(spark.createDataFrame(rows, COLUMNS), ["place_us"], F.floor(F.col("timestamp_us") / width)).select(
        "airport_id", "aircraft_id", "run_ordinal", "n", "first_us", "last_us", "distinct_timestamps", "crossing", "ages", "age_first", "age_last", "state_update_relationship")
    assert sorted(map(tuple, got.collect()), key=lambda r: r[:3]) == by_hand(rows)


def test_rows_are_read_twice_at_most(spark):
    """Once for the rows and once for the summary of their blocks; a successor is no reason to make all runs again."""
    rows = spark.createDataFrame(list(given(20)), COLUMNS)
    runs = D.state_runs(rows, ["place_us"], F.floor(F.col("timestamp_us") / 3)).groupBy("state_update_relationship").count()
    assert runs._jdf.queryExecution().optimizedPlan().collectLeaves().size() <= 2
