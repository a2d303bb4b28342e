"""Patches around points against a join of single places."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismframe.operators import samples as P


def joined(pixels, points, n, quarters):
    k, (x, y) = n // 2, P._TURNED[quarters]
    grid = points.selectExpr("*", f"explode(sequence(-{k}, {n - 1 - k})) as dx").selectExpr("*", f"explode(sequence(-{k}, {n - 1 - k})) as dy")
    near = grid.selectExpr("image_id", "pt", "dx", "dy", f"cast(px + {x} as int) as x", f"cast(py + {y} as int) as y").join(pixels, ["image_id", "x", "y"], "left")
    return near.select("image_id", "pt", "dx", "dy", *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in "rgba"))


@pytest.mark.parametrize("quarters", range(4))
def test_patches_hold_the_pixels_of_a_join(spark, quarters):
    rng = np.random.default_rng(quarters)
    places = np.concatenate([np.stack(np.meshgrid([1], range(70), range(40)), -1).reshape(-1, 3), rng.integers([2, -40, -40], [4, 40, 40], (1500, 3))])
    pixels = [(*map(int, p), *map(int, rng.integers(0, 256, 4))) for p in places]  # some places twice
    pixels += [(None, 1, 1, 5, 5, 5, 5), (1, None, 1, 5, 5, 5, 5), (2, 3, 3, None, 1, 2, 3), pixels[0], pixels[0]]
    pixels = spark.createDataFrame(pixels, "image_id long, x int, y int, r int, g int, b int, a int")
    points = [(int(i), k, float(a), float(b)) for k, (i, a, b) in enumerate(rng.integers([1, -45, -45], [6, 75, 45], (40, 3)))]
    points += [points[0], (1, 90, 0.0, 0.0), (1, 91, 31.6, -0.4), (1, 92, None, 3.0), (None, 93, 3.0, 3.0), (1, None, 32.0, 32.0)]
    points = spark.createDataFrame(points, "image_id long, pt long, px double, py double").withColumn("layer", F.lit("x"))
    for of in (points, points.selectExpr("image_id", "pt", "cast(px as long) as px", "cast(py as long) as py")):
        for n in (4, 15, 1):
            got, want = P.pixel_patch(pixels, of, n, quarters), joined(pixels, of, n, quarters)
            assert got.schema.simpleString() == want.schema.simpleString()
            assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_patches_are_spread_after_the_join(spark):
    pixels = spark.createDataFrame([(1, 1, 1, 1, 1, 1, 1)], "image_id long, x int, y int, r int, g int, b int, a int")
    plan = P.pixel_patch(pixels, spark.range(9).selectExpr("1L as image_id", "id as pt", "id as px", "id as py"), 15)._jdf.queryExecution().executedPlan().toString()
    above, below = plan.split("Join", 1)
    spread = re.compile(r"Generate explode.*\[d[xy]#\d+\]")
    assert len(spread.findall(above)) == 2 and not spread.search(below)
