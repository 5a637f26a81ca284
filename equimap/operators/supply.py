"""Seats of schools from the buildings in their service areas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import polygons as P

#: Floors where none are known and their range, seats that stand for none (by stage, and service areas below one
#: square kilometre or above), what few seats are multiplied by, and the most seats.
FLOORS, LEAST_FLOORS, MOST_FLOORS = 3.0, 1.0, 30.0
PRIMARY_SMALL, PRIMARY_LARGE, MIDDLE_SMALL, MIDDLE_LARGE = 1080.0, 1620.0, 1200.0, 1800.0
FEW, FACTOR, MOST = 50.0, 3.0, 10000.0


def floor_space(area: Column, floors: Column) -> Column:
    return area * F.least(F.lit(MOST_FLOORS), F.greatest(F.lit(LEAST_FLOORS), F.coalesce(floors, F.lit(FLOORS))))


def with_fallback(seats: Column, primary: Column, small: Column) -> Column:
    """Seats where there are any: few ones count more and very many are cut; else a stage's usual number."""
    usual = F.when(primary & small, PRIMARY_SMALL).when(primary, PRIMARY_LARGE).when(small, MIDDLE_SMALL).otherwise(MIDDLE_LARGE)
    return F.when(seats <= 0, usual).when(seats < FEW, seats * FACTOR).when(seats > MOST, MOST).otherwise(seats)


def supply(schools: DataFrame, service: DataFrame, buildings: DataFrame, pixels: DataFrame, size: float, pixel: float) -> DataFrame:
    """school, scheme, supply of schools (school, primary, per_seat).

    Scheme A: the floor space of all buildings (trapezoids with `building` and `floor_space`) that a service area (trapezoids with
    `school`) overlaps, each as a whole, by the space of a seat. It is used for all schools if more than half of them have such a
    building. Else scheme B: mean building density (pixels ci, cj, value; centres inside) times the area times FLOORS, by the
    space of a seat; there service areas count as small."""
    own = buildings.select("building", "floor_space").distinct()
    met = P.overlay_areas(service, "school", buildings, "building", size).join(own, "building")
    space = met.groupBy("school").agg(F.sum("floor_space").alias("space"))
    areas = service.groupBy("school").agg(F.sum(P.area()).alias("area"))
    inside = P.pixels_in(pixels, P.pixel_spans(service, "school", pixel), "school")
    density = inside.groupBy("school").agg(F.avg("value").alias("density"))
    rows = schools.join(space, "school", "left").join(areas, "school", "left").join(density, "school", "left")
    rows = rows.withColumn("space", F.coalesce("space", F.lit(0.0))).withColumn("area", F.coalesce("area", F.lit(0.0)))
    share = rows.agg(F.avg((F.col("space") > 0).cast("double")).alias("share"))
    rows = rows.crossJoin(F.broadcast(share))  # one row
    a = F.col("share") > 0.5
    mean = F.when(F.col("density") > 0, F.col("density")).otherwise(0.0)
    seats = F.when(a, F.col("space") / F.col("per_seat")).otherwise(mean * F.col("area") * FLOORS / F.col("per_seat"))
    small = ~a | (F.col("area") < 1e6)
    return rows.select("school", F.when(a, "A").otherwise("B").alias("scheme"), with_fallback(seats, F.col("primary"), small).alias("supply"))
