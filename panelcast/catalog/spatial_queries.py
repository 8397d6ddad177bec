"""Spatial queries: the parts as raster cells, nations as square areas."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import kpi, risk, spatial
from . import fixtures as fx
from . import register, rounded
from .fixtures import r, sql


@register(sql(f"""SELECT health_area, mean, max, min, std, sum, count FROM layer LEFT JOIN (SELECT health_area, {r('avg(value)')} AS mean, max(value) AS max, min(value) AS min,
    {r('stddev_pop(value)')} AS std, sum(value) AS sum, count(value) AS count FROM located WHERE value IS NOT NULL GROUP BY 1) USING (health_area)""", "layer", "located"))
def zonal_stats(spark, sf):
    return rounded(spatial.zonal_statistics(fx.cells(spark, sf), fx.area_polygons(spark, sf), ("mean", "max", "min", "std", "sum", "count")))


@register(sql(f"SELECT health_area, {r('mean')} AS mean FROM layer LEFT JOIN (SELECT health_area, avg(value * 0.02 - 273.15) AS mean FROM located GROUP BY 1) USING (health_area)", "layer", "located"))
def zonal_temperature(spark, sf):
    return rounded(spatial.zonal_statistics(fx.cells(spark, sf), fx.area_polygons(spark, sf), scale=0.02, offset=-273.15))


@register(sql("""SELECT health_area, majority, CASE WHEN majority >= 30 THEN 'Urbain' WHEN majority = 23 THEN 'Semi-urbain' WHEN majority IS NOT NULL THEN 'Rural' END AS "Urbanisation"
    FROM layer LEFT JOIN (SELECT health_area, arg_max(value, (n, -value)) AS majority FROM (SELECT health_area, value, count(*) AS n FROM located WHERE value IS NOT NULL GROUP BY 1, 2) GROUP BY 1) USING (health_area)""", "layer", "located"))
def zonal_majority(spark, sf):
    return spatial.zonal_majority(fx.cells(spark, sf), fx.area_polygons(spark, sf))


@register(sql(f"""SELECT health_area, {r('a')} AS "Arbre_Pct", {r('b')} AS "Urbain_Pct", {r('w')} AS "Eau_Pct" FROM layer LEFT JOIN (SELECT health_area,
    avg(CASE WHEN value < 10 THEN 100.0 WHEN value IS NOT NULL THEN 0.0 END) AS a, avg(CASE WHEN value >= 40 THEN 100.0 WHEN value IS NOT NULL THEN 0.0 END) AS b,
    avg(CASE WHEN value % 10 = 0 THEN 100.0 WHEN value IS NOT NULL THEN 0.0 END) AS w FROM located GROUP BY 1) USING (health_area)""", "layer", "located"))
def zonal_share(spark, sf):
    value = F.col("value")
    return rounded(spatial.zonal_share(fx.cells(spark, sf), fx.area_polygons(spark, sf),
                                       {"Arbre_Pct": value < 10, "Urbain_Pct": value >= 40, "Eau_Pct": value % 10 == 0}))


@register(sql(f"""SELECT health_area, {r('v')} AS "Eau_Saison_Pct" FROM layer LEFT JOIN (SELECT health_area, avg(value / 12) * 100 AS v FROM located GROUP BY 1) USING (health_area)""", "layer", "located"))
def zonal_seasonality(spark, sf):
    return rounded(spatial.zonal_fraction(fx.cells(spark, sf), fx.area_polygons(spark, sf), 12, name="Eau_Saison_Pct"))


@register(sql(f"""SELECT health_area, {r('m')} AS mean, {r('s')} AS seasonality FROM layer LEFT JOIN (SELECT health_area, avg(l) AS m, avg(a) AS s FROM (
    SELECT health_area, x, y, avg(value * 1e-4) AS l, max(value * 1e-4) - min(value * 1e-4) AS a FROM located WHERE value IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1) USING (health_area)""", "layer", "located"))
def zonal_amplitude(spark, sf):
    """Copies of a grid position act as the images of the stack."""
    return rounded(spatial.seasonal_statistics(fx.cells(spark, sf), fx.area_polygons(spark, sf), scale=1e-4))


@register(sql("""SELECT health_area, CASE WHEN value > 25 THEN 'adult' ELSE 'child' END AS band, sum(value) AS population FROM located WHERE value IS NOT NULL GROUP BY 1, 2""", "located"))
def zonal_population(spark, sf):
    cells = fx.cells(spark, sf).where("value is not null").withColumn("band", F.when(F.col("value") > 25, "adult").otherwise("child"))
    return spatial.zonal_band_totals(cells, fx.area_polygons(spark, sf))


@register(sql(f"""SELECT health_area, {r('min(sqrt((longitude - (x1 + t * (x2 - x1))) ** 2 + (latitude - (y1 + t * (y2 - y1))) ** 2)) * 111')} AS distance_km FROM (
    SELECT *, coalesce(greatest(0, least(1, ((longitude - x1) * (x2 - x1) + (latitude - y1) * (y2 - y1)) / nullif((x2 - x1) ** 2 + (y2 - y1) ** 2, 0))), 0) AS t FROM sites, segments) GROUP BY 1""",
              "sites", "segments"))
def river_distance(spark, sf):
    return rounded(spatial.distance_to_lines(fx.sites(spark, sf), fx.segments(spark, sf)))


@register(sql("", "located", "layer").rstrip() + f""",
    c AS (SELECT x, y, bool_or(coalesce(value % 10 = 0, false)) AS water FROM cells GROUP BY 1, 2),
    d AS (SELECT a.x, a.y, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS d FROM c a, c b WHERE b.water GROUP BY 1, 2)
    SELECT health_area, {r('m')} AS "Dist_Eau_km" FROM layer LEFT JOIN (SELECT health_area, avg(d) * 111 AS m FROM d JOIN (SELECT DISTINCT health_area, x, y FROM located) USING (x, y) GROUP BY 1) USING (health_area)""")
def water_distance(spark, sf):
    return rounded(spatial.distance_to_water(fx.cells(spark, sf), fx.area_polygons(spark, sf), F.col("value") % 10 == 0))


def _site_polygons(spark, sf):
    sites = fx.sites(spark, sf)
    return sites.select("health_area", F.array(F.array(geo.box_ring("longitude", "latitude", F.col("longitude") + 0.125, F.col("latitude") + 0.25)))
                        .alias("polygons"))


@register(sql(f"SELECT health_area, {r('0.03125')} AS area, {r('longitude + 0.0625')} AS cx, {r('latitude + 0.125')} AS cy FROM sites", "sites"))
def area_geometry_planar(spark, sf):
    measured = _site_polygons(spark, sf).withColumn("m", geo.polygon_measures("polygons"))
    return rounded(measured.select("health_area", F.col("m.area").alias("area"), F.col("m.cx").alias("cx"), F.col("m.cy").alias("cy")))


@register()
def area_geometry(spark, sf):
    """Mollweide area and centroids of the sites."""
    return rounded(spatial.area_geometry(_site_polygons(spark, sf)))


@register(sql(f"SELECT {r('avg(latitude)')} AS latitude, {r('avg(longitude)')} AS longitude FROM sites", "sites"))
def layer_centre(spark, sf):
    return rounded(spatial.layer_centre(fx.sites(spark, sf)))


@register(sql("""SELECT latitude, longitude, CAST(sum(cases) AS DOUBLE) AS weight FROM centroids JOIN cases_weekly USING (health_area) GROUP BY health_area, latitude, longitude HAVING sum(cases) > 0""",
              "centroids", "cases_weekly"))
def heat_points(spark, sf):
    return spatial.heat_points(kpi.layer_with_cases(fx.centroids(spark, sf), fx.cases_weekly(spark, sf)), "cases")


@register(sql("", "sites", "site_cases").rstrip() + f""",
    a AS (SELECT health_area, longitude, latitude FROM sites JOIN site_cases USING (health_area) WHERE cases >= 16),
    p AS (SELECT c.health_area, a.health_area AS alert_area, sqrt((c.longitude - a.longitude) ** 2 + (c.latitude - a.latitude) ** 2) AS d FROM sites c, a)
    SELECT health_area, arg_min(alert_area, (d, alert_area)) AS alert_area, {r('min(d) * 111')} AS distance_km, min(d) * 111 <= 30 AS in_radius FROM p GROUP BY 1""")
def response_radius(spark, sf):
    alerts = risk.fixed_threshold_alerts(fx.site_cases(spark, sf), 16)
    return rounded(spatial.within_radius(fx.sites(spark, sf), alerts))


@register()
def clusters(spark, sf):
    """k-means on the centroids of the sites that report cases."""
    reporting = fx.sites(spark, sf).join(fx.site_cases(spark, sf), "health_area", "left_semi")
    return spatial.spatial_clusters(reporting, x="longitude", y="latitude")


@register(sql("""SELECT n_nationkey % 5 AS cluster, count(*) FILTER (n_nationkey % 5 = 0) AS cluster_0, count(*) FILTER (n_nationkey % 5 = 1) AS cluster_1, count(*) FILTER (n_nationkey % 5 = 2) AS cluster_2
    FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"""))
def cluster_columns(spark, sf):
    from ..operators.features import cluster_indicators
    rows = fx.table(spark, sf, "customer").select((F.col("c_nationkey") % 5).alias("spatial_cluster"))
    wide = cluster_indicators(rows, 3)
    return wide.groupBy(F.col("spatial_cluster").alias("cluster")).agg(*[F.sum(f"cluster_{i}").cast("bigint").alias(f"cluster_{i}") for i in range(3)])
