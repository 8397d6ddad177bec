import json

import pytest
from pyspark.sql import functions as F

from panelcast.operators.climate import climate_by_week
from panelcast.operators.spatial import area_geometry
from panelcast.sources import layers, sinks, tables


def put(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


@pytest.mark.parametrize("sep", [";", "\t", ","])
def test_case_csv(spark, tmp_path, sep):
    lines = ["Aire de Sante|Annee|Semaine|Nb cas|Deces", " Abala |2020|2020-W01|5|1", "Abala|2020|S02|x|", "Zz|2020|1|-4|0"]
    rows = tables.read_cases(spark, put(tmp_path / "c.csv", "\n".join(line.replace("|", sep) for line in lines))).collect()
    assert {(r["health_area"], r["year"], r["week_"], r["cases"], r["deaths"]) for r in rows} == {("abala", 2020, 1, 5.0, 1.0), ("abala", 2020, 2, 0.0, 0.0)}


def test_latin1_and_missing_columns(spark, tmp_path):
    path = put(tmp_path / "l.csv", "district;week;cases\nTillabéri;3;2\n", "latin-1")
    assert tables.read_cases(spark, path).first()["health_area"] == "tillabéri"
    with pytest.raises(ValueError):
        tables.read_cases(spark, put(tmp_path / "m.csv", "a,b\n1,2\n"))


def test_separator_sniffing():
    assert tables.sniff_case_separator(["a;b,c\td"]) == "\t" and tables.sniff_case_separator(["abc"]) == ","
    assert tables.sniff_linelist_separator(["a|b|c", "1|2,5|3"]) == "|" and tables.sniff_linelist_separator(["abc"]) == ","


def test_linelist_csv(spark, tmp_path):
    path = put(tmp_path / "n.csv", "Zone Santé;Date onset;Sex\nAbala;2020-01-02;M\n")
    df = tables.read_linelist(spark, path)
    assert "Date_Debut_Eruption" in df.columns and "Sexe" in df.columns and df.first()["Date_Debut_Eruption"] == "2020-01-02"


def test_vaccination_csv(spark, tmp_path):
    path = put(tmp_path / "v.csv", "﻿health_area;Taux_Vaccination\nAbala;82,5\n ABALA ;82,5\nDosso;n/a\n")
    got = {r["health_area"]: r["Taux_Vaccination"] for r in tables.read_vaccination(spark, path).collect()}
    assert got == {"abala": 82.5, "dosso": None}


def test_static_csv(spark, tmp_path):
    path = put(tmp_path / "s.csv", "name_fr,Altitude_Moy,Pente_Moy\nAbala,250.5,\nDosso,bad,3\n")
    got = {r["health_area"]: (r["Altitude_Moy"], r["Pente_Moy"]) for r in tables.read_static(spark, path).collect()}
    assert got == {"abala": (250.5, None), "dosso": (None, 3.0)}


SQUARE = [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0], [0.0, 0.0]]]


def test_layer_and_geojson_roundtrip(spark, tmp_path):
    def feature(properties, geometry):
        return {"type": "Feature", "properties": properties, "geometry": geometry}
    doc = {"type": "FeatureCollection", "features": [
        feature({"ISO3": "NER", "name_fr": " Abala "}, {"type": "Polygon", "coordinates": SQUARE}),
        feature({"iso3": " ner", "health_area": "Dosso"}, {"type": "MultiPolygon", "coordinates": [SQUARE, SQUARE]}),
        feature({"iso3": "ner"}, {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [1.0, 1.0]}, {"type": "Polygon", "coordinates": SQUARE}]}),
        feature({"iso3": "ner", "name": "pt"}, {"type": "Point", "coordinates": [3.0, 3.0]}),
        feature({"iso3": "MLI", "name": "other"}, {"type": "Polygon", "coordinates": SQUARE})]}
    path = put(tmp_path / "g.json", json.dumps(doc))
    layer = layers.read_layer(spark, path, "NER")
    parts = {r["health_area"]: len(r["polygons"]) for r in layer.collect()}
    assert parts == {"abala": 1, "dosso": 2, "aire_1": 1}
    rejected = layers.rejected_features(layers.read_features(spark, path)).collect()
    assert [r["type"] for r in rejected] == ["Point"]
    assert area_geometry(layer).where("health_area = 'abala'").first()["Superficie_km2"] == pytest.approx(12390, rel=0.01)

    out = str(tmp_path / "out")
    sinks.write_feature_collections(layer.withColumn("cases", F.lit(3)), out)
    again = layers.read_layer(spark, out)
    assert {r["health_area"]: len(r["polygons"]) for r in again.collect()} == parts
    sinks.write_geojson(layer, str(tmp_path / "lines"))
    first = json.loads(spark.read.text(str(tmp_path / "lines")).first()[0])
    assert first["geometry"]["type"] == "MultiPolygon" and "health_area" in first["properties"]
    lines = layers.read_layer(spark, str(tmp_path / "lines"))
    assert sorted(map(tuple, lines.collect())) == sorted(map(tuple, layer.collect()))
    indented = layers.read_layer(spark, put(tmp_path / "i.json", json.dumps(doc, indent=1)), "NER")
    assert sorted(map(tuple, indented.collect())) == sorted(map(tuple, layer.collect()))
    with pytest.raises(ValueError):
        layers.read_layer(spark, put(tmp_path / "n.json", '{"rows": []}'))


def test_rivers(spark, tmp_path):
    doc = {"features": [{"properties": {}, "geometry": {"type": "LineString", "coordinates": [[0.0, 0.0], [1.0, 0.0], [1.0, 2.0]]}},
                        {"properties": {}, "geometry": {"type": "MultiLineString", "coordinates": [[[5.0, 5.0], [6.0, 6.0]]]}}]}
    rows = layers.read_rivers(spark, put(tmp_path / "r.json", json.dumps(doc))).collect()
    assert {tuple(r) for r in rows} == {(0.0, 0.0, 1.0, 0.0), (1.0, 0.0, 1.0, 2.0), (5.0, 5.0, 6.0, 6.0)}


def test_climate_documents(spark, tmp_path):
    maps = {"properties": {"parameter": {"T2M": {"20200101": 20.5, "20200102": 21.5}, "PRECTOTCORR": {"20200101": 0.5}, "RH2M": {"20200102": 40.0}}}}
    arrays = {"daily": {"time": ["2020-01-01", "2020-01-02"], "temperature_2m_mean": [20.5, 21.5], "precipitation_sum": [0.5, None], "relative_humidity_2m_mean": [None, 40.0]}}
    a = layers.read_climate(spark, put(tmp_path / "a.json", json.dumps(maps, indent=1)))
    b = layers.read_climate(spark, put(tmp_path / "b.json", json.dumps(arrays)), "arrays")
    assert a.orderBy("date").collect() == b.orderBy("date").collect() and a.count() == 2
    weekly = climate_by_week(a.withColumn("health_area", F.lit("x"))).first()
    assert (weekly["temp_api"], weekly["precip_api"], weekly["nb_days"]) == (21.0, 0.5, 2)


def test_bundle(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, [1, 2])], "health_area string, n int, l array<int>")
    names = sinks.write_bundle({"cases": df, "nothing": None, "areas": df}, str(tmp_path / "bundle"), fmt="csv")
    assert names == ["cases", "areas"]
    back = spark.read.option("header", True).csv(str(tmp_path / "bundle" / "cases")).first()
    assert (back["health_area"], back["n"], back["l"]) == ("a", "1", "[1,2]")
    sinks.write_bundle({"cases": df}, str(tmp_path / "parquet"))
    assert spark.read.parquet(str(tmp_path / "parquet" / "cases")).first()["l"] == [1, 2]
