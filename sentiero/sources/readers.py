"""Readers: timetable archives, vector files, delimited text of unknown delimiter, graphs, POI exports, stored HTML."""

from __future__ import annotations

import csv
import io
import sqlite3
import struct
import tempfile
import zipfile
from collections.abc import Iterator, Sequence
from pathlib import Path
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.expressions import first_number, first_text


def gtfs_table(spark: SparkSession, archives: str, member: str, columns: Sequence[str], required: bool = True) -> DataFrame:
    """Rows of one member of timetable archives, all columns as text, "" for missing ones, with the archive as ``feed``.

    Archives are read where the tasks run, one per row of ``binaryFile``.
    """
    return gtfs_rows(spark.read.format("binaryFile").load(archives), member, columns, required)


def gtfs_rows(files: DataFrame, member: str, columns: Sequence[str], required: bool = True) -> DataFrame:
    """``gtfs_table`` of archives given as ``files`` (path, content); a missing member raises if required, else it gives
    no rows. Byte-order marks are taken off."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = {n.rpartition("/")[2]: n for n in z.namelist()}
                    if member not in names:
                        if required:
                            raise ValueError(f"{path} has no {member}")
                        continue
                    with z.open(names[member]) as f:
                        for part in pd.read_csv(f, dtype=str, keep_default_na=False, encoding="utf-8-sig", chunksize=100_000):
                            part = part.rename(columns=str.strip)
                            yield pd.DataFrame({c: part[c] if c in part else "" for c in columns} | {"feed": path}, columns=[*columns, "feed"], index=part.index)

    schema = StructType([StructField(c, StringType()) for c in (*columns, "feed")])
    return files.select("path", "content").mapInPandas(rows, schema)


def geojson_features(spark: SparkSession, path: str) -> DataFrame:
    """(ord, geometry_type, coordinates, properties): features of GeoJSON files; coordinates as JSON, properties as a map."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "features array<struct<geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>").alias("d"))
    return doc.select(F.posexplode("d.features").alias("ord", "f")).select("ord", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("properties"))


def geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    """(geometry_type, coordinates, properties) of files with one GeoJSON feature a line."""
    f = spark.read.text(path).select(F.from_json("value", "geometry struct<type:string,coordinates:string>, properties map<string,string>").alias("f"))
    return f.select(F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("properties"))


def valid_points(features: DataFrame) -> DataFrame:
    """``features`` that are points with a position, with ``x`` and ``y``; missing, empty and other geometries are left out."""
    at = F.from_json("coordinates", "array<double>")
    placed = features.where("geometry_type = 'Point'").withColumns({"x": F.get(at, F.lit(0)), "y": F.get(at, F.lit(1))})
    return placed.where(F.col("x").isNotNull() & F.col("y").isNotNull())


def enriched_features(features: DataFrame, more: DataFrame) -> DataFrame:
    """``features`` (ord, .., properties) with the properties of the row of ``more`` (ord, ..) at the same place added.

    New values win over old ones of the same name; features without a row keep theirs.
    """
    named = F.map_from_arrays(F.array(*[F.lit(c) for c in more.columns if c != "ord"]), F.array(*[F.col(c).cast("string") for c in more.columns if c != "ord"]))
    new = F.col("__new")
    joined = features.join(more.select("ord", named.alias("__new")), "ord", "left")
    kept = F.map_filter("properties", lambda k, _: ~F.array_contains(F.map_keys(new), k))
    return joined.withColumn("properties", F.when(new.isNull(), F.col("properties")).otherwise(F.map_concat(kept, new))).drop("__new")


def excel_rows(files: DataFrame, sheet: int = 1) -> DataFrame:
    """(row, cells): rows of a sheet of Excel workbooks (``files`` with content), cells as texts by column letter.

    Shared and inline texts, numbers and truth values are read as stored; empty cells are missing. Workbooks are read where
    the tasks run.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
        for b in batches:
            for content in b["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    texts: list[str] = []
                    if "xl/sharedStrings.xml" in z.namelist():
                        texts = ["".join(t.text or "" for t in si.iter(f"{ns}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{ns}si")]
                    out = []
                    for i, row in enumerate(ElementTree.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml")).iter(f"{ns}row"), 1):
                        cells = {}
                        for c in row.iter(f"{ns}c"):
                            v = c.find(f"{ns}v")
                            text = "".join(t.text or "" for t in c.iter(f"{ns}t")) if c.get("t") == "inlineStr" else None if v is None else texts[int(v.text)] if c.get("t") == "s" else v.text
                            if text is not None:
                                cells["".join(x for x in c.get("r", "") if x.isalpha())] = text
                        out.append((int(row.get("r") or i), cells))
                yield pd.DataFrame(out, columns=["row", "cells"])

    return files.select("content").mapInPandas(read, "row int, cells map<string,string>")


def rings_of(kind: Column, coordinates: Column) -> Column:
    """Outer and inner rings, array<array<struct<x,y>>>, of polygon and multipolygon coordinates given as JSON."""
    polygon = F.from_json(coordinates, "array<array<array<double>>>")
    multi = F.flatten(F.from_json(coordinates, "array<array<array<array<double>>>>"))
    return F.transform(F.when(kind == "Polygon", polygon).when(kind == "MultiPolygon", multi), lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))


def check_degrees(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """``df`` if all coordinates can be degrees, else raises: projected metres in a file meant to hold degrees."""
    b = df.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1")).first()
    if b["x0"] is not None and (b["x0"] < -180 or b["x1"] > 180 or b["y0"] < -90 or b["y1"] > 90):
        raise ValueError(f"coordinates {tuple(b)} aren't degrees")
    return df


def sniffed_csv(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Delimited text with header, quotes and line breaks in quotes; the delimiter comes from the first lines."""
    head = spark.read.text(path).limit(5).collect()
    sample = "\n".join(r["value"].lstrip("﻿") for r in head)
    try:
        sep = csv.Sniffer().sniff(sample, ",;\t|").delimiter
    except csv.Error:
        sep = ","
    reader = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("quote", '"').option("escape", '"')
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, x, y) and edges (src, dst, key, travel_time, walk_time_s, length) of GraphML files, numbers repaired."""
    return graphml_parts(spark.read.format("binaryFile").load(path))


def graphml_parts(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``graphml`` of documents given as ``files`` (content)."""

    columns = ["tag", "id", "src", "dst", "x", "y", "travel_time", "walk_time_s", "length"]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                # Elements are dropped as soon as they are read, and rows leave in small frames.
                names, seen, out, path = {}, {"node": 0, "edge": 0}, [], []
                for event, el in ElementTree.iterparse(io.BytesIO(content), ("start", "end")):
                    if event == "start":
                        path.append(el)
                        continue
                    path.pop()
                    tag = el.tag.rpartition("}")[2]
                    if tag == "key":
                        names[el.get("id")] = el.get("attr.name")
                    elif tag in seen:
                        data = {names.get(d.get("key"), d.get("key")): d.text for d in el.iter(el.tag[: -len(tag)] + "data")}
                        out.append((tag, el.get("id") or str(seen[tag]), el.get("source"), el.get("target"), *[data.get(k) for k in ("x", "y", "travel_time", "walk_time_s", "length")]))
                        seen[tag] += 1
                        path[-1].remove(el)
                        if len(out) == 20_000:
                            yield pd.DataFrame(out, columns=columns)
                            out = []
                if out:
                    yield pd.DataFrame(out, columns=columns)

    raw = files.select("content").mapInPandas(parse, "tag string, id string, src string, dst string, x string, y string, travel_time string, walk_time_s string, length string")
    number = lambda c: F.col(c).try_cast("double").alias(c)
    nodes = raw.where("tag = 'node'").select("id", number("x"), number("y"))
    edges = raw.where("tag = 'edge'").select("src", "dst", F.col("id").alias("key"), number("travel_time"), number("walk_time_s"), number("length"))
    return nodes, edges


def geopackage(spark: SparkSession, path: str, layer: str) -> DataFrame:
    """(fid, geom, attributes): rows of a layer of GeoPackage files; geometry as well-known binary, attributes as a map."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                with tempfile.NamedTemporaryFile(suffix=".gpkg") as f:  # SQLite reads files only; gone after this batch
                    f.write(content)
                    f.flush()
                    db = sqlite3.connect(f"file:{f.name}?mode=ro", uri=True)
                    column = db.execute("SELECT column_name FROM gpkg_geometry_columns WHERE table_name = ?", (layer,)).fetchone()
                    cursor = db.execute(f'SELECT * FROM "{layer.replace(chr(34), chr(34) * 2)}"')
                    names = [d[0] for d in cursor.description]
                    for part in iter(lambda: cursor.fetchmany(10_000), []):
                        out = []
                        for row in part:
                            r = dict(zip(names, row, strict=True))
                            blob = r.pop(column[0]) if column else None
                            out.append((r.get("fid"), blob[8 + (0, 32, 48, 48, 64)[(blob[3] >> 1) & 7] :] if blob else None, {k: None if v is None else str(v) for k, v in r.items()}))
                        yield pd.DataFrame(out, columns=["fid", "geom", "attributes"])
                    db.close()

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, "fid bigint, geom binary, attributes map<string,string>")


def wkb_point(blob: bytes | None) -> tuple[float, float] | None:
    """(x, y) of a point in well-known binary, None for anything else."""
    if not blob or len(blob) < 21:
        return None
    order = "<" if blob[0] == 1 else ">"
    kind, x, y = struct.unpack(order + "Idd", blob[1:21])
    return (x, y) if kind % 1000 == 1 else None


def osm_elements(raw: DataFrame, column: str = "value") -> DataFrame:
    """(type, id, name, category, lat, lon, tags) of Overpass answers: name, brand or operator; point or centre."""
    doc = raw.select(F.from_json(column, "elements array<struct<type:string,id:bigint,lat:double,lon:double,center:struct<lat:double,lon:double>,tags:map<string,string>>>").alias("d"))
    e = doc.select(F.explode("d.elements").alias("e")).select("e.*")
    keys = ("amenity", "shop", "leisure", "office", "tourism", "craft", "healthcare", "sport")
    category = F.array_join(F.filter(F.array(*[F.when(F.col("tags")[k].isNotNull(), F.concat(F.lit(f"{k}="), F.col("tags")[k])) for k in keys]), lambda c: c.isNotNull()), "; ")
    return e.select("type", "id", first_text(*[F.col("tags")[k] for k in ("name", "brand", "operator")]).alias("name"), category.alias("category"), F.coalesce("lat", "center.lat").alias("lat"), F.coalesce("lon", "center.lon").alias("lon"), "tags")


def overture_features(raw: DataFrame, column: str = "value") -> DataFrame:
    """(name, lat, lon) of place features: primary name or plain name; points only, others have no position."""
    doc = raw.select(F.from_json(column, "features array<struct<geometry:struct<type:string,coordinates:string>,properties:struct<names:struct<primary:string>,name:string>>>").alias("d"))
    f = doc.select(F.explode("d.features").alias("f"))
    at = F.when(F.col("f.geometry.type") == "Point", F.from_json("f.geometry.coordinates", "array<double>"))
    return f.select(first_text(F.col("f.properties.names.primary"), F.col("f.properties.name")).alias("name"), at[1].alias("lat"), at[0].alias("lon"))


def poi_position(lat: Column, lon: Column, wkt: Column, geometry_json: Column) -> Column:
    """Struct (lat, lon) from number columns, else well-known text, else a GeoJSON point."""
    x, y = (F.regexp_extract(wkt, r"(?i)point\s*z?\s*\(\s*(-?[\d.]+)\s+(-?[\d.]+)", i).try_cast("double") for i in (1, 2))
    at = F.from_json(F.get_json_object(geometry_json, "$.coordinates"), "array<double>")
    return F.struct(F.coalesce(first_number(lat), y, at[1]).alias("lat"), F.coalesce(first_number(lon), x, at[0]).alias("lon"))


def html_links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, posizione, url): targets of links in stored HTML in the order of their first appearance, each once."""
    urls = F.array_distinct(F.regexp_extract_all(F.col(html), F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']+)["']"""), F.lit(1)))
    return pages.select(key, F.posexplode(urls).alias("i", "url")).select(key, (F.col("i") + 1).alias("posizione"), "url")


def file_name(disposition: Column, url: Column) -> Column:
    """Name from a Content-Disposition header, else the last part of the URL's path."""
    named = F.regexp_extract(disposition, r"""(?i)filename\*?=(?:UTF-8'')?"?([^";]+)"?""", 1)
    return F.coalesce(F.nullif(F.trim(named), F.lit("")), F.nullif(F.regexp_extract(F.parse_url(url, F.lit("PATH")), r"([^/]+)$", 1), F.lit("")))


def bookings(raw: DataFrame, column: str = "value") -> DataFrame:
    """(periodo, sala_id, sala, evento): room calendars, one row per entry; rooms without entries give none."""
    doc = raw.select(F.from_json(column, "periodo string, sale map<string,struct<id:string,nome:string,dati:array<string>>>").alias("d"))
    rooms = doc.select("d.periodo", F.explode("d.sale").alias("k", "r"))
    return rooms.select("periodo", F.col("r.id").alias("sala_id"), F.col("r.nome").alias("sala"), F.explode("r.dati").alias("evento"))


def popular_times(df: DataFrame, key: str, days: str) -> DataFrame:
    """(key, giorno, ora, percentuale): nested days of hourly values as rows."""
    d = df.select(key, F.explode(days).alias("d"))
    return d.select(key, F.col("d.name").alias("giorno"), F.posexplode("d.data").alias("ora", "percentuale"))
