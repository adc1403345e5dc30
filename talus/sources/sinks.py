"""Text sinks: each returns lines in order, ready for `write.text`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def xyz_lines(pts: DataFrame, order: str = "point_id", delimiter: str = " ", decimals: int = 3, extra: tuple[str, ...] = ()) -> DataFrame:
    """ord, value: one line of global coordinates for each point."""
    cols = [F.format_string(f"%.{decimals}f", c) for c in "xyz"] + [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in extra]
    return pts.select(F.col(order).alias("ord"), F.concat_ws(delimiter, *cols).alias("value"))


def ascii_grid_lines(cells: DataFrame, cols: int, rows: int, cell: float, west: float = 0.0, south: float = 0.0, nodata: float = -9999.0) -> DataFrame:
    """ord, value: header and rows from north to south, absent cells as nodata."""
    spark = cells.sparkSession
    head = [f"ncols {cols}", f"nrows {rows}", f"xllcorner {west:.3f}", f"yllcorner {south:.3f}", f"cellsize {cell:.3f}", f"NODATA_value {nodata:g}"]
    header = spark.createDataFrame([(i - len(head), t) for i, t in enumerate(head)], "ord long, value string")
    frame = spark.range(rows).select(F.col("id").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias("col"))
    full = frame.join(cells.select("row", "col", "z"), ["row", "col"], "left")
    text = F.when(F.col("z").isNull() | F.isnan("z"), f"{nodata:g}").otherwise(F.format_string("%.3f", "z"))
    body = full.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("col", text.alias("t")))).alias("c"))
    return header.unionByName(body.select((F.lit(rows - 1) - F.col("row")).cast("long").alias("ord"), F.concat_ws(" ", F.col("c.t")).alias("value")))


def obj_lines(pts: DataFrame, order: str = "point_id", decimals: int = 3) -> DataFrame:
    return pts.select(F.col(order).alias("ord"), F.concat(F.lit("v "), F.concat_ws(" ", *[F.format_string(f"%.{decimals}f", c) for c in "xyz"])).alias("value"))


def geojson_points(pts: DataFrame, order: str = "point_id") -> DataFrame:
    """ord, value: a GeoJSON feature for each point."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array("x", "y", "z").alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(F.col(order).alias("id")).alias("properties"))
    return pts.select(F.col(order).alias("ord"), F.to_json(feature).alias("value"))


def _pairs(text: str, joined: str, closed: bool = False):
    """The vertices of xs and ys in turn, each by the format; of a closed line without its repeated end if `closed`."""
    at = F.transform(F.arrays_zip("xs", "ys"), lambda v: F.format_string(text, v["xs"], v["ys"]))
    if closed:
        at = F.when(F.col("closed"), F.slice(at, 1, F.size(at) - 1)).otherwise(at)
    return F.concat_ws(joined, at)


def geojson_lines(lines: DataFrame, decimals: int = 3) -> DataFrame:
    """level, value: a GeoJSON LineString feature for each line(level, closed, xs, ys); coordinates in the given frame."""
    at = _pairs(f"[%.{decimals}f,%.{decimals}f]", ",")
    head = F.format_string('{"type":"Feature","properties":{"level":%.3f,"closed":%b},"geometry":{"type":"LineString","coordinates":[', F.col("level").cast("double"), F.col("closed"))
    return lines.select("level", F.concat(head, at, F.lit("]}}")).alias("value"))


def dxf_lines(lines: DataFrame, layer: str = "CONTOURS", decimals: int = 3) -> DataFrame:
    """level, value: a LWPOLYLINE entity for each line, group codes and values on lines of their own."""
    n = F.when(F.col("closed"), F.size("xs") - 1).otherwise(F.size("xs"))
    head = F.format_string(f"0\nLWPOLYLINE\n8\n{layer}\n38\n%.{decimals}f\n90\n%d\n70\n%d\n", F.col("level").cast("double"), n, F.col("closed").cast("int"))
    return lines.select("level", F.concat(head, _pairs(f"10\n%.{decimals}f\n20\n%.{decimals}f", "\n", True)).alias("value"))


def dxf_document(entities: list[str]) -> str:
    return "0\nSECTION\n2\nENTITIES\n" + "".join(e + "\n" for e in entities) + "0\nENDSEC\n0\nEOF\n"


def svg_lines(lines: DataFrame, north: float, decimals: int = 2) -> DataFrame:
    """level, value: a path for each line; y runs downwards from `north`."""
    down = lines.withColumn("ys", F.transform("ys", lambda y: F.lit(north) - y))
    path = F.concat(F.lit('<path d="M'), _pairs(f"%.{decimals}f %.{decimals}f", " L", True), F.when(F.col("closed"), "Z").otherwise(""), F.lit('"/>'))
    return down.select("level", path.alias("value"))


def kml_lines(lines: DataFrame, decimals: int = 7) -> DataFrame:
    """level, value: a Placemark for each line of longitudes and latitudes."""
    at = _pairs(f"%.{decimals}f,%.{decimals}f", " ")
    return lines.select("level", F.concat(F.format_string("<Placemark><name>%.2f</name><LineString><coordinates>", F.col("level").cast("double")), at, F.lit("</coordinates></LineString></Placemark>")).alias("value"))


def csv_lines(df: DataFrame, cols: list[str], decimals: int = 3) -> DataFrame:
    """value: comma-separated cells in the order of cols; numbers with fixed decimals, text quoted where it must be, nulls empty."""
    kinds = dict(df.dtypes)

    def cell(c: str):
        if kinds[c] in ("double", "float"):
            return F.coalesce(F.when(~F.isnan(c), F.format_string(f"%.{decimals}f", c)), F.lit(""))
        t = F.coalesce(F.col(c).cast("string"), F.lit(""))
        return F.when(t.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)

    return df.select(F.concat_ws(",", *[cell(c) for c in cols]).alias("value"))


def ply_lines(pts: DataFrame, order: str = "point_id", decimals: int = 3) -> DataFrame:
    """ord, value: header and one line for each point of an ASCII PLY file; colours r, g, b go along if there are any."""
    colours = [c for c in ("r", "g", "b") if c in pts.columns]
    colours = colours if len(colours) == 3 else []
    n = F.concat(F.lit("element vertex "), F.count("*").cast("string"))
    props = [f"property double {c}" for c in "xyz"] + [f"property uchar {c}" for c in ("red", "green", "blue")][: len(colours)]
    head = pts.agg(F.array(F.lit("ply"), F.lit("format ascii 1.0"), n, *[F.lit(p) for p in props], F.lit("end_header")).alias("h"))
    size = 4 + len(props)
    header = head.select(F.posexplode("h").alias("i", "value")).select((F.col("i") - size).cast("long").alias("ord"), "value")
    cols = [F.format_string(f"%.{decimals}f", c) for c in "xyz"] + [F.coalesce(F.col(c), F.lit(0)).cast("int").cast("string") for c in colours]
    return header.unionByName(pts.select(F.col(order).cast("long").alias("ord"), F.concat_ws(" ", *cols).alias("value")))
