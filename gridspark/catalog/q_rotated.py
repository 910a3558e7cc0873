"""Rotated poles: cells, regridding between axes that do not align, and complete grid descriptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.catalog.fixtures import GRID_E, table, view_e
from gridspark.catalog.registry import query, r, rd
from gridspark.columns import number_of
from gridspark.operators import grid, regrid
from gridspark.operators.grid import Grid
from gridspark.session import tasks_for
from gridspark.sources import griddes

# a rotated grid across the fields E, some cells beyond them
POLE = (39.25, -162.0)
ROTATED = Grid(6, 5, -8.4, 0.55, -2.4, 0.7, pole=POLE)


def geographic_sql(lat: str, lon: str, pole_lat: str, pole_lon: str) -> tuple[str, str]:
    """Latitude and longitude of rotated coordinates."""
    la, lo, top = f"radians({lat})", f"radians({lon})", f"radians({pole_lat})"
    raw = f"({pole_lon} + degrees(atan2(-cos({la}) * sin({lo}), cos({top}) * sin({la}) - sin({top}) * cos({la}) * cos({lo}))))"
    return (f"degrees(asin(sin({top}) * sin({la}) + cos({top}) * cos({la}) * cos({lo})))", f"({raw} - 360 * round({raw} / 360))")


def cells_sql(g: Grid, y: str = "ty", x: str = "tx") -> str:
    return f"""SELECT CAST(b.y AS INT) AS {y}, CAST(a.x AS INT) AS {x}, {g.y0} + {g.dy} * b.y AS cy, {g.x0} + {g.dx} * a.x AS cx
  FROM range({g.ny}) b(y), range({g.nx}) a(x)"""


SIZE, KEY = "p_size", "p_partkey"
LAT, LON = geographic_sql(f"(-{SIZE} / 5 - 0.5 * y)", f"({SIZE} / 10 + 0.25 * x)", f"(30 + {KEY} % 50)", f"({KEY} % 360 - 180)")


@query("grid_cells_rotated", f"""
SELECT p_partkey, CAST(y AS INT) AS iy, CAST(x AS INT) AS ix, {r('-p_size / 5 - 0.5 * y')} AS lat, {r('p_size / 10 + 0.25 * x')} AS lon,
  CASE WHEN p_partkey % 4 = 0 THEN {r('-p_size / 5 - 0.5 * y')} ELSE {r(LAT)} END AS geo_lat,
  CASE WHEN p_partkey % 4 = 0 THEN {r('p_size / 10 + 0.25 * x')} ELSE {r(LON)} END AS geo_lon
FROM part, range(2) a(y), range(3) b(x)""")
def grid_cells_rotated(spark, sf_dir):
    size, key = F.col("p_size"), F.col("p_partkey")
    rotated = key % 4 != 0
    grids = table(spark, sf_dir, "part").select(
        "p_partkey", F.lit(3).alias("xsize"), F.lit(2).alias("ysize"), (size / 10).cast("double").alias("xfirst"), F.lit(0.25).alias("xinc"),
        (-(size / 5)).cast("double").alias("yfirst"), F.lit(-0.5).alias("yinc"),
        F.when(rotated, 30.0 + key % 50).alias("grid_north_pole_latitude"), F.when(rotated, key % 360 - 180.0).alias("grid_north_pole_longitude"))
    return grid.expand_cells(grids).select("p_partkey", "iy", "ix", *[rd(c).alias(c) for c in ("lat", "lon", "geo_lat", "geo_lon")])


CENTRE = geographic_sql("cy", "cx", str(POLE[0]), f"({POLE[1]})")


@query("remap_bilinear_rotated", f"""
WITH C AS (SELECT ty, tx, ({CENTRE[1]} - {GRID_E.x0}) / {GRID_E.dx} AS fx, ({CENTRE[0]} - {GRID_E.y0}) / {GRID_E.dy} AS fy
  FROM ({cells_sql(ROTATED)})),
N AS (SELECT *, CAST(greatest(0, least({GRID_E.nx - 2}, floor(fx))) AS INT) AS i0, CAST(greatest(0, least({GRID_E.ny - 2}, floor(fy))) AS INT) AS j0 FROM C),
W AS (SELECT ty, tx, i0 + i AS ix, j0 + j AS iy, (CASE WHEN i = 1 THEN fx - i0 ELSE 1 - (fx - i0) END)
    * (CASE WHEN j = 1 THEN fy - j0 ELSE 1 - (fy - j0) END) AS w FROM N, range(2) a(i), range(2) b(j))
SELECT e.t, w.ty AS iy, w.tx AS ix, {r('sum(w.w * e.fcst)')} AS fcst, {r('sum(w.w * e.ref_)')} AS ref_
FROM E e JOIN W w ON w.iy = e.iy AND w.ix = e.ix GROUP BY e.t, w.ty, w.tx""")
def remap_bilinear_rotated(spark, sf_dir):
    df = regrid.remap_bilinear(view_e(spark, sf_dir), GRID_E, ROTATED, ["fcst", "ref_"], ["t"])
    return df.select("t", "iy", "ix", rd("fcst").alias("fcst"), rd("ref_").alias("ref_"))


AROUND = "(SELECT unnest([0, 1, 2, 3]) AS k, unnest([-0.5, 0.5, 0.5, -0.5]) AS hx, unnest([-0.5, -0.5, 0.5, 0.5]) AS hy)"


def corners_sql(g: Grid) -> str:
    """Corners of the cells as points in space."""
    cy, cx = f"(cy + hy * {g.dy})", f"(cx + hx * {g.dx})"
    lat, lon = (cy, cx) if g.pole is None else geographic_sql(cy, cx, str(g.pole[0]), f"({g.pole[1]})")
    return f"""SELECT ty, tx, k, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z
  FROM (SELECT ty, tx, k, {lat} AS lat, {lon} AS lon FROM ({cells_sql(g)}), {AROUND})"""


def clipped_sql(src: Grid, dst: Grid) -> str:
    """Common areas of all pairs of cells as CTEs; ``A`` has ``iy, ix, ty, tx, w``.

    The border of a common area is made of the parts of the edges of each cell that lie inside the other; every part spans a
    triangle with the middle of the target cell.
    """
    def inside(edges: str, planes: str) -> str:
        f0 = "(h.ex * (e.py - h.py) - h.ey * (e.px - h.px))"
        f1 = "(h.ex * e.ey - h.ey * e.ex)"
        return f"""SELECT e.iy, e.ix, e.ty, e.tx, e.px, e.py, e.ex, e.ey, greatest(0, max(CASE WHEN {f1} > 0 THEN -{f0} / {f1} END)) AS t0,
    least(1, min(CASE WHEN {f1} < 0 THEN -{f0} / {f1} END)) AS t1, bool_and({f1} <> 0 OR {f0} >= 0) AS ok
    FROM {edges} e JOIN {planes} h ON h.iy = e.iy AND h.ix = e.ix AND h.ty = e.ty AND h.tx = e.tx GROUP BY e.k, e.iy, e.ix, e.ty, e.tx, e.px, e.py, e.ex, e.ey"""

    def edges(points: str) -> str:
        return f"""SELECT p.iy, p.ix, p.ty, p.tx, p.k, p.px, p.py, q.px - p.px AS ex, q.py - p.py AS ey FROM {points} p JOIN {points} q
    ON q.iy = p.iy AND q.ix = p.ix AND q.ty = p.ty AND q.tx = p.tx AND q.k = (p.k + 1) % 4"""

    def flat(point: str) -> str:
        depth = f"({point}.x * m.x + {point}.y * m.y + {point}.z * m.z)"
        east = f"({point}.y * m.x - {point}.x * m.y) / m.h"
        north = f"({point}.z * m.h - m.z * ({point}.x * m.x + {point}.y * m.y) / m.h)"
        return f"{east} / {depth} AS px, {north} / {depth} AS py"

    return f"""SC AS ({corners_sql(src)}), TC AS ({corners_sql(dst)}),
M AS (SELECT ty, tx, x / n AS x, y / n AS y, z / n AS z, sqrt(x * x + y * y) / n AS h FROM (
  SELECT *, sqrt(x * x + y * y + z * z) AS n FROM (SELECT ty, tx, sum(x) AS x, sum(y) AS y, sum(z) AS z FROM TC GROUP BY ty, tx))),
SP AS MATERIALIZED (SELECT s.ty AS iy, s.tx AS ix, m.ty, m.tx, s.k, {flat('s')} FROM SC s, M m),
TP AS MATERIALIZED (SELECT g.iy, g.ix, m.ty, m.tx, t.k, {flat('t')} FROM TC t JOIN M m ON m.ty = t.ty AND m.tx = t.tx,
  (SELECT DISTINCT ty AS iy, tx AS ix FROM SC) g),
SE AS MATERIALIZED ({edges('SP')}), TE AS MATERIALIZED ({edges('TP')}),
PARTS AS (SELECT *, px + t0 * ex AS x0, py + t0 * ey AS y0, px + t1 * ex AS x1, py + t1 * ey AS y1 FROM (
  {inside('SE', 'TE')} UNION ALL {inside('TE', 'SE')}) WHERE ok AND t0 < t1),
A AS (SELECT iy, ix, ty, tx, sum(2 * atan2(x0 * y1 - y0 * x1, sqrt(1 + x0 * x0 + y0 * y0) * sqrt(1 + x1 * x1 + y1 * y1)
  + sqrt(1 + x0 * x0 + y0 * y0) + sqrt(1 + x1 * x1 + y1 * y1) + x0 * x1 + y0 * y1 + 1)) AS w FROM PARTS GROUP BY ALL)"""


@query("remap_conservative_rotated", f"""
WITH {clipped_sql(GRID_E, ROTATED)},
S AS (SELECT t, iy, ix, CASE WHEN (t + iy) % 7 = 0 AND ix > 4 THEN NULL ELSE fcst END AS fcst, ref_ FROM E),
R AS (SELECT s.t, a.ty, a.tx, sum(w * fcst) / nullif(sum(w) FILTER (WHERE fcst IS NOT NULL), 0) AS fcst, sum(w * ref_) / sum(w) AS ref_
  FROM S s JOIN A a ON a.iy = s.iy AND a.ix = s.ix GROUP BY s.t, a.ty, a.tx),
C AS (SELECT t, ty, tx FROM (SELECT DISTINCT t FROM E), ({cells_sql(ROTATED)}))
SELECT C.t, C.ty AS iy, C.tx AS ix, {r('R.fcst')} AS fcst, {r('R.ref_')} AS ref_ FROM C LEFT JOIN R ON R.t = C.t AND R.ty = C.ty AND R.tx = C.tx""")
def remap_conservative_rotated(spark, sf_dir):
    gap = (F.col("t") + F.col("iy")) % 7 == 0
    e = view_e(spark, sf_dir).withColumn("fcst", F.when(~(gap & (F.col("ix") > 4)), F.col("fcst")))
    df = regrid.remap_conservative(e, GRID_E, ROTATED, ["fcst", "ref_"], ["t"])
    return df.select("t", "iy", "ix", rd("fcst").alias("fcst"), rd("ref_").alias("ref_"))


# a description like that of a rotated model grid: key, text or number in SQL, and how coarse and padded grids change it
LINES = (
    ("gridtype", "'projection'", None), ("gridsize", "nx * ny", ("cnx * cny", "bnx * bny")), ("xsize", "nx", ("cnx", "bnx")), ("ysize", "ny", ("cny", "bny")),
    ("xname", "'rlon'", None), ("xlongname", "'\"longitude in rotated grid\"'", None), ("yname", "'rlat'", None),
    ("xfirst", "x0", ("x0 - 2.5 * 0.055", "x0 - 4 * 0.055")), ("xinc", "0.055", ("0.22", "0.055")),
    ("yfirst", "y0", ("y0 + 2.5 * 0.11", "y0 + 4 * 0.11")), ("yinc", "-0.11", ("-0.44", "-0.11")),
    ("grid_mapping", "'rotated_pole'", None), ("grid_mapping_name", "'rotated_latitude_longitude'", None),
    ("grid_north_pole_latitude", "39.25", None), ("grid_north_pole_longitude", "-162.0", None))


# descriptions that a task completes
DESCRIPTIONS = 50_000


def _lines_sql() -> str:
    rows = []
    for at, (key, value, changed) in enumerate(LINES):
        for kind, other in zip(("source", "coarse", "base"), (value, *(changed or (value, value)))):
            text = other.startswith("'")
            rows.append(f"SELECT p_partkey, '{kind}' AS kind, CAST({at} AS INT) AS line, '{key}' AS key, "
                        f"{other if text else 'NULL'} AS text, {'CAST(NULL AS DOUBLE)' if text else r(other)} AS num FROM G")
    return " UNION ALL ".join(rows)


@query("griddes_complete", f"""
WITH P AS (SELECT p_partkey, 4 * (1 + p_size % 4) AS nx, 4 * (1 + p_partkey % 3) AS ny, -p_size / 10 AS x0, p_size / 5 AS y0 FROM part),
G AS (SELECT *, nx // 4 + 2 AS cnx, ny // 4 + 2 AS cny, nx + 8 AS bnx, ny + 8 AS bny FROM P)
{_lines_sql()}""")
def griddes_complete(spark, sf_dir):
    size, key = F.col("p_size"), F.col("p_partkey")
    nx, ny = (4 * (1 + size % 4)).cast("int"), (4 * (1 + key % 3)).cast("int")
    values = {"gridsize": nx * ny, "xsize": nx, "ysize": ny, "xfirst": -(size / 10), "yfirst": size / 5, "xinc": F.lit("0.055"),
              "yinc": F.lit("-0.11"), "grid_north_pole_latitude": F.lit("39.25"), "grid_north_pole_longitude": F.lit("-162.")}
    lines = [F.lit("#\n# a grid\n#")] + [F.concat(F.lit(f"{k:<9} = "), values[k].cast("string") if k in values else F.lit(v.strip("'")), F.lit(" "))
                                          for k, v, _ in LINES]
    part = table(spark, sf_dir, "part")
    # a row of a few bytes becomes three whole descriptions, so rows are dealt out, not bytes of files
    texts = part.select("p_partkey", "p_size").repartition(tasks_for(part, DESCRIPTIONS)).select("p_partkey", F.concat_ws("\n", *lines).alias("value"))
    # through the text once more, as a file would have it
    again = griddes.parse_texts(texts).select("p_partkey", griddes.description_text(F.col("entries")).alias("value"))
    made = griddes.with_coarse(griddes.parse_texts(again), 4)
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("of")) for k, c in (
        ("source", "entries"), ("coarse", "coarse"), ("base", "base"))]))
    rows = made.select("p_partkey", kinds.alias("k")).select("p_partkey", "k.kind", F.posexplode("k.of").alias("line", "key", "text"))
    read = rows.withColumn("num", number_of(F.col("text")))
    return read.select("p_partkey", "kind", "line", "key", F.when(F.col("num").isNull(), F.col("text")).alias("text"), rd("num").alias("num"))
