"""From a raster SQL query to one lazy DataFrame plan.

Aggregates run in two steps: by raw codes and tile row, where Spark combines map-side and only codes travel; then, on that
small result, dictionaries are decoded, areas are multiplied in (a pixel's area depends on its tile row only), and rows
are grouped again by meaning. AVG carries sums and counts through both.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import QueryParseError
from ..functions.expressions import to_column
from ..functions.geodesy import tile_area_ha
from ..operators.cube import clean, co_register, fill_missing, tiles_of
from ..operators.grids import TILE_PIXELS, Grid
from ..operators.masks import Shape, boxes, distinct_shapes, mask, mask_features
from ..sources.files import pixels_inside, read_layer, touched
from .catalog import RESERVED, Catalog, Layer
from .rsql import Comparison, Logical, Query, Selector, parse


@dataclass
class Engine:
    """pixels: one table (prow, pcol, layer columns), or a table (prow, pcol, <layer>) for each layer, or None to read the
    files that the catalogue's layers name.

    Where a layer has no data in a whole tile (of a layer's table) or no file, its pixels there are 0 with `missing` 'zero',
    and null, as pixels that a table lacks within a tile, with 'nodata'.
    """

    spark: SparkSession
    catalog: Catalog
    pixels: DataFrame | dict[str, DataFrame] | None = None
    default_grid: str = "10/40000"
    missing: str = "zero"

    def __post_init__(self) -> None:
        if self.missing not in ("zero", "nodata"):
            raise ValueError("missing must be 'zero' or 'nodata'")

    def analyse(self, query: str | Query) -> tuple[Query, list[str], Grid]:
        """The parsed query, the source layers it reads, and their grid; raises QueryParseError."""
        q = parse(query) if isinstance(query, str) else query
        named = [s.layer for s in q.selectors] + [g.layer for g in q.groups] + q.where_layers() + [a.layer for a in q.aggregates if a.name != "count"]
        if self.catalog.has(q.base):
            named.append(q.base)
        sources = list(dict.fromkeys(s for n in named if (s := self.catalog.source_of(n))))
        grids = {self.catalog.get(s).grid for s in sources}
        if len(grids) > 1:
            raise QueryParseError(f"layers must share a grid, not {sorted(grids)}")
        self._check(q)
        return q, sources, Grid.of(grids.pop() if grids else self.default_grid)

    def _check(self, q: Query) -> None:
        groups = {(g.layer, g.function) for g in q.groups}
        for g in q.groups:
            if g.layer in RESERVED:
                raise QueryParseError(f"GROUP BY {g.layer} is not supported")
            if self.catalog.get(g.layer).nan:
                raise QueryParseError(f"GROUP BY {g.layer}: a layer of floats can't be grouped by")
        if q.groups and not q.aggregates:
            raise QueryParseError("GROUP BY needs an aggregate")
        if q.aggregates:
            for s in q.selectors:
                if (s.layer, s.function) not in groups:
                    raise QueryParseError(f"{s.layer} is neither grouped by nor aggregated")
        for s in [*q.selectors, *q.groups]:
            if s.function == "isoweek" and "date" not in s.layer:
                raise QueryParseError(f"isoweek needs a date layer, not {s.layer}")
        names = self.names(q)
        if len(set(names)) < len(names):
            raise QueryParseError(f"ambiguous result columns {names}; use AS")
        known = set(names) | {n for s in [*q.groups, *q.selectors] for n in self._outputs(s)} | {a.layer if a.name != "count" else "count" for a in q.aggregates}
        for o in q.orders:
            if o.column not in known:
                raise QueryParseError(f"ORDER BY {o.column}: no such result column")

    def _outputs(self, s: Selector) -> list[str]:
        if s.function == "isoweek":
            return [s.layer.replace("date", "year"), s.layer.replace("date", "isoweek")]
        return [s.layer]

    def _named(self, s: Selector) -> list[str]:
        """Result names of a selector; an alias of isoweek names the week, beside a year."""
        if not s.alias:
            return self._outputs(s)
        return [s.layer.replace("date", "year"), s.alias] if s.function else [s.alias]

    def names(self, q: Query) -> list[str]:
        """Result columns in order: group keys first, then aggregates; or the selected columns."""
        aggregates = [a.alias or ("count" if a.name == "count" else a.layer) for a in q.aggregates]
        if not q.aggregates:
            return [n for s in q.selectors for n in self._named(s)]
        alias = {(s.layer, s.function): s for s in q.selectors}
        return [n for g in q.groups for n in self._named(alias.get((g.layer, g.function), g))] + aggregates

    def column(self, name: str, grid: Grid) -> Column:
        """A layer's raw values over the pixel table."""
        layer = self.catalog.get(name)
        if name in RESERVED and name not in self.catalog.layers:
            return {"area__ha": self.area(grid), "latitude": grid.centre(F.col("prow")), "longitude": grid.centre(F.col("pcol"))}[name]
        if not layer.derived:
            return F.col(f"`{name}`")
        return to_column(layer.calc, A=F.col(f"`{layer.source}`"), area=self.area(grid))

    def area(self, grid: Grid, tile: Column | None = None) -> Column:
        return tile_area_ha(grid.tile(F.col("prow")) if tile is None else tile, grid.width, TILE_PIXELS)

    def predicate(self, p: Comparison | Logical, grid: Grid) -> Column:
        if isinstance(p, Comparison):
            return self.catalog.get(p.layer).compare(self.column(p.layer, grid), p.operator, p.value)
        out = self.predicate(p.parts[0], grid)
        for q in p.parts[1:]:
            out = out & self.predicate(q, grid) if p.operator == "and" else out | self.predicate(q, grid)
        return out

    def table(self, q: Query, sources: list[str], features: DataFrame, grid: Grid) -> DataFrame:
        """The pixels with the layers that the query reads, NaN as null."""
        base = self.catalog.source_of(q.base) if self.catalog.has(q.base) else None
        if self.pixels is None:
            tiles = touched(features, grid)
            if not sources:
                return pixels_inside(features, grid, tiles)
            return clean(co_register({s: read_layer(self.catalog.get(s), features, tiles, self.missing) for s in sources}, base), sources)
        if isinstance(self.pixels, dict):
            for s in sources:
                if s not in self.pixels:
                    raise QueryParseError(f"no table for layer {s}")
            if not sources:
                raise QueryParseError("a query without layers needs one pixel table")
            df = clean(co_register({s: self.pixels[s] for s in sources}, base), sources)
            if self.missing == "zero" and len(sources) > 1:
                for s in sources:
                    df = fill_missing(df, s, F.broadcast(tiles_of(self.pixels[s])), 0)
            return df
        lacking = [s for s in sources if s not in self.pixels.columns]
        if lacking:
            raise QueryParseError(f"no column for layers {lacking}")
        return clean(self.pixels, sources)

    def filtered(self, df: DataFrame, q: Query, grid: Grid) -> DataFrame:
        """Base mask, WHERE and group masks as one conjunction on raw codes."""
        masks: list[Layer] = [self.catalog.get(q.base)] if self.catalog.has(q.base) else []
        masks += [layer for g in q.groups if not (layer := self.catalog.get(g.layer)).covers_default] if q.aggregates else []
        for layer in masks:
            has = layer.has_data(self.column(layer.name, grid))
            df = df if has is None else df.where(has)
        return df.where(self.predicate(q.where, grid)) if q.where else df

    def sql(self, query: str | Query, geometry: dict | str) -> DataFrame:
        """The result of a query over the pixels inside a geometry; lazy, but for the names of files to read."""
        q, sources, grid = self.analyse(query)
        shape = Shape.of(geometry)
        one = self.spark.createDataFrame([("0", shape.text)], "fid string, geometry string")
        return self.finish(self.evaluate(mask(self.table(q, sources, one, grid), shape, grid), q, grid, []), q, [])

    def sql_many(self, query: str | Query, features: DataFrame) -> DataFrame:
        """Results for every feature (fid, geometry) at once, with fid first.

        Every feature gets what sql() gives for it alone: its own order and LIMIT, and without GROUP BY a row of 0 (null for
        AVG) where it has no pixels. A feature with an unusable geometry gets no rows; see operators.batch for its status.
        Features of one geometry text share its evaluation.
        """
        q = parse(query) if isinstance(query, str) else query
        keyed, shapes = distinct_shapes(features)
        out = keyed.join(self.sql_shapes(q, shapes).withColumnRenamed("fid", "_shape"), "_shape").drop("_shape")
        return self.ordered(out, q, ["fid"])

    def sql_shapes(self, query: str | Query, shapes: DataFrame) -> DataFrame:
        """sql_many without order between rows, for features (fid, geometry) that each have their own fid and geometry."""
        q, sources, grid = self.analyse(query)
        inside = mask_features(self.table(q, sources, shapes, grid), shapes, grid)
        out = self.evaluate(inside, q, grid, ["fid"])
        if q.aggregates and not q.groups:
            blank = {n: F.coalesce(F.col(f"`{n}`"), F.lit(0).cast(out.schema[n].dataType)) for n, a in zip(self.names(q), q.aggregates, strict=True) if a.name != "avg"}
            out = boxes(shapes).select("fid").join(out, "fid", "left").withColumns(blank)
        return self.limited(out, q, ["fid"])

    def evaluate(self, df: DataFrame, q: Query, grid: Grid, by: list[str]) -> DataFrame:
        df = self.filtered(df, q, grid)
        if not q.aggregates:
            return self._rows(df, q, grid, by)
        keys = [self.column(g.layer, grid).alias(f"_k{i}") for i, g in enumerate(q.groups)]
        tile = grid.tile(F.col("prow")).alias("_tile")
        values = {a.layer: f"_v{i}" for i, a in enumerate(q.aggregates) if a.name != "count" and a.layer != "area__ha"}
        slim = df.select(*by, *keys, tile, *(self.column(layer, grid).cast("double").alias(c) for layer, c in values.items()))
        parts = [F.count(F.lit(1)).alias("_n")] + [f(c).alias(f"{c}{s}") for c in values.values() for f, s in ((F.sum, "s"), (F.count, "c"))]
        coded = slim.groupBy(*by, *(f"_k{i}" for i in range(len(q.groups))), "_tile").agg(*parts)
        decoded = []
        for i, g in enumerate(q.groups):
            value = self.catalog.get(g.layer).decode(F.col(f"_k{i}"))
            decoded += self._weeks(value, [f"_d{i}y", f"_d{i}w"]) if g.function else [value.alias(f"_d{i}")]
        coded = coded.select(*by, *decoded, "_n", (F.col("_n") * self.area(grid, F.col("_tile"))).alias("_area"), *(f"{c}{s}" for c in values.values() for s in "sc"))
        group = [c for c in coded.columns if c.startswith("_d")]
        for c in group:  # a code without a meaning has no group
            coded = coded.where(F.col(c).isNotNull())
        final = []
        for i, a in enumerate(q.aggregates):
            if a.name == "count":
                out = F.coalesce(F.sum("_n"), F.lit(0)).cast("long")
            else:
                total, n = ("_area", "_n") if a.layer == "area__ha" else (f"{values[a.layer]}s", f"{values[a.layer]}c")
                out = F.coalesce(F.sum(total), F.lit(0.0)) if a.name == "sum" else F.try_divide(F.sum(total), F.sum(n))
            final.append(out.alias(f"_a{i}"))
        out = coded.groupBy(*by, *group).agg(*final)
        return out.toDF(*by, *self.names(q))

    def _weeks(self, text: Column, names: list[str]) -> list[Column]:
        day = F.to_date(text)
        return [F.extract(F.lit("YEAROFWEEK"), day).cast("long").alias(names[0]), F.weekofyear(day).cast("long").alias(names[1])]

    def _rows(self, df: DataFrame, q: Query, grid: Grid, by: list[str]) -> DataFrame:
        out: list[Column] = []
        for s in q.selectors:
            raw, layer = self.column(s.layer, grid), self.catalog.get(s.layer)
            value = raw if s.layer in RESERVED and s.layer not in self.catalog.layers else layer.decode(raw)
            names = self._named(s)
            out += self._weeks(value, names) if s.function else [value.alias(names[0])]
        return df.select(*by, *out)

    def finish(self, df: DataFrame, q: Query, by: list[str]) -> DataFrame:
        """Order and limit; a limit holds for each key of `by`."""
        df = self.ordered(self.limited(df, q, by), q, by)
        return df if by or not q.limit else df.limit(q.limit)

    def order(self, q: Query) -> list[Column]:
        """Orders name result columns before or after AS. Groups are in key order by default."""
        names = self.names(q)
        plain = [n for g in (q.groups if q.aggregates else q.selectors) for n in self._outputs(g)]
        plain += [a.layer if a.name != "count" else "count" for a in q.aggregates]
        at = dict(zip(plain, names, strict=False)) | {n: n for n in names}
        orders = [(at.get(o.column, o.column), o.ascending) for o in q.orders]
        if not orders and q.groups and q.aggregates:
            orders = [(n, True) for n in names[: len(names) - len(q.aggregates)]]
        return [F.col(f"`{c}`").asc_nulls_last() if up else F.col(f"`{c}`").desc_nulls_last() for c, up in orders]

    def limited(self, df: DataFrame, q: Query, by: list[str]) -> DataFrame:
        if not by or not q.limit:
            return df
        # Spark keeps the first rows of a key before it shuffles
        place = F.row_number().over(Window.partitionBy(*by).orderBy(*self.order(q) or [F.lit(0)]))
        return df.withColumn("_place", place).where(F.col("_place") <= q.limit).drop("_place")

    def ordered(self, df: DataFrame, q: Query, by: list[str]) -> DataFrame:
        order = self.order(q)
        return df.orderBy(*by, *order) if order else df
