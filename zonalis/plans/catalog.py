"""Layer catalogue: sources, derived and reserved layers, their dictionaries and NoData."""

from __future__ import annotations

import math
import operator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryParseError
from ..functions.expressions import to_column, to_scalars

RESERVED = ("area__ha", "latitude", "longitude")
COMPARE = {"<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge, "=": operator.eq, "!=": operator.ne}


@dataclass(frozen=True)
class RasterTable:
    rows: tuple[tuple[int, Any], ...]
    default: Any = None

    @property
    def whole(self) -> bool:
        return all(isinstance(m, int) for _, m in self.rows) and (not self.default or isinstance(self.default, int))

    @property
    def rises(self) -> bool:
        """Whether meanings rise with codes."""
        rows = sorted(self.rows, key=lambda r: r[0])
        return all(isinstance(a[1], str) == isinstance(b[1], str) and a[1] < b[1] for a, b in zip(rows, rows[1:], strict=False))

    def decode(self, code: Column) -> Column:
        kind = "int" if self.whole else "string"
        out = F.lit(self.default if self.whole or not self.default else str(self.default)).cast(kind) if self.default else F.lit(None).cast(kind)
        if not self.rows:
            return out
        pairs = [F.lit(x) for c, m in dict(self.rows).items() for x in (int(c), m if self.whole else str(m))]
        return F.coalesce(F.element_at(F.create_map(*pairs), code.cast("int")), out)


@dataclass(frozen=True)
class Layer:
    """A source layer; with source and calc a derived one."""

    name: str
    no_data: int | float | None = 0
    table: RasterTable | None = None
    decode_expression: str = ""
    encode_expression: str = ""
    uri: str = ""
    tile_scheme: str = "nw"
    grid: str = "10/40000"
    source: str = ""
    calc: str = ""

    @property
    def derived(self) -> bool:
        return bool(self.source)

    @property
    def nan(self) -> bool:
        return isinstance(self.no_data, float) and math.isnan(self.no_data)

    @property
    def covers_default(self) -> bool:
        """Whether 0 is a value of its own for GROUP BY."""
        return self.table is not None and (bool(self.table.default) or any(c == 0 for c, _ in self.table.rows))

    def has_data(self, column: Column) -> Column | None:
        """The NoData predicate; none where the layer has no NoData."""
        if self.no_data is None:
            return None
        return column.isNotNull() if self.nan else column != F.lit(self.no_data)

    def decode(self, column: Column) -> Column:
        if self.table:
            return self.table.decode(column)
        return to_column(self.decode_expression, A=column) if self.decode_expression else column

    def compare(self, column: Column, op: str, value: Any) -> Column:
        """A predicate on raw codes for a comparison with a meaning.

        Over a dictionary `=` holds for the codes of the meaning, those unlisted included where it is the default, and `!=`
        for all others. Order comparisons are on raw codes where meanings rise with codes and there is no default, so an
        unlisted code stands where its number does; else on meanings, and an unlisted code without a meaning has no order.
        """
        if self.table:
            return self._compare_meanings(self.table, column, op, value)
        codes = to_scalars(self.encode_expression, value) if self.encode_expression else [value]
        if op in ("=", "!="):
            same = column.isin(codes) if len(codes) > 1 else column == F.lit(codes[0])
            return same if op == "=" else F.coalesce(~same, F.lit(True))
        out = None
        for c in codes:
            one = COMPARE[op](column, F.lit(c))
            out = one if out is None else out | one
        return out

    def _compare_meanings(self, table: RasterTable, column: Column, op: str, value: Any) -> Column:
        listed = [c for c, _ in table.rows]
        if op in ("=", "!="):
            codes = [c for c, m in table.rows if m == value and isinstance(m, str) == isinstance(value, str)]
            if table.default and value == table.default:
                same = ~column.isin([c for c in listed if c not in codes])
            elif codes:
                same = column.isin(codes)
            else:
                raise ValueError(f"value {value!r} is not in the encoding of {self.name}")
            return same if op == "=" else F.coalesce(~same, F.lit(True))
        if any(isinstance(m, str) != isinstance(value, str) for m in [m for _, m in table.rows] + ([table.default] if table.default else [])):
            raise ValueError(f"value {value!r} can't be compared with the encoding of {self.name}")
        holds = [c for c, m in table.rows if COMPARE[op](m, value)]
        if not table.default and table.rises:
            if op in ("<", "<="):
                rest = [c for c in listed if c not in holds]
                return column < F.lit(min(rest)) if rest else column.isNotNull()
            return column >= F.lit(min(holds)) if holds else F.lit(False)
        if table.default and COMPARE[op](table.default, value):  # every unlisted code has the default meaning
            return ~column.isin([c for c in listed if c not in holds]) if len(holds) < len(listed) else column.isNotNull()
        return column.isin(holds) if holds else F.lit(False)


@dataclass
class Catalog:
    layers: dict[str, Layer] = field(default_factory=dict)

    @classmethod
    def of(cls, environment: list[dict]) -> Catalog:
        """From the JSON form of an environment."""
        out: dict[str, Layer] = {}
        for spec in environment:
            if not isinstance(spec, dict) or not spec.get("name"):
                raise QueryParseError("a layer needs a name")
            t = spec.get("raster_table")
            table = RasterTable(tuple((int(r["value"]), r["meaning"]) for r in t["rows"]), t.get("default_meaning")) if t else None
            no_data = spec.get("no_data", 0)
            no_data = math.nan if isinstance(no_data, str) and no_data.lower() == "nan" else no_data
            if bool(spec.get("source_layer")) != bool(spec.get("calc")):
                raise QueryParseError(f"derived layer {spec['name']} needs source_layer and calc")
            layer = Layer(spec["name"], no_data, table, spec.get("decode_expression") or "", spec.get("encode_expression") or "", spec.get("source_uri", ""), spec.get("tile_scheme", "nw"), spec.get("grid", "10/40000"), spec.get("source_layer", ""), spec.get("calc", ""))
            out.setdefault(layer.name, layer)
        return cls(out)

    def dump(self) -> list[dict]:
        """The JSON form; a NaN NoData is the string 'nan'."""
        out = []
        for x in self.layers.values():
            spec: dict[str, Any] = {"name": x.name, "no_data": "nan" if x.nan else x.no_data, "decode_expression": x.decode_expression, "encode_expression": x.encode_expression}
            if x.table:
                spec["raster_table"] = {"rows": [{"value": c, "meaning": m} for c, m in x.table.rows], "default_meaning": x.table.default}
            spec |= {"source_layer": x.source, "calc": x.calc} if x.derived else {"source_uri": x.uri, "tile_scheme": x.tile_scheme, "grid": x.grid}
            out.append(spec)
        return out

    def get(self, name: str) -> Layer:
        if name in self.layers:
            return self.layers[name]
        if name in RESERVED:
            return Layer(name, None)
        if name.endswith("__ha"):
            stem = name.replace("__ha", "")
            for layer in self.layers.values():
                if layer.name.endswith(f"__{stem}") or layer.name.startswith(f"{stem}__"):
                    return Layer(name, source=layer.name, calc="np.where(A > 0, area, 0)")
        raise QueryParseError(f"Layer {name} is invalid")

    def has(self, name: str) -> bool:
        try:
            self.get(name)
        except QueryParseError:
            return False
        return True

    def source_of(self, name: str) -> str | None:
        """The source layer that must be read for a layer; none for reserved ones."""
        layer = self.get(name)
        if not layer.derived:
            return None if name in RESERVED and name not in self.layers else name
        inner = self.get(layer.source)
        if inner.derived or layer.source in RESERVED:
            raise QueryParseError(f"{name} must derive from a source layer")
        return layer.source
