"""Column builders for text, documents and numbers as they are shown or exported."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import col

#: Letters of Latin blocks that decompose into one base letter and marks, and their base letters.
_BASES = {c: d[0] for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if len(d := unicodedata.normalize("NFD", c)) > 1 and all(unicodedata.combining(x) for x in d[1:])}


def without_diacritics(x: Column | str) -> Column:
    """Latin letters without their marks; marks that stand by themselves go too."""
    plain = F.translate(col(x), "".join(_BASES), "".join(_BASES.values()))
    return F.regexp_replace(plain, r"\p{Mn}+", "")


def aliased(x: Column | str, names: dict[str, str], default: Column) -> Column:
    """The alias of a name, or the default."""
    table = F.create_map(*(F.lit(v) for pair in names.items() for v in pair))
    return F.coalesce(F.try_element_at(table, col(x)), default)


def compact(x: Column) -> tuple[Column, Column]:
    """A number in crore, lakh or thousands, and the unit's name."""
    units = (("crore", 1e7), ("lakh", 1e5), ("thousand", 1e3))
    amount, unit = F.when(F.lit(False), x), F.when(F.lit(False), F.lit(""))
    for name, size in units:
        amount, unit = amount.when(x >= size, x / size), unit.when(x >= size, name)
    return amount.otherwise(x), unit.otherwise("")


def layer(x: Column | str, layers: list[tuple[str, tuple[str, ...]]], default: str) -> Column:
    """The first layer one of whose marks the lower-cased text holds."""
    out = F.when(F.lit(False), F.lit(default))
    for name, marks in layers:
        for mark in marks:
            out = out.when(F.lower(col(x)).contains(mark), name)
    return out.otherwise(default)


_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'


def _object(depth: int) -> str:
    """A pattern of balanced objects of up to that depth. Its parts begin with different characters and give nothing back, so it takes one pass."""
    inner = f"{_STRING}|{_object(depth - 1)}" if depth > 1 else _STRING
    return r'\{[^{}"]*+(?:(?:' + inner + r')[^{}"]*+)*+\}'


def first_object(x: Column | str) -> Column:
    """The balanced {...} that begins at a text's first brace, at any depth; braces within strings do not count. Null if there is none or it is never closed.

    Objects of up to six levels are found by a pattern. For the rest, the text is cut behind each brace that is outside strings, and the depth is counted over these pieces.
    """
    shallow = F.nullif(F.regexp_extract(col(x), r"(?s)\A[^{]*+(" + _object(6) + ")", 1), F.lit(""))
    rest = F.substring(col(x), F.locate("{", col(x)), F.length(col(x)))
    pieces = F.regexp_extract_all(rest, F.lit(r'(?s)\G[^{}"]*+(?:' + _STRING + r'[^{}"]*+)*+[{}]'), F.lit(0))
    zero = F.lit(0)

    def step(s: Column, piece: Column) -> Column:
        at, depth = s["at"] + F.length(piece), s["depth"] + F.when(F.endswith(piece, F.lit("{")), 1).otherwise(-1)
        return F.struct(at.alias("at"), depth.alias("depth"), F.when((s["end"] == 0) & (depth == 0), at).otherwise(s["end"]).alias("end"))

    end = F.aggregate(pieces, F.struct(zero.alias("at"), zero.alias("depth"), zero.alias("end")), step, lambda s: s["end"])
    deep = F.when(F.contains(col(x), F.lit("{")) & (end > 0), F.substring(rest, F.lit(1), end))
    return F.coalesce(shallow, deep)


def answered_object(x: Column | str) -> Column:
    """The JSON object of a model's answer: of its first fence's inside if it begins with a fence (with or without the word json), else of its prose."""
    said = F.trim(F.translate(col(x), "\t\r\n", "   "))
    inside = F.when(F.startswith(said, F.lit("```")), F.split(F.trim(col(x)), "```")[1]).otherwise(col(x))
    return first_object(F.regexp_replace(inside, r"^\s*(?i:json)", ""))


def error_line(x: Column | str, most: int) -> Column:
    """A text for one cell of a status table: line feeds and bars replaced, cut at `most` characters."""
    return F.substring(F.translate(col(x), "\n|", " /"), 1, most)


def csv_cell(x: Column | str) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(col(x), F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(col(x).rlike('[",\r\n]'), quoted).otherwise(F.coalesce(col(x), F.lit("")))


def csv_line(*cells: Column | str) -> Column:
    """Cells as one CSV line: quoted where they need it, quotes doubled, null as nothing."""
    return F.concat_ws(",", *(csv_cell(c) for c in cells))


def json_number(x: Column | str, digits: int) -> Column:
    """A rounded number, null for NaN and the infinities, which JSON lacks."""
    v = col(x)
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), F.round(v, digits))


def sorted_json(m: Column | str) -> Column:
    """A map as JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(col(m)))))


def interpolated(t: Column, low: tuple[int, ...], high: tuple[int, ...]) -> list[Column]:
    """Whole numbers between two ends, component by component."""
    return [F.round(F.lit(float(a)) + t * float(b - a)).cast("long") for a, b in zip(low, high)]


def bracketed(x: Column) -> Column:
    """The whole numbers that stand in square brackets."""
    return F.transform(F.regexp_extract_all(x, F.lit(r"\[\s*(\d+)\s*\]"), F.lit(1)), lambda n: n.cast("long"))


def flattened(shape: T.StructType, name: str) -> list[Column]:
    """One level of a nested document: plain fields as they are, maps and arrays by their sizes."""
    out = []
    for field in shape:
        value = F.col(f"{name}.{field.name}")
        out.append((F.size(value).cast("long") if isinstance(field.dataType, (T.MapType, T.ArrayType)) else value).alias(field.name))
    return out


def numeric_leaves(shape: T.StructType, name: str) -> list[Column]:
    """Every number of a nested document, as doubles."""
    out = []
    for field in shape:
        path = f"{name}.{field.name}"
        if isinstance(field.dataType, T.StructType):
            out += numeric_leaves(field.dataType, path)
        elif isinstance(field.dataType, T.NumericType):
            out.append(F.col(path).cast("double"))
    return out
