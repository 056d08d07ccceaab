"""Expressions over JSON values (variants) whose fields may be missing or null at any level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from civiclink.functions.text import let, trim_ws

# Where a place record keeps its state, in order of preference.
STATE_PATHS = (
    "$.microrregiao.mesorregiao.UF.sigla",
    "$['regiao-imediata']['regiao-intermediaria'].UF.sigla",
    "$.regiao_imediata.regiao_intermediaria.UF.sigla",
    "$.UF.sigla",
    "$.uf.sigla",
    "$.siglaUF",
)
# Keys under which search answers nest their items.
CONTAINERS = ("items", "resultados", "results", "data", "content", "relatorios")
ITEM_KEYS = ("id", "titulo")


def parse(c: Column | str) -> Column:
    """Parsed JSON text; null when it is not JSON."""
    return F.try_parse_json(c)


def kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BIGINT ... of a value; null for SQL null."""
    return F.regexp_extract(F.schema_of_variant(v), r"^\w+", 0)


def _is(v: Column, kind_of: str) -> Column:
    """By the outermost level alone: a schema would be worked out for all that the value holds."""
    return F.when(v.isNotNull(), F.try_variant_get(v, "$", kind_of).isNotNull())


def is_object(v: Column) -> Column:
    return _is(v, "map<string,variant>")


def is_array(v: Column) -> Column:
    return _is(v, "array<variant>")


def at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def as_text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def members(v: Column) -> Column:
    """Members of a JSON array as array<variant>, an empty array for anything else."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))


def place_state(v: Column) -> Column:
    """Two-letter state of a place record from the first path that holds one, else null."""
    def one(path: str) -> Column:
        found = at(v, path)
        text = trim_ws(F.upper(as_text(found)))
        return F.when((kind(found) == "STRING") & (F.length(text) == 2), text)

    return F.coalesce(*[one(p) for p in STATE_PATHS])


def filled_text(v: Column, *keys: str) -> Column:
    """Text of the first key that is neither null, empty, zero nor false."""
    def one(key: str) -> Column:
        found = at(v, f"$.{key}")
        text = as_text(found)
        zero = F.coalesce(text.try_cast("double") == 0, F.lit(False)) & (kind(found) != "STRING")
        empty = F.is_variant_null(found) | (text == "") | (text == "false") & (kind(found) == "BOOLEAN") | zero
        return F.when(~empty, text)

    return F.coalesce(*[one(k) for k in keys])


def nesting(payload: Column) -> Column:
    """Upper bound of the nesting depth of a JSON text: its opening brackets."""
    return F.length(F.regexp_replace(payload, r"[^\[{]", ""))


def nested_items(root: Column, depth: Column) -> Column:
    """Item objects of a nested search answer as array<variant>, in reading order.

    Objects inside a list count as items. An object outside a list is opened along the container
    keys, and is an item itself, behind what it holds, when it has an id or a title. Each node carries its
    path; the paths sort as the answer reads. `depth` is an upper bound of the nesting; levels without
    nodes cost nothing.
    """
    node = "array<struct<path:string,v:variant>>"
    none = F.array().cast(node)
    one = lambda path, v: F.struct(path.alias("path"), v.alias("v"))

    def open_level(acc: Column, _: Column) -> Column:
        return F.when(F.size(acc["nodes"]) == 0, acc).otherwise(let(parts(acc["nodes"]), lambda p: merge(acc, p)))

    def listed(n: Column) -> Column:
        return F.transform(members(n["v"]), lambda m, i: one(F.concat(n["path"], F.lpad(i.cast("string"), 10, "0")), m))

    def parts(nodes: Column) -> Column:
        """Objects among the nodes, and the members of the arrays among them."""
        inside = F.flatten(F.transform(nodes, listed))
        return F.struct(F.filter(nodes, lambda n: is_object(n["v"])).alias("objects"), inside.alias("inside"))

    def held(n: Column) -> Column:
        each = [one(F.concat(n["path"], F.lit(f"{i}")), at(n["v"], f"$.{k}")) for i, k in enumerate(CONTAINERS)]
        return F.filter(F.array(*each), lambda x: x["v"].isNotNull())

    def merge(acc: Column, p: Column) -> Column:
        objects, inside = p["objects"], p["inside"]
        named = F.filter(objects, lambda n: reduce(lambda a, b: a | b, [at(n["v"], f"$.{k}").isNotNull() for k in ITEM_KEYS]))
        itself = F.transform(named, lambda n: one(F.concat(n["path"], F.lit("~")), n["v"]))
        items, lists = F.filter(inside, lambda n: is_object(n["v"])), F.filter(inside, lambda n: is_array(n["v"]))
        deeper = F.concat(lists, F.flatten(F.transform(objects, held)))
        return F.struct(F.concat(acc["found"], items, itself).alias("found"), deeper.alias("nodes"))

    first = F.filter(F.array(one(F.lit(""), root)), lambda n: n["v"].isNotNull())
    start = F.struct(none.alias("found"), first.alias("nodes"))
    levels = F.sequence(F.lit(0), F.coalesce(depth, F.lit(0)))
    found = F.aggregate(levels, start, open_level, lambda acc: acc["found"])
    by_path = F.array_sort(found, lambda a, b: F.when(a["path"] < b["path"], -1).when(a["path"] > b["path"], 1).otherwise(0))
    return F.transform(by_path, lambda n: n["v"])
