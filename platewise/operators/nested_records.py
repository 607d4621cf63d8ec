"""Deeply nested semi-structured records, shredded into flat tables that keep parent-child links.

Every JSON text becomes rows of one adjacency table: node, parent, the label under which the parent holds it, its place, its
kind and its scalar. Below labels that the caller names, a row also has the chain of labels it is reached by and its
places in their arrays, which take the place of a recursive walk. Entity tables come from the adjacency table alone: object
nodes are joined with their scalar children, which are pivoted into columns, by one aggregation of the rows that matter; all
nodes of a text lie in one partition, so that one shuffle serves the join and the search for the text's recipe.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

NODE = T.StructType().add("node", "integer").add("parent", "integer").add("label", "string").add("ord", "integer").add("kind", "string").add("scalar", "string")
_NODE_ARROW = pa.struct([("node", pa.int32()), ("parent", pa.int32()), ("label", pa.string()), ("ord", pa.int32()), ("kind", pa.string()), ("scalar", pa.string())])

#: Texts whose nodes a task holds as Python objects.
TEXTS = 500

_WHITE = re.compile(r"[ \t\n\r]*")


class Number(str):
    """A number as it is written, whatever its size and precision."""


def _broken(what: str) -> None:
    raise ValueError(f"not JSON: {what}")


_DECODER = json.JSONDecoder(parse_constant=_broken, parse_int=Number, parse_float=Number)


def _deep(text: str) -> object:
    """The value of a JSON text of any depth, by an explicit stack instead of recursion."""
    skip = lambda i: _WHITE.match(text, i).end()
    stack: list[tuple] = []
    i = skip(0)
    while True:
        c = text[i : i + 1]
        if c in ("{", "["):
            box: dict | list = {} if c == "{" else []
            i = skip(i + 1)
            if text[i : i + 1] == ("}" if c == "{" else "]"):
                value, i = box, i + 1
            else:
                key = None
                if c == "{":
                    key, i = _key(text, i, skip)
                stack.append((box, key))
                continue
        else:
            value, i = _DECODER.raw_decode(text, i)
        while True:
            i = skip(i)
            if not stack:
                return value if i == len(text) else _broken("more text")
            box, key = stack.pop()
            if key is None:
                box.append(value)
            else:
                box[key] = value
            c = text[i : i + 1]
            if c == ",":
                i = skip(i + 1)
                if key is not None:
                    key, i = _key(text, i, skip)
                stack.append((box, key))
                break
            if c != ("]" if key is None else "}"):
                _broken("no end of array or object")
            value, i = box, i + 1


def _key(text: str, i: int, skip) -> tuple[str, int]:
    key, i = _DECODER.raw_decode(text, i)
    if not isinstance(key, str) or isinstance(key, Number):
        _broken("key")
    i = skip(i)
    if text[i : i + 1] != ":":
        _broken("no colon")
    return key, skip(i + 1)


def parsed(text: str | None) -> object:
    """The value of a JSON text; ``ValueError`` for null and broken texts. Depth is unlimited."""
    if text is None:
        _broken("null")
    try:
        return _DECODER.decode(text)
    except RecursionError:
        return _deep(text)


def nodes(value: object, spelt: bool = True) -> Iterator[tuple[int, int | None, str | None, int | None, str, str | None]]:
    """Adjacency rows of a JSON value in document order, parents first.

    ``kind`` is object, array, string, number, boolean or null. With ``spelt``, a root that is a string which
    spells a JSON object or array (at any number of removes) is taken for what it spells.
    """
    count = 0
    stack: list[tuple] = [(value, None, None, None)]
    while stack:
        value, parent, label, place = stack.pop()
        if spelt and parent is None and isinstance(value, str):
            value = _spelt(value)
        me, count = count, count + 1
        if isinstance(value, dict):
            yield me, parent, label, place, "object", None
            stack += [(v, me, k, None) for k, v in reversed(value.items())]
        elif isinstance(value, list):
            yield me, parent, label, place, "array", None
            stack += [(value[k], me, None, k) for k in range(len(value) - 1, -1, -1)]
        elif isinstance(value, str):
            yield me, parent, label, place, "number" if isinstance(value, Number) else "string", value
        elif value is None:
            yield me, parent, label, place, "null", None
        else:
            yield me, parent, label, place, "boolean", json.dumps(value)


#: Columns of a node below a label of a chain: the object that holds the chain's first label, that label, how many labels further down the
#: node is, its places in the arrays of the chain from the outermost in, and those of the chain's object that holds it ('' at the first label).
CHAIN = T.StructType([*NODE.fields]).add("anchor", "integer").add("chain", "string").add("level", "integer").add("places", "string").add("within", "string")
_CHAIN_ARROW = pa.struct([*_NODE_ARROW, ("anchor", pa.int32()), ("chain", pa.string()), ("level", pa.int32()), ("places", pa.string()), ("within", pa.string())])


def chained(value: object, chains: dict[str, str | None], keep: frozenset[str]) -> Iterator[tuple]:
    """The adjacency rows of :func:`nodes` with the columns of ``CHAIN``, of nodes in chains and nodes under the labels ``keep`` alone.

    ``chains`` has the labels that begin a chain in any object and the label, if any, that goes on with it in the
    objects of the chain. A value that isn't in an array has place 0.
    """
    value = _spelt(value) if isinstance(value, str) else value
    count, none = 0, (None, None, None, None, None)
    # The last two: the chain's columns, and whether the places are of the node itself or of the array that it is.
    stack: list[tuple] = [(value, None, None, None, none)]
    while stack:
        value, parent, label, place, chain = stack.pop()
        me, count = count, count + 1
        anchor, start, level, places, within = chain
        what = type(value)
        if what is list:
            if start is not None or label in keep:
                yield me, parent, label, place, "array", None, anchor, start, level, places, within
            if start is None:
                stack += [(value[k], me, None, k, none) for k in range(len(value) - 1, -1, -1)]
            else:
                before = f"{places}." if places else ""
                stack += [(value[k], me, None, k, (anchor, start, level, f"{before}{k}", within)) for k in range(len(value) - 1, -1, -1)]
            continue
        if what is dict:
            if start is not None or label in keep:
                yield me, parent, label, place, "object", None, anchor, start, level, places, within
            further = chains[start] if start is not None else None
            for key in reversed(value):
                inner = value[key]
                if key == further:
                    below = (anchor, start, level + 1, places, places)
                elif key in chains:
                    below = (me, key, 0, "", "")
                else:
                    stack.append((inner, me, key, None, none))
                    continue
                if type(inner) is not list:
                    below = (*below[:3], f"{below[3]}.0" if below[3] else "0", below[4])
                stack.append((inner, me, key, None, below))
        elif start is not None or label in keep:
            kind = "number" if what is Number else "string" if what is str else "null" if value is None else "boolean"
            yield me, parent, label, place, kind, value if kind in ("number", "string") else None if value is None else json.dumps(value), anchor, start, level, places, within


def _spelt(text: str) -> object:
    seen: object = text
    while isinstance(seen, str) and not isinstance(seen, Number) and seen.lstrip(" \t\r\n")[:1] in ("{", "[", '"'):
        try:
            inner = parsed(seen)
        except ValueError:
            break
        seen = inner
    return text if isinstance(seen, str) or not isinstance(seen, (dict, list)) else seen


def shredded(df: DataFrame, json_column: str, key: str) -> DataFrame:
    """The adjacency table of a JSON column: ``key`` and the columns of ``NODE``.

    A key that is named like one of those comes out as ``record``. Null and broken texts give no rows. Repeated rows give repeated nodes. One Arrow pass, no shuffle.
    """
    tree = df.select(F.col(f"`{key}`").alias("__key"), _shred.asNondeterministic()(F.col(f"`{json_column}`")).alias("__nodes"))
    return tree.select(F.col("__key").alias("record" if key in NODE.names else key), F.inline("__nodes"))


@F.arrow_udf(T.ArrayType(NODE))
def _shred(texts: pa.Array) -> pa.Array:
    # Some texts at a time, as the rows of one are many small objects.
    parts = [_columns([_rows(t, nodes) for t in texts.slice(at, TEXTS).to_pylist()]) for at in range(0, len(texts), TEXTS)]
    return pa.concat_arrays(parts) if parts else _columns([])


def _rows(text: str | None, walk) -> list:
    try:
        return list(walk(parsed(text)))
    except ValueError:
        return []


def _array(values, kind: pa.DataType) -> pa.Array:
    try:
        return pa.array(values, kind)
    except UnicodeEncodeError:  # an escape spelt half of a surrogate pair
        return pa.array([v.encode("utf-8", "replace").decode() if isinstance(v, str) else v for v in values], kind)


def chained_rows(df: DataFrame, json_column: str, key: str, chains: dict[str, str | None], keep: Iterable[str] = ()) -> DataFrame:
    """The rows of :func:`shredded` that are in ``chains`` or under the labels ``keep``, with ``rec`` for the text and the columns of ``CHAIN``."""
    wanted = frozenset(keep)

    @F.arrow_udf(T.ArrayType(CHAIN))
    def shred(texts: pa.Array) -> pa.Array:
        parts = [_columns([_rows(t, lambda v: chained(v, chains, wanted)) for t in texts.slice(at, TEXTS).to_pylist()], _CHAIN_ARROW) for at in range(0, len(texts), TEXTS)]
        return pa.concat_arrays(parts) if parts else _columns([], _CHAIN_ARROW)

    # Not to be evaluated once for the filter that Catalyst infers and again for the rows.
    tree = df.select(F.col(f"`{key}`").alias("__key"), F.monotonically_increasing_id().alias("rec"), shred.asNondeterministic()(F.col(f"`{json_column}`")).alias("__nodes"))
    return tree.select("__key", "rec", F.inline("__nodes"))


def _columns(rows: list[list], struct: pa.StructType = _NODE_ARROW) -> pa.Array:
    flat = [r for one in rows for r in one]
    ends = [0]
    for one in rows:
        ends.append(ends[-1] + len(one))
    parts = list(zip(*flat)) if flat else [[] for _ in struct]
    values = pa.StructArray.from_arrays([_array(p, f.type) for p, f in zip(parts, struct)], fields=list(struct))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


#: The labels of the recipe vocabulary whose objects are entities.
STEPS, ITEMS, REVIEWS, REPLIES, TEXT = "recipeInstructions", "itemListElement", "review", "comment", "text"


def recipe_root(tree: list[tuple]) -> int | None:
    """The first object, in document order, whose ``@type`` is or includes "Recipe"."""
    kind = {n[0]: n[4] for n in tree}
    parent = {n[0]: (n[1], n[2]) for n in tree}
    found: int | None = None
    for _, up, label, _, what, scalar in tree:
        if what == "string" and scalar == "Recipe":
            if label is None and up is not None and kind[up] == "array":
                up, label = parent[up]
            if label == "@type" and up is not None and (found is None or up < found):
                found = up
    return found


def recipe_entities(tree: list[tuple]) -> Iterator[tuple[str, str, str, int]]:
    """(kind, node, parent_node, adjacency node) of the sections, steps, reviews and replies of one recipe.

    Joins each object node with its children in the adjacency rows. ``node`` is the places in the arrays from
    the outermost in; a lone value in place of an array has place 0.
    """
    root = recipe_root(tree)
    if root is None:
        return
    children: dict[int, list[tuple]] = {}
    for row in tree:
        children.setdefault(row[1], []).append(row)
    named = lambda node, label: next((c for c in children.get(node, ()) if c[2] == label), None)
    work = [(c, label, "", "", False) for label in (STEPS, REVIEWS) if (c := named(root, label))]
    while work:
        row, label, path, parent, placed = work.pop()
        node, what = row[0], row[4]
        if what == "array":
            for c in children.get(node, ()):
                work.append((c, label, f"{path}.{c[3]}" if path else str(c[3]), parent, True))
            continue
        if not placed:
            path = f"{path}.0" if path else "0"
        if label in (STEPS, ITEMS):
            if what == "object" and (inner := named(node, ITEMS)):
                yield "section", path, parent, node
                work.append((inner, ITEMS, path, path, False))
            elif what == "string" or what == "object" and named(node, TEXT):
                yield "step", path, parent, node
        elif what == "object":
            yield "review" if label == REVIEWS else "reply", path, parent, node
            if inner := named(node, REPLIES):
                work.append((inner, REPLIES, path, path, False))


#: The labels that begin a chain of entities, or say what an object is, and the labels that go on with them.
CHAINS = {STEPS: ITEMS, REVIEWS: REPLIES, "@type": None}
#: The columns of the entity tables, and the labels of the scalars that are pivoted into them, the first that there is.
FIELDS = {"text": (TEXT, "reviewBody"), "name": ("name",)}


def recipe_tables(df: DataFrame, json_column: str, key: str, fields: Iterable[str] = tuple(FIELDS)) -> DataFrame:
    """Sections, steps, reviews and replies of the recipe in each JSON text, a row each.

    Columns: ``key`` (as ``record`` if it is named like another), kind, node, parent_node, and those of text and name that
    are in ``fields``. Filter by kind for one entity's table; join
    (key, parent_node) with (key, node) of the container's kind to go up. The recipe is the first object of the text that is one. Rows
    whose text is null, broken or holds no recipe give nothing; repeated rows give repeated entities.
    """
    fields = list(fields)
    scalars = [label for f in fields for label in FIELDS[f]]
    children = {ITEMS, TEXT, *scalars}
    nodes_ = chained_rows(df, json_column, key, CHAINS, children)
    chain, kind, label, scalar = (F.col(c) for c in ("chain", "kind", "label", "scalar"))
    own = (chain == STEPS) & kind.isin("object", "string") | (chain == REVIEWS) & (kind == "object")
    typed = (chain == "@type") & (kind == "string") & (scalar == "Recipe") & ~F.col("places").contains(".")
    me = F.struct("anchor", "chain", "level", "kind", "places", "within", F.when(kind == "string", scalar).alias("said"))
    none = "struct<anchor:int,chain:string,level:int,kind:string,places:string,within:string,said:string>"
    row = lambda of, own=None, child=None, value=None, root=None: F.struct(
        of.alias("of"), (F.lit(None).cast(none) if own is None else own).alias("own"), *(F.lit(None).cast(k).alias(n) if x is None else x.alias(n) for n, x, k in (("child", child, "string"), ("value", value, "string"), ("root", root, "int")))
    )
    # A node speaks for itself, for the node that holds it, and for the object that it says the type of.
    said = F.array(F.when(own, row(F.col("node"), own=me)), F.when(label.isin(list(children)), row(F.col("parent"), child=label, value=scalar)), F.when(typed, row(F.lit(-1), root=F.col("anchor"))))
    spread = nodes_.select("__key", "rec", F.inline(said)).filter("of is not null").repartition("rec")
    has = lambda name: F.coalesce(F.bool_or(F.col("child") == name), F.lit(False))
    pivoted = [F.first(F.when(F.col("child") == name, F.col("value")), ignorenulls=True).alias(f"in_{name}") for name in dict.fromkeys(scalars)]
    joined = spread.groupBy("rec", "of").agg(F.first("__key").alias("__key"), F.first("own", ignorenulls=True).alias("own"), F.min("root").alias("root"), has(ITEMS).alias("listed"), has(TEXT).alias("told"), *pivoted)
    found = joined.withColumn("root", F.min("root").over(Window.partitionBy("rec"))).filter("own.anchor = root")
    entity = F.when(F.col("own.chain") == REVIEWS, F.when(F.col("own.level") == 0, "review").otherwise("reply"))
    entity = entity.when((F.col("own.kind") == "object") & F.col("listed"), "section").when((F.col("own.kind") == "string") | F.col("told"), "step")
    values = [F.coalesce(*([F.col("own.said")] if f == "text" else []), *(F.col(f"in_{name}") for name in FIELDS[f])).alias(f) for f in fields]
    named = F.col("__key").alias("record" if key in ("kind", "node", "parent_node", *FIELDS) else key)
    return found.select(named, entity.alias("kind"), F.col("own.places").alias("node"), F.col("own.within").alias("parent_node"), *values).filter("kind is not null")


_OBJECT = T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "owner", "node", "parent_node", "label")]).add("fields", T.MapType(T.StringType(), T.StringType()))
_OBJECT_ARROW = pa.struct([*((n, pa.string()) for n in _OBJECT.names[:-1]), ("fields", pa.map_(pa.string(), pa.string()))])


def _object_rows(value: object) -> Iterator[tuple]:
    tree = list(nodes(value))
    children: dict[int, list[tuple]] = {}
    for row in tree:
        children.setdefault(row[1], []).append(row)
    whole = lambda v: v if v is None else v.encode("utf-8", "replace").decode()
    fields = lambda node: [(whole(c[2]), whole(c[5])) for c in children.get(node, ()) if c[4] not in ("object", "array")]
    nested = lambda node, path: [(c, path, f"{path}/{c[2]}", c[2]) for c in reversed(children.get(node, ())) if c[4] in ("object", "array")]
    found = list(recipe_entities(tree))
    own = {at for *_, at in found}
    for kind, path, parent, at in found:
        yield kind, kind, path, parent, None, fields(at) if tree[at][4] == "object" else [(TEXT, whole(tree[at][5]))]
        work = nested(at, path)
        while work:
            row, up, here, label = work.pop()
            if row[0] in own:
                continue
            if row[4] == "array":
                work += [(c, up, f"{here}.{c[3]}", label) for c in reversed(children.get(row[0], ()))]
            elif row[4] == "object":
                yield "part", kind, here, up, label, fields(row[0])
                work += nested(row[0], here)
            else:
                yield "part", kind, here, up, label, [("value", whole(row[5]))]


@F.arrow_udf(T.ArrayType(_OBJECT))
def _objects(texts: pa.Array) -> pa.Array:
    parts = [_columns([_rows(t, _object_rows) for t in texts.slice(at, TEXTS).to_pylist()], _OBJECT_ARROW) for at in range(0, len(texts), TEXTS)]
    return pa.concat_arrays(parts) if parts else _columns([], _OBJECT_ARROW)


def recipe_objects(df: DataFrame, json_column: str, key: str) -> DataFrame:
    """The rows of :func:`recipe_tables` with all their scalar children, and a row for each object nested in one.

    Columns: ``key`` (as ``record`` if it is named like another), kind, owner, node, parent_node, label, fields. ``fields`` maps labels to
    scalars; a lone text is its "text". What an entity holds that is no entity (author, rating, image) has kind "part", the
    entity's kind as owner, and a node of the container's node, "/", the label and the places in arrays; there a scalar in an array
    is its "value". (key, owner, parent_node) leads to the container's (key, owner, node) of a part.
    """
    rows = df.select(F.col(f"`{key}`").alias("__key"), _objects.asNondeterministic()(F.col(f"`{json_column}`")).alias("__objects"))
    return rows.select(F.col("__key").alias("record" if key in _OBJECT.names else key), F.inline("__objects"))
