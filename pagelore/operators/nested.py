"""Deeply nested JSON records as related flat tables.

A merged schema is inferred over all records, every array level of it becomes a child table, and each child row carries
the key of its parent row and its position. Values stay variants until a column is asked for, so a field that is a lone
object in one record and a list in the next reads as a list in both.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelore.session import cut

#: Times that a JSON text may hold the record as a JSON string again.
MAX_ENCODINGS = 3


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once: as a lambda's argument it is not copied into every place that uses it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def parse_complete(text: Column) -> Column:
    """The text as a variant, null where it is not one complete JSON value.

    parse_json alone accepts whatever follows the first value; inside brackets, a rest is an error or a second element.
    """
    boxed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return let(F.try_variant_get(boxed, "$", "array<variant>"), lambda items: F.when(F.size(items) == 1, items[0]))


def decoded(v: Column) -> Column:
    """A variant that is a JSON string holding JSON becomes what it holds, MAX_ENCODINGS deep."""
    for _ in range(MAX_ENCODINGS):
        v = let(v, lambda x: F.when(F.schema_of_variant(x) == "STRING", parse_complete(F.try_variant_get(x, "$", "string"))).otherwise(x))
    return v


def get(v: Column, path: str) -> Column:
    """The variant at `path`; null where it is missing or a JSON null."""
    return let(F.try_variant_get(v, path, "variant"), lambda x: F.when(~F.is_variant_null(x), x))


def text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def as_list(v: Column) -> Column:
    """A list as it is, anything else as a list of one, null as null."""
    return let(v, lambda x: F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.when(x.isNotNull() & ~F.is_variant_null(x), F.array(x))))


def first_of(*lists: Column) -> Column:
    """The first list that is neither null nor empty."""
    return F.coalesce(*[let(y, lambda x: F.when(F.size(x) > 0, x)) for y in lists])


def merged_schema(df: DataFrame, column: str) -> str:
    """The schema that all variants of a column share, as text; VARIANT where they disagree. One aggregate row reaches the driver."""
    row = df.select(F.schema_of_variant_agg(F.col(column)).alias("s")).first()
    return row.s


@dataclass
class Node:
    """A place in the merged schema: children by field, and whether values there are lists."""

    fields: dict[str, Node] = field(default_factory=dict)
    many: bool = False
    open: bool = False  # disagreeing types: VARIANT


def parse_schema(s: str) -> Node:
    """The schema text of schema_of_variant_agg as a tree."""
    at = 0

    def skip(tok: str) -> bool:
        nonlocal at
        if s.startswith(tok, at):
            at += len(tok)
            return True
        return False

    def name() -> str:
        nonlocal at
        if skip("`"):
            out = ""
            while True:
                if skip("``"):
                    out += "`"
                elif skip("`"):
                    break
                else:
                    out += s[at]
                    at += 1
        else:
            end = s.index(": ", at)
            out, at = s[at:end], end
        assert skip(": ")
        return out

    def node() -> Node:
        nonlocal at
        if skip("ARRAY<"):
            n = node()
            skip(">")
            return Node(n.fields, True, n.open)
        if skip("OBJECT<"):
            n = Node()
            while not skip(">"):
                k = name()
                n.fields[k] = node()
                skip(", ")
            return n
        end = min([i for i in (s.find(c, at) for c in ",>") if i >= 0] or [len(s)])
        if s[at:end].startswith("DECIMAL("):
            end = s.index(")", at) + 1
        kind, at = s[at:end], end
        return Node(open=kind == "VARIANT")

    return node()


def array_paths(n: Node, path: str = "$") -> list[str]:
    """Every array level, parents before children; [*] marks a list that was stepped into."""
    out = []
    for k, c in n.fields.items():
        p = f"{path}.{k}" if k.isidentifier() else f"{path}['{k}']"
        if c.many:
            out.append(p)
            out += array_paths(c, p + "[*]")
        else:
            out += array_paths(c, p)
    return out


def child_table(parent: DataFrame, keys: list[str], lists: Column, key: str, value: str = "value") -> DataFrame:
    """One row for each element of `lists` in each row of `parent`: the parent's keys, `key` (position from 1) and the element."""
    return parent.select(*keys, F.posexplode(lists).alias("__pos", value)).select(*keys, (F.col("__pos") + 1).alias(key), value)


def complete(df: DataFrame, record: str, payload: str) -> DataFrame:
    """__r and v: every record's payload as a variant, once, decoded until it holds no more JSON in a string. Texts that are no
    complete JSON, and nulls, have no row."""
    raw = df.select(F.col(record).alias("__r"), F.col(payload).alias("__p")).distinct()
    base = cut(raw.select("__r", decoded(parse_complete(F.col("__p"))).alias("v")).where("v is not null"))
    inner = (F.schema_of_variant("v") == "STRING") & parse_complete(F.try_variant_get("v", "$", "string")).isNotNull()
    while not base.where(inner).isEmpty():
        base = cut(base.withColumn("v", decoded(F.col("v"))))
    return base


def inferred(base: DataFrame, value: str) -> Node:
    """The merged schema of those values that are objects."""
    s = merged_schema(base.where(F.schema_of_variant(value).startswith("OBJECT")), value)
    return parse_schema(s) if s else Node()


def levels(base: DataFrame, keys: list[str], value: str, lists: frozenset[str] = frozenset(), only: bool = False) -> dict[str, DataFrame]:
    """A table for each array level that the merged schema of `base`'s variant column `value` shows, named by its path: `keys`, the
    positions of its ancestors and its own (no_1, no_2, ...; from 1) and the element in `value`. Fields named in `lists` are
    lists even where every record has a lone value; with `only`, no other field's level is made. A level with levels below it is
    written once and read by these."""
    out: dict[str, DataFrame] = {}
    n_keys = len(keys)

    def nested_in(n: Node) -> bool:
        return (n.open and not only) or any(made(k, c) or nested_in(c) for k, c in n.fields.items())

    def made(k: str, c: Node) -> bool:
        return k in lists or (not only and (c.many or c.open))

    def walk(n: Node, parent: DataFrame, keys: list[str], path: str, at: str) -> None:
        for k, c in n.fields.items():
            step = f".{k}" if k.isidentifier() else f"['{k}']"
            if not made(k, c):
                if not c.many:
                    walk(c, parent, keys, path + step, at + step)
                continue
            no = f"no_{len(keys) - n_keys + 1}"
            t = child_table(parent, keys, as_list(get(F.col("value"), at + step)), no)
            if nested_in(c):
                t = cut(t)
            out[path + step] = t
            # where types disagree the elements have a schema of their own
            walk(inferred(t, "value") if c.open else c, t, [*keys, no], path + step + "[*]", "$")

    walk(inferred(base, value), base.withColumnRenamed(value, "value"), keys, "$", "$")
    return out


def flat_tables(df: DataFrame, record: str, payload: str) -> dict[str, DataFrame]:
    """A table for each array level that the merged schema of `payload` shows, named by its path.

    Each holds `record`, the positions of its ancestors and its own (no_1, no_2, ...; from 1) and the element as a variant.
    Texts that are no complete JSON give no rows; missing, null and empty lists give none; a lone value where other records
    have a list counts as a list of one. Null payloads and empty tables give no rows. A record delivered twice counts once.
    """
    return {path: t.withColumnRenamed("__r", record) for path, t in levels(complete(df, record, payload), ["__r"], "v").items()}
