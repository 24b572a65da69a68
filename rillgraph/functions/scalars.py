"""Scalar functions of the engine as column expressions: ids, slots, paths, names."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_parts(*parts: Column) -> Column:
    """SHA-256 over each part's length (64-bit, little-endian) and its bytes, in hex. Parts are strings or binary."""

    def sized(p: Column) -> Column:
        p = p.cast("binary")
        size = F.lpad(F.hex(F.octet_length(p)), 16, "0")
        return F.concat(F.unhex(F.array_join(F.reverse(F.regexp_extract_all(size, F.lit("(..)"), F.lit(1))), "")), p)

    return F.sha2(functools.reduce(lambda a, b: F.concat(a, b), [sized(p) for p in parts]), 256)


def canonical_path(c: Column) -> Column:
    """An HTTP path template in its one spelling: holes are {}, catch-alls {*}, no scheme, host or query."""
    s = F.regexp_replace(c, r"^((?i:https?:)?//)[^/]*", "")
    s = F.regexp_replace(s, r"(?s)[?#].*$", "")
    parts = F.filter(F.split(s, "/"), lambda x: (x != "") & (x != "{$}"))

    def one(x: Column) -> Column:
        rest = (x == "{*}") | x.startswith("*") | x.rlike(r"^(\{.*\.\.\.\}|\[\.\.\..*\]|\[\[\.\.\..*\]\])$")
        return F.when(rest, "{*}").when(x.rlike(r"[{\[]") | x.startswith(":"), "{}").otherwise(x)

    parts = F.transform(parts, one)
    tail = F.array_position(parts, "{*}")
    cut = F.when(tail > 0, F.slice(parts, F.lit(1), F.greatest(tail, F.lit(1)).cast("int"))).otherwise(parts)
    return F.concat(F.lit("/"), F.array_join(cut, "/"))


def module_of(fqn: Column) -> Column:
    """The module that owns a callee: three path segments of an import path; null for the standard library."""
    path = F.regexp_replace(F.regexp_replace(fqn, r"^\(+", ""), r"^\*+", "")
    seg = F.split(path, "/")
    third = F.substring_index(F.get(seg, F.lit(2)), ".", 1)
    named = F.when(F.get(seg, F.lit(2)).isNull(), F.concat_ws("/", F.get(seg, F.lit(0)), F.get(seg, F.lit(1)))).otherwise(F.concat_ws("/", F.get(seg, F.lit(0)), F.get(seg, F.lit(1)), third))
    dotted = F.get(seg, F.lit(0)).contains(".") & ~F.get(seg, F.lit(0)).contains(" ")
    return F.when(fqn.startswith("func("), "<dynamic func value>").when(dotted & (F.size(seg) >= 2), named)


def getter_field(fqn: Column, argc: Column, recv: Column, resultc: Column) -> Column:
    """The field that a generated protobuf getter projects, or null."""
    owner = F.regexp_extract(fqn, r"^\(\**(.*?)\)\.", 1)
    package = F.regexp_extract(owner, r"^(.*)\.[^.]*$", 1)
    field = F.regexp_extract(fqn, r"^\(.*?\)\.Get([A-Z][^(]*)$", 1)
    generated = package.contains("/pb/") | package.endswith("/pb") | package.contains("/api/") | package.endswith("/api")
    return F.when((argc == 1) & recv & (resultc == 1) & (field != "") & generated, field)


def slot_text(slot: Column, path: Column) -> Column:
    """param_1[3,7]: a slot with its field path."""
    return F.when(F.size(path) > 0, F.concat(slot, F.lit("["), F.array_join(path.cast("array<string>"), ","), F.lit("]"))).otherwise(slot)


def slot_base(text: Column) -> Column:
    return F.regexp_extract(text, r"^([^\[]*)", 1)


def slot_path(text: Column) -> Column:
    inner = F.regexp_extract(text, r"\[([0-9,]*)\]$", 1)
    return F.when(inner == "", F.array().cast("array<int>")).otherwise(F.split(inner, ",").cast("array<int>"))


def paths_comparable(a: Column, b: Column) -> Column:
    """One path is a prefix of the other."""
    n = F.least(F.size(a), F.size(b))
    return F.slice(a, F.lit(1), n) == F.slice(b, F.lit(1), n)


def residual_after(matched: Column, full: Column) -> Column:
    """What of `full` a row keyed on its prefix `matched` leaves over; empty otherwise."""
    longer = (F.size(full) > F.size(matched)) & (F.slice(full, F.lit(1), F.size(matched)) == matched)
    return F.when(longer, F.slice(full, F.size(matched) + 1, F.greatest(F.size(full) - F.size(matched), F.lit(0)))).otherwise(F.array().cast("array<int>"))


def compose_path(declared: Column, residual: Column, k: int = 2) -> Column:
    """declared ++ residual; a declared path of k fields may be cut short, so nothing is added to it."""
    return F.when((F.size(residual) == 0) | (F.size(declared) >= k), declared).otherwise(F.concat(declared, residual))


def confidence(c: Column) -> Column:
    """A dispatch confidence; 0 stands for 1."""
    return F.when(c == 0, F.lit(1.0)).otherwise(c)


def _little(n: Column, width: int) -> Column:
    """A number's bytes from the least on, in hex."""
    return F.array_join(F.reverse(F.regexp_extract_all(F.lpad(F.hex(n), 2 * width, "0"), F.lit("(..)"), F.lit(1))), "")


def route_id(hops: Column, klass: Column, with_line: bool = True) -> Column:
    """12 hex digits that name a route of hops struct(repo, func, callee, line, kind); without lines, its fingerprint."""

    def sized(p: Column) -> Column:
        return F.concat(_little(F.octet_length(p), 8), F.hex(p.cast("binary")))

    def hop(h: Column) -> Column:
        line = [F.concat(_little(F.lit(4), 8), _little(h["line"].cast("bigint"), 4))] if with_line else []
        return F.concat(*[sized(h[k]) for k in ("repo", "func", "callee")], *line, sized(h["kind"]))

    text = F.concat(sized(klass), F.array_join(F.transform(hops, hop), ""))
    return F.substring(F.sha2(F.unhex(text), 256), 1, 12)
