"""Code-graph packages: protobuf files read into the relations of a program.

Files are read with Spark's binary reader and decoded from the wire format in Arrow
batches; every package becomes rows of (kind, body), bodies being JSON of one relation each.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..plans.fixpoint import stable
from ..plans.taint import Program

# Field numbers and types of the file format. A trailing * repeats; a name in
# capitals is a message.
MESSAGES: dict[str, dict[int, tuple[str, str]]] = {
    "PACKAGE": {1: ("repo", "string"), 2: ("commit_sha", "string"), 3: ("package_path", "string"), 5: ("language", "string"), 10: ("functions", "FUNCTION*"), 13: ("grpc", "GRPC*"), 14: ("graphql", "GRAPHQL*"), 15: ("endpoints", "ENDPOINT*"), 16: ("http", "ROUTE*")},
    "IDENT": {1: ("iid", "bytes"), 2: ("bid", "bytes")},
    "SPAN": {1: ("file", "string"), 2: ("line", "int"), 3: ("col", "int")},
    "FUNCTION": {1: ("id", "IDENT"), 2: ("fqn", "string"), 4: ("origin", "int"), 5: ("generated", "bool"), 8: ("span", "SPAN"), 10: ("flow", "FLOW"), 11: ("binds_to", "bytes*"), 12: ("source_params", "int*")},
    "FLOW": {1: ("vertices", "VERTEX*"), 2: ("edges", "EDGE*"), 3: ("callsites", "CALL*")},
    "VERTEX": {1: ("id", "int"), 2: ("kind", "int"), 3: ("index", "int"), 4: ("field_path", "int*"), 5: ("callsite_id", "int"), 6: ("sym", "bytes"), 7: ("type", "string"), 8: ("span", "SPAN"), 9: ("field_names", "string*"), 10: ("sym_name", "string"), 11: ("iface_type", "bytes")},
    "EDGE": {1: ("from", "int"), 2: ("to", "int"), 3: ("via_alias", "bool")},
    "CALL": {1: ("id", "int"), 2: ("kind", "int"), 3: ("callee_iids", "bytes*"), 4: ("opaque", "bool"), 5: ("callee_fqn", "string"), 6: ("argc", "int"), 7: ("recv", "bool"), 8: ("resultc", "int"), 9: ("span", "SPAN"), 10: ("dispatch_confidence", "float"), 11: ("stream_op", "int"), 12: ("stream_client", "bool"), 13: ("error_results", "int"), 14: ("arg_names", "string*"), 15: ("http_call", "HTTPCALL"), 16: ("target_fqns", "string*")},
    "HTTPCALL": {1: ("method", "string"), 2: ("path", "string")},
    "GRPC": {1: ("iid", "bytes"), 2: ("full_name", "string"), 5: ("handler", "bytes"), 7: ("client_streaming", "bool"), 8: ("server_streaming", "bool")},
    "GRAPHQL": {1: ("iid", "bytes"), 2: ("full_name", "string"), 3: ("handler", "bytes"), 5: ("args", "GQLARG*")},
    "GQLARG": {1: ("name", "string"), 2: ("param_idx", "int")},
    "ROUTE": {1: ("iid", "bytes"), 2: ("method", "string"), 3: ("path", "string"), 4: ("display", "string"), 5: ("handler", "bytes"), 7: ("request_params", "int*"), 8: ("framework", "string")},
    "ENDPOINT": {1: ("iid", "bytes"), 2: ("kind", "int"), 3: ("untrusted", "bool"), 4: ("name", "string")},
}
_DEFAULT = {"string": "", "bytes": "", "int": 0, "bool": False, "float": 0.0}


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if i >= len(b):
            raise ValueError("the message ends inside a number")
        value |= (b[i] & 127) << shift
        shift += 7
        i += 1
        if b[i - 1] < 128:
            return value, i


def _signed(v: int) -> int:
    return v - (1 << 64) if v >= 1 << 63 else v


def decode(b: bytes, message: str = "PACKAGE") -> dict:
    """A message as a dict; bytes in hex, fields that are not listed skipped, absent ones at their defaults."""
    fields = MESSAGES[message]
    out: dict = {name: [] if t.endswith("*") else None if t.isupper() else _DEFAULT[t] for name, t in fields.values()}
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        number, wire = key >> 3, key & 7
        if wire == 0:
            raw, i = _varint(b, i)
        elif wire == 1:
            raw, i = b[i : i + 8], i + 8
        elif wire == 5:
            raw, i = b[i : i + 4], i + 4
        elif wire == 2:
            n, i = _varint(b, i)
            raw, i = b[i : i + n], i + n
            if len(raw) < n:
                raise ValueError("the message ends inside a field")
        else:
            raise ValueError(f"unknown wire type {wire}")
        if number not in fields:
            continue
        name, kind = fields[number]
        many, kind = kind.endswith("*"), kind.rstrip("*")
        if kind.isupper():
            values = [decode(raw, kind)]
        elif kind == "int" and wire == 2:  # packed
            values, at = [], 0
            while at < len(raw):
                v, at = _varint(raw, at)
                values.append(v)
        elif kind == "int":
            values = [_signed(raw)]
        elif kind == "bool":
            values = [bool(raw)]
        elif kind == "float":
            values = [struct.unpack("<f", raw)[0]]
        else:
            values = [raw.decode("utf-8", "replace") if kind == "string" else raw.hex()]
        if many:
            out[name] += values
        else:
            out[name] = values[-1]
    return out


def encode(value: dict, message: str = "PACKAGE") -> bytes:
    """The inverse of decode; defaults are left out."""

    def number(v: int) -> bytes:
        v &= (1 << 64) - 1
        out = b""
        while v > 127:
            out += bytes([v & 127 | 128])
            v >>= 7
        return out + bytes([v])

    out = b""
    for n, (name, kind) in MESSAGES[message].items():
        values = value.get(name)
        kind, values = kind.rstrip("*"), values if isinstance(values, list) else [values]
        for v in values:
            if kind.isupper():
                if v is not None:
                    body = encode(v, kind)
                    out += number(n << 3 | 2) + number(len(body)) + body
            elif v is None or (v == _DEFAULT[kind] and not isinstance(value.get(name), list)):
                continue
            elif kind in ("int", "bool"):
                out += number(n << 3) + number(int(v))
            elif kind == "float":
                out += number(n << 3 | 5) + struct.pack("<f", v)
            else:
                body = v.encode() if kind == "string" else bytes.fromhex(v)
                out += number(n << 3 | 2) + number(len(body)) + body
    return out


def rows_of(package: dict, ordinal: str) -> Iterator[tuple[str, dict]]:
    repo = package["repo"]
    yield "package", {"repo": repo, "commit_sha": package["commit_sha"], "package_path": package["package_path"], "language": package["language"] or "go", "pkg_ord": ordinal}
    for f in package["functions"]:
        content = encode(f, "FUNCTION").hex()
        copy = hashlib.sha256(content.encode()).hexdigest()
        ident, flow = f["id"] or {"iid": "", "bid": ""}, f["flow"]
        yield "function", {"iid": ident["iid"], "bid": ident["bid"], "fqn": f["fqn"], "repo": repo, "has_flow": flow is not None, "span": f["span"], "source_params": f["source_params"], "binds_to": f["binds_to"], "generated": f["generated"], "origin": f["origin"], "content": content, "copy": copy}
        key = {"fn": ident["iid"], "copy": copy}
        for v in (flow or {}).get("vertices", []):
            yield "vertex", {**key, "vid": v["id"], "kind": v["kind"], "idx": v["index"], "path": v["field_path"], "cs": v["callsite_id"] if v["kind"] in (6, 7) else -1, "sym": v["sym"], "sym_name": v["sym_name"], "iface_type": v["iface_type"], "type": v["type"], "field_names": v["field_names"], "span": v["span"]}
        for e in (flow or {}).get("edges", []):
            yield "edge", {**key, "src": e["from"], "dst": e["to"]}
        for at, c in enumerate((flow or {}).get("callsites", [])):
            if c["id"] != at:
                raise ValueError(f"{f['fqn']}: call site {at} has id {c['id']}")
            http = c["http_call"] or {"method": None, "path": None}
            yield "callsite", {**key, "cs": at, **{k: c[k] for k in ("kind", "callee_fqn", "argc", "resultc", "recv", "opaque", "dispatch_confidence", "stream_op", "stream_client", "arg_names", "span")}, "error_results": _signed(c["error_results"]), "http_method": http["method"], "http_path": http["path"]}
            for k, t in enumerate(c["callee_iids"]):
                yield "target", {**key, "cs": at, "ord": k, "callee": t}
    base = {"repo": repo, "client_streaming": False, "server_streaming": False, "gql_arg_names": [], "gql_param_idx": [], "method": "", "path": "", "display": "", "framework": "", "request_params": []}
    for g in package["grpc"]:
        yield "contract", {**base, "kind": 0, **{k: g[k] for k in ("iid", "full_name", "handler", "client_streaming", "server_streaming")}}
    for g in package["graphql"]:
        yield "contract", {**base, "kind": 1, "iid": g["iid"], "full_name": g["full_name"], "handler": g["handler"], "gql_arg_names": [a["name"] for a in g["args"]], "gql_param_idx": [a["param_idx"] for a in g["args"]]}
    for r in package["http"]:
        label = f"http {r['method']} {r['display'] or r['path']}" + (f" ({r['framework']})" if r["framework"] else "")
        yield "contract", {**base, "kind": 2, "full_name": label, **{k: r[k] for k in ("iid", "handler", "method", "path", "display", "framework", "request_params")}}
    for e in package["endpoints"]:
        yield "endpoint", {"repo": repo, **e}


SPAN = "struct<file:string,line:int,col:int>"
SCHEMAS = {
    "package": "repo string, commit_sha string, package_path string, language string, pkg_ord string",
    "function": f"iid string, bid string, fqn string, repo string, has_flow boolean, span {SPAN}, source_params array<int>, binds_to array<string>, generated boolean, origin int, content string, copy string",
    "vertex": f"fn string, copy string, vid int, kind int, idx int, path array<int>, cs int, sym string, sym_name string, iface_type string, type string, field_names array<string>, span {SPAN}",
    "edge": "fn string, copy string, src int, dst int",
    "callsite": f"fn string, copy string, cs int, kind int, callee_fqn string, argc long, resultc long, recv boolean, opaque boolean, dispatch_confidence double, stream_op int, stream_client boolean, error_results long, arg_names array<string>, http_method string, http_path string, span {SPAN}",
    "target": "fn string, copy string, cs int, ord int, callee string",
    "contract": "iid string, full_name string, kind int, handler string, repo string, client_streaming boolean, server_streaming boolean, gql_arg_names array<string>, gql_param_idx array<int>, method string, path string, display string, framework string, request_params array<int>",
    "endpoint": "repo string, iid string, kind int, name string, untrusted boolean",
}


def load(spark: SparkSession, folders: list[str]) -> dict[str, DataFrame]:
    """The relations of all packages (*.pb, not in subfolders) of the folders. Raises if there is none."""
    try:
        files = spark.read.format("binaryFile").load([f"{f.rstrip('/')}/*.pb" for f in folders]).select("path", "content")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        raise FileNotFoundError(f"no packages in one of {', '.join(folders)}") from None

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = list(rows_of(decode(content), path))
                for i in range(0, len(rows), 5000):
                    part = rows[i : i + 5000]
                    yield pa.record_batch([pa.array([k for k, _ in part]), pa.array([json.dumps(r) for _, r in part])], names=["kind", "body"])

    rows = stable(files.mapInArrow(decoded, "kind string, body string"))
    if rows.isEmpty():
        raise FileNotFoundError(f"no packages in {', '.join(folders)}")
    out = {k: rows.where(F.col("kind") == k).select(F.from_json("body", s).alias("r")).select("r.*") for k, s in SCHEMAS.items()}
    winners, _ = resolve_duplicates(out["function"])
    winners = stable(winners)
    chosen = winners.select(F.col("iid").alias("fn"), "copy")
    out["function"] = winners.drop("content", "copy")
    for k in ("vertex", "edge", "callsite", "target"):
        # A function that several packages hold alike comes with as many copies of its rows.
        out[k] = out[k].join(chosen, ["fn", "copy"], "left_semi").drop("copy").distinct()
    out["contract"] = keyed_contracts(out["contract"])
    return out


def resolve_duplicates(functions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row per iid, the duplicates' iids with copies and whether they differ).

    Equal copies are one, of the smallest repository name; of different ones the one with a
    body wins, then the greatest encoding.
    """
    own = Window.partitionBy("iid").orderBy(F.desc("has_flow"), F.desc("content"), "repo")
    ranked = functions.withColumn("_r", F.row_number().over(own))
    copies = functions.groupBy("iid").agg(F.count("*").alias("copies"), (F.countDistinct("content") > 1).alias("differ"))
    return ranked.where("_r = 1").drop("_r"), copies.where("copies > 1")


def contract_copies(contracts: DataFrame, shape: list[str]) -> DataFrame:
    """(iid, copies, repos, handlers, shapes) of contracts that several repositories, handlers or shapes give."""
    found = contracts.groupBy("iid").agg(F.count("*").alias("copies"), F.countDistinct("repo").alias("repos"), F.countDistinct("handler").alias("handlers"), F.countDistinct(F.struct(*shape)).alias("shapes"))
    return found.where("repos > 1 or handlers > 1 or shapes > 1")


def examples(copies: DataFrame, kinds: list[str], most: int = 5) -> DataFrame:
    """(kind, iid): of each kind of difference the first `most` ids; a report, so it has an end."""
    each = copies.select("iid", F.explode(F.filter(F.array(*[F.when(F.col(k).cast("long") > 1, F.lit(k)) for k in kinds]), lambda k: k.isNotNull())).alias("kind"))
    first = Window.partitionBy("kind").orderBy("iid")
    return each.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= most).select("kind", "iid")


def keyed_contracts(contracts: DataFrame) -> DataFrame:
    """Contracts with an id and a handler, each once; an HTTP id of several handlers is keyed by the handler too."""
    from ..functions.scalars import hash_parts

    own = contracts.where("iid <> '' and handler <> ''")
    many = own.where("kind = 2").groupBy("iid").agg((F.countDistinct("handler") > 1).alias("shared"))
    own = own.join(many, "iid", "left")
    key = F.when((F.col("kind") == 2) & F.coalesce("shared", F.lit(False)), hash_parts(F.lit("http-route"), F.unhex("iid"), F.unhex("handler"))).otherwise(F.col("iid"))
    return own.withColumn("iid", key).drop("shared").dropDuplicates(["iid", "handler"])


def program(spark: SparkSession, folders: list[str], link_http: bool = True) -> Program:
    """The program of all packages, its arguments by name renumbered and its HTTP clients linked."""
    from ..operators import httplink, normalize

    r = load(spark, folders)
    calls, targets, vertices = r["callsite"], r["target"], r["vertex"]
    one = targets.groupBy("fn", "cs").agg(F.count("*").alias("n"), F.first("callee").alias("contract")).where("n = 1").select("fn", "cs", "contract")
    named = calls.where(F.size("arg_names") > 0).join(one, ["fn", "cs"]).select(F.concat_ws("#", "fn", "cs").alias("site"), "contract", F.posexplode("arg_names").alias("idx", "name"))
    args = r["contract"].where("kind = 1").select("iid", F.posexplode("gql_arg_names").alias("pos", "name")).select(F.col("iid").alias("contract"), "name", "pos").dropDuplicates(["contract", "name"])
    moved = normalize.normalise(named, args).where("idx <> new_idx").select("site", "idx", F.col("new_idx").cast("int").alias("new_idx"))
    site = F.when(F.col("kind") == 6, F.concat_ws("#", "fn", "cs"))
    vertices = vertices.withColumn("site", site).join(moved, ["site", "idx"], "left").withColumn("idx", F.coalesce("new_idx", "idx")).drop("site", "new_idx")
    if link_http:
        clients = calls.where("http_path is not null").select(F.concat_ws("#", "fn", "cs").alias("site"), F.col("http_method").alias("method"), F.col("http_path").alias("path"), "fn", "cs")
        routes = r["contract"].where("kind = 2").select(F.col("iid").alias("handler"), "method", "path")
        linked = httplink.link(clients, routes).where("handler <> ''").join(clients.select("site", "fn", "cs"), "site")
        linked = stable(linked.select("fn", "cs", F.col("handler").alias("callee"), "confidence").distinct())
        targets = targets.join(linked.select("fn", "cs").distinct(), ["fn", "cs"], "left_anti").unionByName(linked.select("fn", "cs", F.lit(0).alias("ord"), "callee"))
        sure = linked.groupBy("fn", "cs").agg(F.max("confidence").alias("_c"))
        calls = calls.join(sure, ["fn", "cs"], "left").withColumn("kind", F.when(F.col("_c").isNotNull(), 2).otherwise(F.col("kind"))).withColumn("dispatch_confidence", F.coalesce("_c", "dispatch_confidence")).drop("_c")
    return Program(stable(r["function"]), stable(vertices), stable(r["edge"]), stable(calls), stable(targets.select("fn", "cs", "callee")), stable(r["contract"]))


def dump(relations: dict[str, DataFrame]) -> DataFrame:
    """(what, n): how much of everything there is."""
    parts = [relations["package"].agg(F.count("*").alias("n")).select(F.lit("packages").alias("what"), "n"), relations["function"].agg(F.count("*").alias("n")).select(F.lit("functions").alias("what"), "n")]
    parts.append(relations["package"].groupBy(F.concat(F.lit("language "), "language").alias("what")).agg(F.count("*").alias("n")))
    parts.append(relations["contract"].groupBy(F.concat(F.lit("contracts "), F.element_at(F.array(F.lit("grpc"), F.lit("graphql"), F.lit("http")), F.col("kind") + 1)).alias("what")).agg(F.count("*").alias("n")))
    kinds = F.array(F.lit("grpc"), F.lit("graphql"), F.lit("http"), F.lit("message"))
    parts.append(relations["endpoint"].groupBy(F.concat(F.lit("endpoints "), F.coalesce(F.get(kinds, F.col("kind")), F.lit("unknown"))).alias("what")).agg(F.count("*").alias("n")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
