"""Nested label records into related flat tables (problem 1).

One depth-first visitor per record emits every node once, tagged with its table, with its own key
and that of its parent. The tagged stream is written partitioned by tag; each table is then read
back under its own schema. Repeated deliveries of a record are dropped before the visit.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TAGS = ("substance", "product", "ingredient", "package")

TAGGED = (
    "record_id long, node_kind string, node_path string, parent_path string, code string, payload string"
)

#: Schema of each table's payload.
PAYLOADS = {
    "substance": "name string",
    "product": "dosage_form string",
    "ingredient": "name string, strength string",
    "package": "description string, marketing_start string",
}

_TOKEN = re.compile(r'[ \t\n\r]*([{}\[\],:]|"(?:[^"\\\x00-\x1f]|\\.)*"|[^\s{}\[\],:"]+)')
_ATOM = re.compile(r"-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?|true|false|null|NaN|-?Infinity")


def _parse_deep(text: str):
    """JSON of any depth without recursion; ValueError where it can't be read."""
    pos, end = 0, len(text.rstrip(" \t\n\r"))
    stack: list = []
    root: list = []
    want = "value"
    key: list = []

    def put(value):
        if not stack:
            root.append(value)
        elif isinstance(stack[-1], list):
            stack[-1].append(value)
        else:
            stack[-1][key[-1]] = value

    while pos < end:
        m = _TOKEN.match(text, pos)
        if not m or (not stack and root):
            raise ValueError("not JSON")
        tok, pos = m.group(1), m.end()
        if tok in "}]" and tok:
            if not stack or (tok == "}") != isinstance(stack[-1], dict) or want not in ("comma", "first"):
                raise ValueError("not JSON")
            if isinstance(stack.pop(), dict):
                key.pop()
            want = "comma"
        elif tok == ",":
            if want != "comma" or not stack:
                raise ValueError("not JSON")
            want = "key" if isinstance(stack[-1], dict) else "value"
        elif tok == ":":
            if want != "colon":
                raise ValueError("not JSON")
            want = "value"
        elif isinstance(stack[-1] if stack else None, dict) and want in ("key", "first"):
            if tok[0] != '"':
                raise ValueError("not JSON")
            key[-1] = json.loads(tok)
            want = "colon"
        elif want in ("value", "first"):
            if tok == "{":
                value: object = {}
                put(value)
                stack.append(value)
                key.append(None)
                want = "first"
            elif tok == "[":
                value = []
                put(value)
                stack.append(value)
                want = "first"
            else:
                if tok[0] != '"' and not _ATOM.fullmatch(tok):
                    raise ValueError("not JSON")
                put(json.loads(tok))
                want = "comma"
        else:
            raise ValueError("not JSON")
    if stack or len(root) != 1:
        raise ValueError("not JSON")
    return root[0]


def parse_record(raw: str | None) -> dict | None:
    """The JSON object in ``raw``, also one encoded as a JSON string; None where there is none."""
    value: object = raw
    while isinstance(value, str):
        try:
            value = json.loads(value)
        except RecursionError:
            try:
                value = _parse_deep(value)
            except (ValueError, RecursionError):
                return None
        except ValueError:
            return None
    return value if isinstance(value, dict) else None


def _entries(value) -> list:
    """An array as it is; a single value as an array of one; nothing for null."""
    return value if isinstance(value, list) else [] if value is None else [value]


def _text(value) -> str:
    if value is None:
        return ""
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _empty(value) -> bool:
    return value is None or value == "" or (isinstance(value, (dict, list)) and not value)


def visit(record: dict) -> Iterator[tuple[str, str, str, str, dict]]:
    """Depth first: (tag, path, parent's path, code, payload) of every node.

    Positions count null and empty entries, which are no nodes. Entries of the wrong type (a text
    where an object belongs) are no nodes either, except that a substance is any non-null scalar.
    """
    openfda = record.get("openfda")
    for fda in [openfda] if isinstance(openfda, dict) else []:
        uniis = _entries(fda.get("unii"))
        for i, name in enumerate(_entries(fda.get("substance_name"))):
            if not _empty(name):
                yield "substance", str(i), "", _text(uniis[i]) if i < len(uniis) else "", {"name": _text(name)}
    for i, product in enumerate(_entries(record.get("products"))):
        if not isinstance(product, dict) or not product:
            continue
        at = str(i)
        yield "product", at, "", _text(product.get("product_ndc")), {"dosage_form": product.get("dosage_form")}
        for j, x in enumerate(_entries(product.get("active_ingredients"))):
            if isinstance(x, dict) and x:
                yield "ingredient", f"{at}/{j}", at, _text(x.get("unii")), {"name": x.get("substance_name"), "strength": x.get("strength")}
        below = [(f"{at}/{j}", at, x) for j, x in enumerate(_entries(product.get("packaging")))][::-1]
        while below:
            path, parent, x = below.pop()
            if not isinstance(x, dict) or not x:
                continue
            yield "package", path, parent, _text(x.get("package_ndc")), {"description": x.get("description"), "marketing_start": x.get("marketing_start")}
            below += [(f"{path}/{j}", path, y) for j, y in enumerate(_entries(x.get("contains")))][::-1]


def _emitter(with_payload: bool, chunk: int = 20_000):
    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in TAGGED.split(", ")]
        rows: list = []
        for batch in batches:
            for record_id, raw in zip(batch["record_id"], batch["raw"]):
                record = parse_record(raw)
                if record is None or pd.isna(record_id):
                    continue
                for tag, path, parent, code, payload in visit(record):
                    said = json.dumps(payload, ensure_ascii=False) if with_payload else None
                    rows.append((int(record_id), tag, path, parent, code, said))
                    if len(rows) >= chunk:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return emit


def emit_nodes(records: DataFrame, payload: bool = True) -> DataFrame:
    """The tagged nodes of ``records`` (record_id, raw; other columns are ignored).

    Null, empty and unreadable ``raw`` give no row, a null record_id none either. A record that was
    delivered twice with one text gives its nodes once; one with several texts gives the nodes of each.
    """
    nodes = records.select("record_id", "raw").where("record_id is not null and raw is not null")
    once = nodes.withColumn("_h", F.xxhash64("raw")).dropDuplicates(["record_id", "_h"]).drop("_h")
    return once.mapInPandas(_emitter(payload), TAGGED)


def write_node_tables(tagged: DataFrame, path: str) -> None:
    """One pass: the tagged stream goes to one folder per tag."""
    tagged.write.mode("overwrite").partitionBy("node_kind").parquet(path)


def node_tables(spark: SparkSession, path: str) -> DataFrame:
    """The keys of all four tables together: record_id, node_kind, node_path, parent_path, code."""
    whole = None
    for tag in TAGS:
        one = node_table(spark, path, tag).select("record_id", F.lit(tag).alias("node_kind"), "node_path", "parent_path", "code")
        whole = one if whole is None else whole.unionByName(one)
    return whole


def node_table(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """One table under its own schema; only this tag's folder is read."""
    said = F.from_json("payload", PAYLOADS[tag])
    whole = spark.read.schema(TAGGED).parquet(path).where(F.col("node_kind") == tag)
    return whole.select("record_id", "node_path", "parent_path", "code", said.alias("p")).select(
        "record_id", "node_path", "parent_path", "code", "p.*"
    )
