"""Structured program documents (JSON): register maps, and op trees as node tables."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.batches import batched

NODE = "module string, module_no int, node_id int, parent_id int, depth int, branch string, ord int, kind string, register string, offset bigint, var string"
#: Fixed by the document format: the lists of child ops by kind of node, and their branches.
CHILDREN = {"Cond": (("then_ops", "then"), ("else_ops", "else")), "Seq": (("ops", "body"),), "Loop": (("body", "body"), ("ops", "body"))}


def walk(text: str | None) -> list[tuple] | None:
    """Rows of NODE of one document, in pre-order; a module without ops gives one row without a node."""
    if text is None:
        return None
    try:
        doc = json.loads(text)
    except ValueError:
        return None
    out: list[tuple] = []
    for number, module in enumerate(doc.get("modules") or []):
        stack: list[tuple[Any, int | None, int, str, int]] = [(op, None, 0, "body", k) for k, op in enumerate(module.get("ops") or [])][::-1]
        if not stack:
            out.append((module.get("name"), number, None, None, 0, "body", 0, None, None, None, None))
        while stack:
            op, parent, depth, branch, order = stack.pop()
            kind, body = next(iter(op.items())) if isinstance(op, dict) and op else (None, None)
            body = body if isinstance(body, dict) else {}
            addr = body.get("addr") if isinstance(body.get("addr"), dict) else {}
            fixed = (addr.get("Fixed") or {}).get("offset")
            out.append((module.get("name"), number, len(out), parent, depth, branch, order, kind, (addr.get("Symbolic") or {}).get("register"), None if fixed is None else int(fixed), body.get("var")))
            inner = [(child, len(out) - 1, depth + 1, b, k) for field, b in CHILDREN.get(kind, ()) for k, child in enumerate(body.get(field) or [])]
            stack += inner[::-1]
    return out


def op_nodes(documents: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, NODE...) of each document: one row per op. Texts that are not JSON give none.

    Trees nest to any depth, so each document is walked once in Python; nothing is shuffled.
    """
    nodes = batched(walk, f"array<struct<{', '.join(f.replace(' ', ':', 1) for f in NODE.split(', '))}>>")
    return documents.select(key, F.inline(nodes(F.col(text))))


def register_map(documents: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, register, offset) of each document; the last of a name wins."""
    items = F.from_json(F.col(text), "register_map array<struct<name:string, offset:bigint>>")["register_map"]
    return documents.select(key, F.posexplode(items).alias("_i", "_r")).groupBy(key, F.col("_r.name").alias("register")).agg(F.max_by("_r.offset", "_i").alias("offset"))


def placed(nodes: DataFrame, registers: DataFrame, key: str) -> DataFrame:
    """Nodes with the offsets of named registers filled in; unknown names have none."""
    found = registers.select(key, "register", F.col("offset").alias("_at"))
    return nodes.join(found, [key, "register"], "left").withColumn("offset", F.when(F.col("register").isNotNull(), F.col("_at")).otherwise(F.col("offset"))).drop("_at")
