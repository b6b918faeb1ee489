"""Irregular JSON: trees to paths, objects of arrays to rows, recursive searches for keys."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


@udtf(returnType="path string, value string")
class FindKeys:
    """Every value under a key that matches a pattern, with its path: recursive descent over any JSON."""

    def eval(self, text: str, pattern: str) -> Iterator[tuple[str, str]]:
        if text is None:
            return
        try:
            root = json.loads(text)
        except ValueError:
            return
        wanted, stack = re.compile(pattern), [("$", root)]
        while stack:
            path, node = stack.pop()
            pairs = node.items() if isinstance(node, dict) else enumerate(node) if isinstance(node, list) else ()
            for k, v in pairs:
                here = f"{path}.{k}" if isinstance(node, dict) else f"{path}[{k}]"
                if isinstance(node, dict) and wanted.search(k) and not isinstance(v, (dict, list)):
                    yield here, None if v is None else str(v)
                stack.append((here, v))


@udtf(returnType="id string, name string, on_offer boolean")
class FindItems:
    """Objects that look like items, each with the flag of the nearest enclosing discount section."""

    def eval(self, text: str) -> Iterator[tuple[str, str, bool]]:
        if text is None:
            return
        try:
            stack = [(json.loads(text), False)]
        except ValueError:
            return
        while stack:
            node, discount = stack.pop()
            if isinstance(node, dict):
                if "id" in node and "name" in node:
                    yield str(node["id"]), str(node["name"]), discount
                stack += [(v, discount or "discount" in k.lower() or "offer" in k.lower()) for k, v in node.items()]
            elif isinstance(node, list):
                stack += [(v, discount) for v in node]


def values_of_object(json_text: Column, element: str) -> Column:
    """All elements of an object whose values are arrays."""
    return F.flatten(F.map_values(F.from_json(json_text, f"map<string,array<{element}>>")))


def tree_paths(nodes: DataFrame) -> DataFrame:
    """(id, path, depth) of a table of nodes (id, parent, label), from the roots down."""
    return nodes.sparkSession.sql(
        """WITH RECURSIVE t(id, path, depth) AS (SELECT id, label, 1 FROM {nodes} WHERE parent IS NULL
        UNION ALL SELECT n.id, concat(t.path, ' > ', n.label), t.depth + 1 FROM {nodes} n JOIN t ON n.parent = t.id)
        SELECT id, path, depth FROM t""",
        nodes=nodes,
    )
