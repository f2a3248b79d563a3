"""Flattening of JSON values of any depth.

Column expressions follow a known schema only; key paths of unknown depth need a
recursion, so this one step runs in Arrow batches. The helpers live inside the factory
so that they travel to the workers with the function.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

ROW_TYPE = "struct<row:int,context:string,cells:array<struct<column:string,text:string>>>"


def _flattener():
    import json

    def leaves(value, prefix=""):
        """Key paths (``a.b``, ``a[0].c``) and texts of the scalars in an object."""
        for key, item in value.items():
            path = f"{prefix}.{key}" if prefix else str(key)
            if isinstance(item, dict):
                yield from leaves(item, path)
            elif isinstance(item, list):
                for i, part in enumerate(item):
                    if isinstance(part, dict):
                        yield from leaves(part, f"{path}[{i}]")
                    elif part is not None:
                        yield f"{path}[{i}]", str(part)
            elif item is not None:
                yield path, str(item)

    def as_row(number, item, scalar_name):
        if isinstance(item, dict):
            context = " ".join(str(v) for v in item.values() if v is not None)
            cells = [{"column": p, "text": t} for p, t in leaves(item)]
        else:
            context = str(item)
            cells = [{"column": scalar_name, "text": context}]
        return {"row": number, "context": context, "cells": cells}

    def line(text):
        try:
            return as_row(None, json.loads(text), "value")
        except (ValueError, RecursionError):
            return {"row": None, "context": text, "cells": [{"column": "raw_line", "text": text}]}

    def document(text):
        try:
            data = json.loads(text)
            if isinstance(data, list):
                return [as_row(i, item, "item") for i, item in enumerate(data, 1)]
            return [as_row(1, data, "item")] if isinstance(data, dict) else []
        except (ValueError, RecursionError):
            return None

    return line, document


def line_rows():
    """UDF: one JSON value to its row; text that does not parse is kept as ``raw_line``."""
    line, _ = _flattener()

    def convert(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([line(t) for t in texts], columns=["row", "context", "cells"])

    return F.pandas_udf(convert, ROW_TYPE)


def document_rows():
    """UDF: one JSON document to the rows of its items; null if it does not parse."""
    _, document = _flattener()

    def convert(texts: pd.Series) -> pd.Series:
        return texts.map(document)

    return F.pandas_udf(convert, f"array<{ROW_TYPE}>")
