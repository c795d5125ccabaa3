"""A list of cleaning steps over a table, checked before anything runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_blank, trim_all

#: Operations and what they take (fixed values).
OPERATIONS = ("rename", "trim", "normalize_blanks", "drop_blank_rows", "select_columns", "drop_columns")


def _columns(now: list[str], operation: dict, required: bool) -> list[str]:
    found = operation.get("columns")
    if found is None and not required:
        return now
    if not isinstance(found, list) or (required and not found):
        raise ValueError(f"{operation['op']} requires a list of columns")
    missing = [c for c in found if c not in now]
    if missing:
        raise ValueError(f"no such columns: {', '.join(map(str, missing))}")
    return found


def _blank(df: DataFrame, c: str) -> Column:
    return is_blank(F.col(f"`{c}`")) if isinstance(df.schema[c].dataType, T.StringType) else F.col(f"`{c}`").isNull()


def apply_operations(df: DataFrame, operations: list[dict]) -> DataFrame:
    """Runs the operations in order; one projection or filter each, which Catalyst merges.

    rename (from, to), trim (columns), normalize_blanks (tokens, columns), drop_blank_rows, select_columns (columns), drop_columns (columns).
    Columns that are not text are neither trimmed nor blanked. An unknown operation, a missing column or a second header of one name is an error.
    """
    for operation in operations:
        op = operation.get("op") if isinstance(operation, dict) else None
        if op not in OPERATIONS:
            raise ValueError(f"unknown operation: {op}")
        names = df.columns
        texts = [c for c in names if isinstance(df.schema[c].dataType, T.StringType)]
        if op == "rename":
            old, new = operation.get("from"), operation.get("to")
            if old not in names or not isinstance(new, str) or not new:
                raise ValueError("rename requires a known column and a name")
            if new in names and new != old:
                raise ValueError(f"there is a column of that name: {new}")
            df = df.select(*[F.col(f"`{c}`").alias(new if c == old else c) for c in names])
        elif op == "select_columns":
            df = df.select(*[F.col(f"`{c}`") for c in _columns(names, operation, True)])
        elif op == "drop_columns":
            gone = set(_columns(names, operation, True))
            df = df.select(*[F.col(f"`{c}`") for c in names if c not in gone])
        elif op == "drop_blank_rows":
            df = df.where(~reduce(lambda a, b: a & b, [_blank(df, c) for c in names])) if names else df
        else:
            chosen = [c for c in _columns(names, operation, False) if c in texts]
            if op == "normalize_blanks":
                if not isinstance(operation.get("tokens"), list):
                    raise ValueError("normalize_blanks requires tokens")
                tokens = [str(x).strip() for x in operation["tokens"]]
                change = lambda c: F.when(trim_all(c).isin(tokens), "").otherwise(c)
            else:
                change = trim_all
            df = df.select(*[(change(F.col(f"`{c}`")) if c in chosen else F.col(f"`{c}`")).alias(c) for c in names])
    return df
