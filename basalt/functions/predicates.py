"""Comparisons of a column with a literal."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F


class Op(Enum):
    EQUALS = "="
    NOT_EQUALS = "<>"
    LESS_THAN = "<"
    LESS_THAN_EQUALS = "<="
    GREATER_THAN = ">"
    GREATER_THAN_EQUALS = ">="
    LIKE = "like"  # a string holds another; numbers are equal

    @classmethod
    def of(cls, op: Op | str) -> Op:
        return op if isinstance(op, Op) else cls(op.strip().lower().replace("==", "=").replace("!=", "<>"))


def compare(column: Column, op: Op | str, value: Column, is_string: bool = False) -> Column:
    op = Op.of(op)
    if op is Op.LIKE:
        return F.contains(column, value) if is_string else column == value
    return {
        Op.EQUALS: column == value,
        Op.NOT_EQUALS: column != value,
        Op.LESS_THAN: column < value,
        Op.LESS_THAN_EQUALS: column <= value,
        Op.GREATER_THAN: column > value,
        Op.GREATER_THAN_EQUALS: column >= value,
    }[op]
