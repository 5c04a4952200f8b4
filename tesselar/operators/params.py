"""Named parameters of statements."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (int, float)):
        return repr(v)
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def bound(predicate: str, args: dict) -> Column:
    """Predicate with its :name parameters as literals."""
    import re

    def put(m: re.Match) -> str:
        return _literal(args[m[1]]) if m[1] and m[1] in args else m[0]

    return F.expr(re.sub(r"'(?:[^'\\]|\\.)*'|(?<!:):([A-Za-z_]\w*)", put, predicate))


@dataclass
class Prepared:
    """Named statements of a session with :name or ? parameters."""

    spark: SparkSession
    statements: dict[str, str] = field(default_factory=dict)

    def prepare(self, name: str, sql: str) -> None:
        if name in self.statements:
            raise ValueError(f"{name} is prepared already")
        self.statements[name] = sql

    def execute(self, name: str, args: dict | list | None = None) -> DataFrame:
        if name not in self.statements:
            raise ValueError(f"{name} is not prepared")
        return self.spark.sql(self.statements[name], args=args)

    def deallocate(self, name: str | None = None) -> None:
        """One statement, or all of them."""
        if name is None:
            self.statements.clear()
        elif self.statements.pop(name, None) is None:
            raise ValueError(f"{name} is not prepared")
