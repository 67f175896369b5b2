"""One text for two engines: the few forms in which Spark's SQL and DuckDB's differ, so that a decision is written once and can be held against another engine."""

from __future__ import annotations

from threadlens.functions.text import java_pattern
from threadlens.session import sql_text

Steps = list[tuple[str, str]]


class Spark:
    """Forms of Spark SQL."""

    def found(self, column: str, pattern: str) -> str:
        return f"rlike({column}, {sql_text('(?i)' + java_pattern(pattern))})"

    def first(self, column: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({column}, {sql_text('(?i)' + java_pattern(pattern))}, {group})"

    def swap(self, column: str, pattern: str, by: str) -> str:
        return f"regexp_replace({column}, {sql_text('(?i)' + java_pattern(pattern))}, {sql_text(by)})"

    def count(self, column: str, pattern: str) -> str:
        return f"regexp_count({column}, {sql_text('(?i)' + java_pattern(pattern))})"

    def all(self, column: str, pattern: str) -> str:
        return f"regexp_extract_all({column}, {sql_text('(?i)' + java_pattern(pattern))}, 0)"

    def holds(self, column: str, *ids: str) -> str:
        return f"arrays_overlap({column}, array({', '.join(repr(i) for i in ids)}))"

    def kept(self, rows: list[tuple[str, str]]) -> str:
        """The names whose condition holds, in order."""
        return f"array_compact(array({', '.join(f'CASE WHEN {c} THEN {sql_text(n)} END' for n, c in rows)}))"

    def joined(self, array: str, mark: str) -> str:
        return f"array_join({array}, {sql_text(mark)})"

    size = staticmethod(lambda array: f"size({array})")


class Duck(Spark):
    """Forms of DuckDB."""

    @staticmethod
    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def found(self, column: str, pattern: str) -> str:
        return f"regexp_matches({column}, {self.quoted('(?i)' + pattern)})"

    def first(self, column: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({column}, {self.quoted('(?i)' + pattern)}, {group})"

    def swap(self, column: str, pattern: str, by: str) -> str:
        return f"regexp_replace({column}, {self.quoted('(?i)' + pattern)}, {self.quoted(by.replace('$1', chr(92) + '1'))}, 'g')"

    def count(self, column: str, pattern: str) -> str:
        return f"len(regexp_extract_all({column}, {self.quoted('(?i)' + pattern)}))"

    def all(self, column: str, pattern: str) -> str:
        return f"regexp_extract_all({column}, {self.quoted('(?i)' + pattern)})"

    def holds(self, column: str, *ids: str) -> str:
        return f"list_has_any({column}, [{', '.join(self.quoted(i) for i in ids)}])"

    def kept(self, rows: list[tuple[str, str]]) -> str:
        return f"list_filter([{', '.join(f'CASE WHEN {c} THEN {self.quoted(n)} END' for n, c in rows)}], lambda x: x IS NOT NULL)"

    def joined(self, array: str, mark: str) -> str:
        return f"array_to_string({array}, {self.quoted(mark)})"

    size = staticmethod(lambda array: f"len({array})")


SPARK, DUCK = Spark(), Duck()


def stepped(source: str, steps: Steps, out: list[str]) -> str:
    """The steps over a SELECT of DuckDB; a step may use those before it."""
    return f"SELECT {', '.join(out)} FROM (SELECT *, {', '.join(f'{e} AS {n}' for n, e in steps)} FROM ({source}))"
