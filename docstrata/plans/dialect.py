"""Two spellings of SQL: Spark's, which runs, and the ANSI one that the oracle runs."""

from __future__ import annotations


class Spark:
    """Tables are read in place by Spark's Parquet reader, so Catalyst prunes columns and pushes filters.

    Relations that the caller gives (plans.apply) are named by their views instead.
    """

    def __init__(self, folder: str = "", given: dict[str, str] | None = None):
        self.folder = folder
        self.given = given or {}

    def has(self, name: str) -> bool:
        return name in self.given

    def table(self, name: str) -> str:
        return self.given.get(name) or f"parquet.`{self.folder}/{name}.parquet`"

    def matches(self, x: str, pattern: str) -> str:
        return f"({x} RLIKE r'{pattern}')"

    def replace(self, x: str, pattern: str, by: str = "''") -> str:
        return f"regexp_replace({x}, r'{pattern}', {by})"

    def extract(self, x: str, pattern: str, group: int) -> str:
        return f"regexp_extract({x}, r'{pattern}', {group})"

    def lines(self) -> str:
        return f"SELECT doc_id, pos, line FROM {self.table('documents')} LATERAL VIEW posexplode(split(text, '\\n')) e AS pos, line"

    def matches_all(self, table: str, columns: str, text: str, pattern: str) -> str:
        """(columns, n, item): every match of the pattern's group 1, numbered from 0."""
        return f"SELECT {columns}, n, item FROM {table} LATERAL VIEW posexplode(regexp_extract_all({text}, r'{pattern}', 1)) e AS n, item"

    def listed(self, x: str, order: str) -> str:
        """x of the rows of a group in the given order, with blanks between."""
        return f"listagg({x}, ' ') WITHIN GROUP (ORDER BY {order})"

    def each(self, columns: str, items: list[str], table: str) -> str:
        """(columns, item): a row for each item of the list that is not null."""
        return f"SELECT {columns}, item FROM {table} LATERAL VIEW explode(filter(array({', '.join(items)}), x -> x IS NOT NULL)) e AS item"

    def quoted(self, x: str) -> str:
        """A string as JSON, null as null."""
        return f"coalesce(nullif(substring(to_json(named_struct('x', {x})), 6, length(to_json(named_struct('x', {x}))) - 6), ''), 'null')"

    def sha256(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def last_known(self, x: str) -> str:
        return f"last_value({x}) IGNORE NULLS"


class Ansi:
    def has(self, name: str) -> bool:
        return False

    def table(self, name: str) -> str:
        return name

    def matches(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, '{pattern}')"

    def replace(self, x: str, pattern: str, by: str = "''") -> str:
        return f"regexp_replace({x}, '{pattern}', {by}, 'g')"

    def extract(self, x: str, pattern: str, group: int) -> str:
        return f"regexp_extract({x}, '{pattern}', {group})"

    def lines(self) -> str:
        return (
            "SELECT doc_id, CAST(unnest(range(len(s))) AS INT) AS pos, unnest(s) AS line "
            "FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents) q"
        )

    def matches_all(self, table: str, columns: str, text: str, pattern: str) -> str:
        return (
            f"SELECT {columns}, CAST(unnest(range(len(s))) AS INT) AS n, unnest(s) AS item "
            f"FROM (SELECT {columns}, regexp_extract_all({text}, '{pattern}', 1) AS s FROM {table}) q"
        )

    def listed(self, x: str, order: str) -> str:
        return f"string_agg({x}, ' ' ORDER BY {order})"

    def each(self, columns: str, items: list[str], table: str) -> str:
        return f"SELECT {columns}, unnest(list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)) AS item FROM {table}"

    def quoted(self, x: str) -> str:
        return f"coalesce(CAST(to_json({x}) AS VARCHAR), 'null')"

    def sha256(self, x: str) -> str:
        return f"sha256({x})"

    def last_known(self, x: str) -> str:
        return f"last_value({x} IGNORE NULLS)"
