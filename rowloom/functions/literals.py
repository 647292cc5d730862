"""SQL literals and identifiers for script output, parameterised by a dialect profile."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Dialect:
    """How one database writes identifiers, literals, INSERT batches and script frames."""

    name: str
    open_quote: str = '"'
    close_quote: str = '"'
    quote_escape: str = '""'
    uppercase: bool = False
    true: str = "TRUE"
    false: str = "FALSE"
    date: str = "'{}'"
    timestamp: str = "'{}'"
    uuid: str = "'{}'"
    binary: str = "X'{}'"
    escape_backslash: bool = False
    batch_rows: int = 1000
    multi_row: bool = True
    header: str = "INSERT INTO {table} ({columns}) VALUES\n"
    row_prefix: str = "("
    row_suffix: str = ")"
    separator: str = ",\n"
    footer: str = ";\n"
    begin: str = "BEGIN;\n"
    commit: str = "COMMIT;\n"
    disable: str = ""
    enable: str = ""

    def quote(self, identifier: str) -> str:
        name = identifier.upper() if self.uppercase else identifier
        return self.open_quote + name.replace(self.close_quote, self.quote_escape) + self.close_quote


# Statements that switch constraint checking off and on.
_ORACLE_SWITCH = (
    "BEGIN\n  FOR c IN (SELECT table_name, constraint_name FROM user_constraints"
    " WHERE constraint_type IN ('R', 'C', 'U'))\n  LOOP\n"
    "    EXECUTE IMMEDIATE 'ALTER TABLE ' || DBMS_ASSERT.ENQUOTE_NAME(c.table_name, false) ||"
    " ' {} CONSTRAINT ' || DBMS_ASSERT.ENQUOTE_NAME(c.constraint_name, false);\n  END LOOP;\nEND;\n/\n"
)
_SQLSERVER_SWITCH = (
    "DECLARE @sql NVARCHAR(MAX) = N'';\nSELECT @sql += N'ALTER TABLE ' + QUOTENAME(s.name) + N'.' +"
    " QUOTENAME(t.name) + N' {} CONSTRAINT ALL; '\nFROM sys.tables t JOIN sys.schemas s ON"
    " t.schema_id = s.schema_id;\nEXEC sp_executesql @sql;\n"
)
_BACKTICK = {"open_quote": "`", "close_quote": "`", "quote_escape": "``"}
_MYSQL = {
    **_BACKTICK, "begin": "START TRANSACTION;\n", "escape_backslash": True,
    "disable": "SET FOREIGN_KEY_CHECKS = 0;\n", "enable": "SET FOREIGN_KEY_CHECKS = 1;\n",
}
# The dialect profiles.
DIALECTS = {
    d.name: d
    for d in (
        Dialect("standard", disable="SET CONSTRAINTS ALL DEFERRED;\n"),
        Dialect("bigquery", open_quote="`", close_quote="`", quote_escape="\\`", date="DATE '{}'",
                timestamp="TIMESTAMP '{}'", binary="FROM_HEX('{}')", begin="BEGIN TRANSACTION;\n", commit="COMMIT TRANSACTION;\n"),
        Dialect("cockroachdb", binary="'\\x{}'"),
        Dialect("db2", uppercase=True, true="1", false="0", binary="BX'{}'", begin="BEGIN TRANSACTION;\n"),
        Dialect("derby", date="DATE('{}')", timestamp="TIMESTAMP('{}')", multi_row=False, begin=""),
        Dialect("h2", disable="SET REFERENTIAL_INTEGRITY FALSE;\n", enable="SET REFERENTIAL_INTEGRITY TRUE;\n"),
        Dialect("hive", **_BACKTICK, binary="UNHEX('{}')", multi_row=False, begin="", commit=""),
        Dialect("hsqldb", begin="START TRANSACTION;\n", disable="SET DATABASE REFERENTIAL INTEGRITY FALSE;\n",
                enable="SET DATABASE REFERENTIAL INTEGRITY TRUE;\n"),
        Dialect("mariadb", **_MYSQL, true="1", false="0"),
        Dialect("mysql", **_MYSQL, true="1", false="0"),
        Dialect("oracle", uppercase=True, true="1", false="0", binary="HEXTORAW('{}')", date="TO_DATE('{}', 'YYYY-MM-DD')",
                timestamp="TO_TIMESTAMP('{}', 'YYYY-MM-DD HH24:MI:SS.FF')", multi_row=False,
                header="INSERT ALL\n", row_prefix="INTO {table} ({columns}) VALUES (", separator="\n",
                footer="\nSELECT * FROM dual;\n", begin="SET TRANSACTION READ WRITE;\n",
                disable=_ORACLE_SWITCH.format("DISABLE"), enable=_ORACLE_SWITCH.format("ENABLE")),
        Dialect("postgresql", binary="'\\x{}'", disable="SET CONSTRAINTS ALL DEFERRED;\n-- Alternatively, to fully disable: ALTER TABLE ... DISABLE TRIGGER ALL;\n"),
        Dialect("redshift", binary="FROM_HEX('{}')"),
        Dialect("sqlite", true="1", false="0", batch_rows=100, begin="BEGIN TRANSACTION;\n",
                disable="PRAGMA foreign_keys = OFF;\n", enable="PRAGMA foreign_keys = ON;\n"),
        Dialect("sqlserver", open_quote="[", close_quote="]", quote_escape="]]", true="1", false="0", binary="0x{}",
                begin="BEGIN TRANSACTION;\n", commit="COMMIT TRANSACTION;\n",
                disable=_SQLSERVER_SWITCH.format("NOCHECK"), enable=_SQLSERVER_SWITCH.format("WITH CHECK CHECK")),
    )
}


def escape_text(text: Column, dialect: Dialect) -> Column:
    """NUL removed, line breaks to blanks, quotes doubled, backslashes doubled where the dialect needs it."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\")) if dialect.escape_backslash else text
    out = F.translate(out, "\0", "")
    out = F.replace(out, F.lit("\r\n"), F.lit(" "))
    out = F.translate(out, "\n\r", "  ")
    return F.replace(out, F.lit("'"), F.lit("''"))


def _wrap(form: str, value: Column) -> Column:
    before, after = form.split("{}", 1)
    return F.concat(F.lit(before), value, F.lit(after))


def _plain_double(value: Column) -> Column:
    """A double without exponent or trailing zeros, all printed digits and the sign kept, that of a negative zero too.

    NaN and infinities have no literal. Numbers printed without an exponent only lose their trailing zeros. For others
    the point is moved inside the printed digits, so nothing is computed and nothing is rounded.
    """
    shown = value.cast("string")
    plain = F.rtrim(F.rtrim(shown, F.lit("0")), F.lit("."))
    finite = ~(F.isnan(value) | value.isin(float("inf"), float("-inf")))
    return F.when(finite, F.when(shown.contains("E"), _moved_point(value)).otherwise(plain))


def _moved_point(value: Column) -> Column:
    """The digits of a double printed with an exponent, without it."""
    printed = F.lower(value.cast("string"))
    fraction = F.regexp_extract(printed, r"\.(\d*?)0*(?:e|$)", 1)
    digits = F.concat(F.regexp_extract(printed, r"^-?(\d+)", 1), fraction)
    shift = F.coalesce(F.regexp_extract(printed, r"e(-?\d+)$", 1).try_cast("int"), F.lit(0))
    point = F.length(F.regexp_extract(printed, r"^-?(\d+)", 1)) + shift
    size = F.length(digits)
    text = (
        F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .when(point >= size, F.concat(digits, F.repeat(F.lit("0"), point - size)))
        .otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, size)))
    )
    return F.concat(F.when(value < 0, F.lit("-")).otherwise(F.lit("")), text)


def timestamp_text(value: Column) -> Column:
    """Seconds with the fraction's trailing zeros removed, at least one digit kept."""
    text = F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return F.regexp_replace(text, r"0{1,5}$", "")


def literal(value: Column, kind: T.DataType, dialect: Dialect, is_uuid: bool = False) -> Column:
    """The value as SQL text; null prints NULL."""
    if isinstance(kind, T.BooleanType):
        text = F.when(value, F.lit(dialect.true)).when(~value, F.lit(dialect.false))
    elif isinstance(kind, T.DateType):
        text = _wrap(dialect.date, F.date_format(value, "yyyy-MM-dd"))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = _wrap(dialect.timestamp, timestamp_text(value))
    elif isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        text = _wrap(dialect.uuid if is_uuid else "'{}'", value if is_uuid else escape_text(value, dialect))
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        # A float's own digits, not those of the double it becomes.
        text = _plain_double(value.cast("string").cast("double") if isinstance(kind, T.FloatType) else value)
    elif isinstance(kind, T.ArrayType):
        items = F.transform(value, lambda v: literal(v, kind.elementType, dialect))
        text = F.concat(F.lit("ARRAY["), F.array_join(items, ", "), F.lit("]"))
    elif isinstance(kind, T.BinaryType):
        text = _wrap(dialect.binary, F.lower(F.hex(value)))
    elif isinstance(kind, (T.IntegralType, T.DecimalType)):
        text = value.cast("string")
    else:
        raise TypeError(f"{kind.simpleString()} values have no SQL literal")
    return F.coalesce(text, F.lit("NULL"))
