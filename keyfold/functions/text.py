"""Column functions over delimited text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def split_fields(line, sep: str) -> Column:
    """Fields of a delimited line without trailing empty ones; a line of separators only has none."""
    line = _c(line)
    s = "\\" + sep if sep in "|.*+?()[]{}^$\\" else sep
    cut = F.regexp_replace(line, f"(?:{s})+$", "")
    return F.when((cut == "") & (line != ""), F.array().cast("array<string>")).otherwise(F.split(cut, s))


def field(line, sep: str, index: int) -> Column:
    """Field ``index`` (from 0), or null beyond the last."""
    return F.get(F.split(_c(line), "\\" + sep if sep in "|.*+?()[]{}^$\\" else sep), F.lit(index))


def parse_or(x, default: float = 0.0) -> Column:
    """A number, or a default for text that is none."""
    return F.coalesce(F.expr(f"try_cast({x} AS DOUBLE)") if isinstance(x, str) else x.try_cast("double"), F.lit(default))


def half_unit_bin(x) -> Column:
    """The half unit at or below a value: 25.3 and 25.0 give 25.0, 25.5 gives 25.5."""
    x = _c(x)
    whole = F.floor(x)
    return F.when(x - whole >= 0.5, whole + 0.5).otherwise(whole.cast("double"))


def composite_key(*columns, sep: str = " ") -> Column:
    """Several key columns as one string; group by the columns, and join them in the last projection."""
    return F.concat_ws(sep, *[_c(c).cast("string") for c in columns])


def or_empty_key(x) -> Column:
    """An empty key gets a name."""
    x = _c(x)
    return F.when(x == "", "empty key").otherwise(x)


def java_hash(text) -> Column:
    """The 32-bit string hash that the JVM's ``hashCode`` gives (text of the basic plane)."""
    return F.expr(f"cast(aggregate(transform(filter(split({text}, ''), c -> c <> ''), c -> cast(ascii(c) AS BIGINT)), 0L, (a, x) -> pmod(a * 31 + x + 2147483648, 4294967296) - 2147483648) AS INT)")


def hash_bucket(text: str, n: int) -> Column:
    """Bucket of a key: |hash| modulo n; the one value without an absolute value is taken modulo n, too."""
    h = java_hash(text).cast("long")
    return F.pmod(F.abs(h), F.lit(n)).cast("int")
