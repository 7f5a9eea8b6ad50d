"""Text clean-up, flattening of nested columns and content hashes. All JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .names import quoted

# The code points that count as white space around a value.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def _as_column(c: Column | str) -> Column:
    return F.col(quoted(c)) if isinstance(c, str) else c


def _bare(value: Column) -> Column:
    """True when the first and the last character are printable ASCII, so that there is nothing to trim.

    Comparing two characters is several times faster than trimming, and nearly all values pass.
    """
    last = F.substring(value, -1, 1)
    return (value >= "!") & (value < "\x7f") & (last >= "!") & (last < "\x7f")


def strip(c: Column | str) -> Column:
    """Remove white space (all Unicode kinds) from both ends. The value is used several times: pass a column
    rather than a long expression."""
    value = _as_column(c)
    return F.when(_bare(value), value).otherwise(F.btrim(value, F.lit(WHITESPACE)))


def blank_to_null(c: Column | str) -> Column:
    """Trim; an empty rest is NULL."""
    value = _as_column(c)
    return F.when(_bare(value), value).otherwise(F.nullif(F.btrim(value, F.lit(WHITESPACE)), F.lit("")))


def is_blank(c: Column | str) -> Column:
    """True for NULL and for text that is only white space."""
    return F.coalesce(F.btrim(_as_column(c), F.lit(WHITESPACE)) == "", F.lit(True))


def stringify(c: Column | str) -> Column:
    """Scalar to text: NULL becomes the empty string, booleans ``true`` / ``false``."""
    return F.coalesce(_as_column(c).cast("string"), F.lit(""))


def list_to_json(c: Column | str) -> Column:
    return F.to_json(_as_column(c))


def flatten_nested(df: DataFrame, separator: str = ".", lists_as_json: bool = True) -> DataFrame:
    """Turn struct columns, at every depth, into one column per leaf named ``outer.inner``."""
    leaves: list[Column] = []

    def visit(field_type: T.DataType, reference: str, name: str) -> None:
        if isinstance(field_type, T.StructType):
            for child in field_type.fields:
                visit(child.dataType, f"{reference}.{quoted(child.name)}", f"{name}{separator}{child.name}")
        elif lists_as_json and isinstance(field_type, (T.ArrayType, T.MapType)):
            leaves.append(F.to_json(F.col(reference)).alias(name))
        else:
            leaves.append(F.col(reference).alias(name))

    for field in df.schema.fields:
        visit(field.dataType, quoted(field.name), field.name)
    return df.select(*leaves)


def content_hash(columns: list[str], length: int = 16) -> Column:
    """SHA-256 of the row as canonical JSON (columns in name order, NULLs kept), shortened to ``length`` hex digits."""
    row = F.struct(*[F.col(quoted(c)).alias(c) for c in sorted(columns)])
    return F.substring(F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256), 1, length)
