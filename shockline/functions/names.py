"""Column functions on symbol ids, paths and text lines."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def node_name(id_: Column) -> Column:
    """Display name of an id: after the last ``::``, else after the last backslash."""
    return F.when(id_.contains("::"), F.substring_index(id_, "::", -1)).otherwise(F.substring_index(id_, "\\", -1))


def short_class(id_: Column) -> Column:
    """Class of an id without its namespace."""
    return F.substring_index(F.substring_index(id_, "::", 1), "\\", -1)


def short_symbol(id_: Column) -> Column:
    """Id without its namespace; the member stays."""
    return F.concat(short_class(id_), F.regexp_extract(id_, r"(?s)(::.*)$", 1))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def is_php(path: Column) -> Column:
    return F.lower(path).endswith(".php")


def plural(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, " " + one).otherwise(" " + many))
