"""Identifiers as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n"


def canonical_id(c: Column) -> Column:
    """A UUID in any of its notations (upper case, braces, urn:uuid:, without hyphens) as lower-case
    text with hyphens; any other id trimmed and in lower case; null for null."""
    t = F.lower(F.btrim(c, F.lit(BLANKS)))
    bare = F.regexp_replace(t, r"^urn:uuid:|[{}-]", "")
    spelled = F.regexp_replace(bare, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(bare.rlike("^[0-9a-f]{32}$"), spelled).otherwise(t)

