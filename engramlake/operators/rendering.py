"""Contents as text: canonical hashes, renderings and redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: E-mail addresses and home folders, fixed patterns.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
HOME = r"(/Users/|/home/)[^/\s]+"


def canonical_text() -> Column:
    """The text whose hash identifies a content: confidence, frequency and end of an event play no role."""
    c, kind = F.col, F.col("kind")
    return (
        F.when(kind == "Text", c("text"))
        .when(kind == "Fact", F.concat_ws(":", F.lit("fact"), c("subject"), c("predicate"), c("object")))
        .when(kind == "Preference", F.concat_ws(":", F.lit("pref"), c("key"), c("value")))
        .when(kind == "Relationship", F.concat_ws(":", F.lit("rel"), c("person_a"), c("person_b"), c("relation")))
        .when(kind == "Pattern", F.concat_ws(":", F.lit("pattern"), c("trigger"), F.concat_ws(",", c("actions"))))
        .when(kind == "Event", F.concat_ws(":", F.lit("event"), c("title"), c("start")))
    )


def content_hash() -> Column:
    return F.sha2(canonical_text(), 256)


def rendered(dialect: str = "api") -> Column:
    """Content as a line of text. Dialects: api ("k = v"), digest ("k: v", other kinds "[complex content]"), compression
    ("k: v", other kinds null)."""
    c, kind = F.col, F.col("kind")
    equals = " = " if dialect == "api" else ": "
    line = (
        F.when(c("kind") == "Text", c("text"))
        .when(c("kind") == "Fact", F.concat_ws(" ", c("subject"), c("predicate"), c("object")))
        .when(c("kind") == "Preference", F.concat(c("key"), F.lit(equals), c("value")))
    )
    if dialect == "digest":
        return line.otherwise("[complex content]")
    if dialect == "compression":
        return line
    return (
        line.when(c("kind") == "Relationship", F.concat_ws(" ", c("person_a"), c("relation"), c("person_b")))
        .when(c("kind") == "Pattern", F.concat(c("trigger"), F.lit(" -> "), F.concat_ws(", ", c("actions"))))
        .when(c("kind") == "Event", F.concat_ws(" @ ", c("title"), c("start")))
    )


def short(text: Column, characters: int = 300) -> Column:
    """Longer texts cut, with three dots; cut between characters, never inside one."""
    return F.when(F.length(text) > characters, F.concat(F.substring(text, 1, characters), F.lit("..."))).otherwise(text)


def redact_contacts(text: Column) -> Column:
    """E-mail addresses and home folders taken out."""
    return F.regexp_replace(F.regexp_replace(text, EMAIL, "[redacted-email]"), HOME, "~")
