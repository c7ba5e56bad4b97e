"""Scalar functions on names and texts, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AUTO_MERGE, REVIEW = 0.92, 0.75
LABEL_URL = "https://dailymed.nlm.nih.gov/dailymed/drugInfo.cfm?setid="


def normalize_name(c: Column) -> Column:
    """Trimmed, lower case, the dashes U+2010..2014 as '-', each run of white space as one space.

    A null stays null, a blank becomes empty. White space is Unicode's, not only the space."""
    bare = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return F.regexp_replace(F.translate(bare, "‐‑‒–—", "-----"), r"(?U)\s+", " ")


def trigrams(c: Column) -> Column:
    """Distinct trigrams of a text's words, each padded by two spaces before and one after."""
    words = F.filter(F.split(F.lower(c), r"(?U)[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def similarity_of(a: Column, b: Column) -> Column:
    """Jaccard similarity of two trigram arrays; 0 where both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both.cast("double"), (F.size(a) + F.size(b) - both).cast("double")), F.lit(0.0))


def similarity(a: Column, b: Column) -> Column:
    return similarity_of(trigrams(a), trigrams(b))


def tier(score: Column) -> Column:
    return F.when(score >= AUTO_MERGE, "auto_merge").when(score >= REVIEW, "review").otherwise("no_match")


def truncate(c: Column, n: int) -> Column:
    """At most n characters; a longer text ends in one ellipsis, without white space before it."""
    cut = F.regexp_replace(F.substring(c, 1, n - 1), r"(?U)\s+$", "")
    return F.when(F.length(c) <= n, c).otherwise(F.concat(cut, F.lit("…")))


def join_capped(items: Column, most: int = 8) -> Column:
    """The first items separated by commas, then how many more there are."""
    more = F.size(items) - most
    return F.concat(F.array_join(F.slice(items, 1, most), ", "), F.when(more > 0, F.concat(F.lit(", and "), more.cast("string"), F.lit(" more"))).otherwise(""))


def dedup_key(entity_type: Column, content: Column) -> Column:
    """The type and the first 160 characters of the content in lower case with single spaces."""
    flat = F.regexp_replace(F.regexp_replace(F.lower(content), r"(?U)\s+", " "), "^ | $", "")
    return F.concat(entity_type, F.lit(":"), F.substring(flat, 1, 160))


def entity_id(prefix: str, n: Column) -> Column:
    return F.format_string(f"{prefix}-%06d", n)


def label_url(set_id: Column) -> Column:
    return F.concat(F.lit(LABEL_URL), set_id)


def rich_lines(c: Column) -> Column:
    """Items of a numbered list if a text has one; else its sentences, two to a line."""
    items = F.filter(F.transform(F.split(c, r"(?=\b\d+\.\s)"), F.trim), lambda x: x != "")
    sentences = F.filter(F.split(c, r"(?<=[.!?])\s+"), lambda x: F.trim(x) != "")
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(sentences) - 1) / 2)).cast("int")), lambda i: F.array_join(F.slice(sentences, i * 2 + 1, 2), " "))
    return F.when(F.size(items) > 1, items).otherwise(pairs)


def encode_payload(name: Column, body: Column) -> Column:
    """A package as JSON text: its bytes in base 64."""
    return F.to_json(F.struct(name.alias("package_name"), F.base64(body).alias("xml_base64")))


def decode_payload(payload: Column) -> Column:
    read = F.from_json(payload, "package_name string, xml_base64 string")
    return F.struct(read["package_name"].alias("package_name"), F.unbase64(read["xml_base64"]).alias("xml"))
