"""Canonical JSON, content ids and exact ratios as column expressions.

Canonical JSON is compact, with keys in code-point order at every depth and nulls kept.  Ids are the equality contract of the
whole engine, so floats and control characters other than tab, line feed and carriage return must stay out of hashed values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

BUCKETS = 10_000


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def record(**fields: Column | str | int | bool | None) -> Column:
    """A struct with its fields in code-point order."""
    return F.struct(*((v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in sorted(fields.items())))


def ordered_map(entries: Column) -> Column:
    """The map with its entries in order of key."""
    return F.map_from_entries(F.array_sort(F.map_entries(entries)))


def canonical_json(value: Column) -> Column:
    """``value`` (a record, map or array) as canonical JSON."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def is_canonical(kind: DataType) -> bool:
    """Whether a type's struct fields are in order at every depth, as canonical JSON needs."""
    if isinstance(kind, StructType):
        return kind.names == sorted(kind.names) and all(is_canonical(f.dataType) for f in kind.fields)
    if isinstance(kind, ArrayType):
        return is_canonical(kind.elementType)
    return not isinstance(kind, MapType) or is_canonical(kind.valueType)


def sha256_text(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def content_id(prefix: str, value: Column, digits: int = 16) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.substr(sha256_text(canonical_json(value)), F.lit(1), F.lit(digits)))


def sequence_id(number: Column) -> Column:
    text = number.cast("string")
    return F.when(F.length(text) >= 6, text).otherwise(F.lpad(text, 6, "0"))  # padding would cut a longer one


def digest_bucket(digest: Column, buckets: int = BUCKETS) -> Column:
    """A 256-bit hex digest modulo ``buckets``, by Horner's rule over its eight 32-bit parts."""
    parts = F.regexp_extract_all(digest, F.lit(".{8}"), F.lit(0))  # an array, so the digest is computed once
    return F.aggregate(parts, F.lit(0).cast("bigint"), lambda rest, part: (rest * F.lit((1 << 32) % buckets) + F.conv(part, 16, 10).cast("bigint")) % F.lit(buckets))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Exact ratio at six places, half to even, as text; null for a zero denominator."""
    n, d = numerator.cast("decimal(20,0)"), F.nullif(denominator, F.lit(0)).cast("decimal(20,0)")
    return F.bround(n / d, 6).cast("decimal(26,6)").cast("string")


def ratio_sql(n: str, d: str) -> str:
    """The same in SQL of another engine: whole numbers only, half to even by the remainder."""
    q, r = f"(({n})::HUGEINT * 1000000 // nullif(({d})::HUGEINT, 0))", f"(({n})::HUGEINT * 1000000 % nullif(({d})::HUGEINT, 0))"
    up = f"CASE WHEN 2 * {r} > ({d}) OR 2 * {r} = ({d}) AND {q} % 2 = 1 THEN 1 ELSE 0 END"
    return f"(({q} + {up}) // 1000000)::VARCHAR || '.' || lpad((({q} + {up}) % 1000000)::VARCHAR, 6, '0')"


def bucket_sql(digest: str, buckets: int = BUCKETS) -> str:
    rest = "0"
    for k in range(8):
        rest = f"(({rest} * {(1 << 32) % buckets} + ('0x' || substr({digest}, {8 * k + 1}, 8))::BIGINT) % {buckets})"
    return rest


def normalised_label(text: Column) -> Column:
    """Lower case without outer white space (exact for ASCII; others as lower case, not folded)."""
    return F.lower(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))


def canonical_decimal(text: Column) -> Column:
    """A finite decimal without exponent and superfluous zeros, else null."""
    value = F.when(text.rlike(r"^-?\d{1,20}(\.\d{1,18})?$"), text.try_cast("decimal(38,18)")).cast("string")
    return F.regexp_replace(F.regexp_replace(value, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def truncated_bytes(text: Column, most: int) -> Column:
    """The longest prefix of at most ``most`` UTF-8 bytes, without a broken last character."""
    cut = F.substring(F.encode(text, "utf-8"), 1, most)
    return F.when(F.octet_length(text) <= most, text).otherwise(_whole_characters(cut, most))


def _whole_characters(cut: Column, most: int) -> Column:
    """UTF-8 bytes as text, less a last character that is cut: at most three of its bytes are there."""
    head = [F.substring(cut, 1, most - k) for k in range(4)]
    whole = F.lit(None).cast("string")
    for part in reversed(head):
        whole = F.when(F.is_valid_utf8(part.cast("string")), part.cast("string")).otherwise(whole)
    return whole


def safe_path(path: Column) -> Column:
    """Relative, no parent steps, no backslash or NUL."""
    return (path != "") & ~path.startswith("/") & ~path.rlike(r"[\\\x00]") & ~F.array_contains(F.split(path, "/"), "..")


def safe_name(name: Column) -> Column:
    return name.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*$") & ~F.contains(name, F.lit(".."))


# Revisions that move.
MOVING_REVISIONS = ("main", "master", "head", "latest")


def immutable_revision(revision: Column) -> Column:
    """Whether a revision names one state for good."""
    name = F.lower(F.trim(revision))
    return F.coalesce((name != "") & ~name.isin(*MOVING_REVISIONS), F.lit(False))
