"""Versions and specifier sets by the published rules of Python packages (PEP 440), as column expressions.

A version becomes a struct that sorts as versions do: epoch, release without its last zeros, pre-release, post-release, development
release, local label.  A text that is no version is null.  ``satisfies`` tests a version against a set such as ``>=1.4,<2,!=1.5.*``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .canonical import let

# The form of a version, in lower case.
FORM = (
    r"^\s*v?(?:([0-9]+)!)?([0-9]+(?:\.[0-9]+)*)(?:[-_.]?(alpha|a|beta|b|preview|pre|c|rc)[-_.]?([0-9]*))?"
    r"(?:-([0-9]+)|[-_.]?(post|rev|r)[-_.]?([0-9]*))?(?:[-_.]?(dev)[-_.]?([0-9]*))?(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?\s*$"
)
# Operators, longest first.
CLAUSE = r"^\s*(===|~=|==|!=|<=|>=|<|>)\s*(.*?)\s*$"
GROUPS = 10
#: Stands between the parts of a version; no version has it.
SEPARATOR = "\x01"
#: Sorts after every number of a version.
LAST = (1 << 63) - 1
FINAL = 4


def _number(text: Column) -> Column:
    return F.coalesce(text.try_cast("bigint"), F.lit(0).cast("bigint"))


def _trimmed(release: Column) -> Column:
    """Without zeros at the end, but for the first number."""
    whole = F.aggregate(F.sequence(F.lit(1), F.size(release)), F.lit(1), lambda most, i: F.when(F.element_at(release, i) != 0, i).otherwise(most))
    return F.slice(release, 1, whole)


def _parts(lower: Column) -> Column:
    """All groups of ``FORM`` by one match, each an empty text where it isn't there, and a last part that is no group; null for another text."""
    split = F.split(F.regexp_replace(lower, FORM, "".join(f"${k}{SEPARATOR}" for k in range(1, GROUPS + 1))), SEPARATOR)
    return F.when(~F.contains(lower, F.lit(SEPARATOR)), F.when(F.size(split) == GROUPS + 1, split))


def _key(parts: Column) -> Column:
    group = lambda i: F.element_at(parts, i)
    kind, post_name, dev_name = group(3), group(6), group(8)
    post = F.when(group(5) != "", _number(group(5))).when(post_name != "", _number(group(7))).otherwise(F.lit(-1).cast("bigint"))
    dev = F.when(dev_name != "", _number(group(9))).otherwise(F.lit(LAST))
    plain = (group(5) == "") & (post_name == "")
    stage = F.when(kind.isin("a", "alpha"), 1).when(kind.isin("b", "beta"), 2).when(kind != "", 3).when(plain & (dev_name != ""), 0).otherwise(FINAL)
    label = lambda x: F.struct(x.rlike("^[0-9]+$").alias("number"), F.when(x.rlike("^[0-9]+$"), _number(x)).otherwise(-1).alias("value"), F.when(x.rlike("^[0-9]+$"), "").otherwise(x).alias("text"))
    local = F.when(group(10) != "", F.transform(F.split(group(10), "[-_.]"), label)).otherwise(F.array().cast("array<struct<number: boolean, value: bigint, text: string>>"))
    return F.struct(
        _number(group(1)).alias("epoch"), let(_numbers(group(2)), _trimmed).alias("release"), stage.alias("stage"), F.when(kind != "", _number(group(4))).otherwise(0).alias("stage_number"),
        post.alias("post"), dev.alias("dev"), local.alias("local"),
    )


def _numbers(release: Column) -> Column:
    return F.transform(F.split(release, r"\."), _number)


def version_key(text: Column) -> Column:
    """``epoch, release, stage, stage_number, post, dev, local`` of a version, in the order of versions; null for another text."""
    return let(_parts(F.lower(text)), lambda parts: F.when(parts.isNotNull(), _key(parts)))


def is_prerelease(key: Column) -> Column:
    return (key["stage"] < FINAL) | (key["dev"] < LAST)


def _public(key: Column) -> Column:
    return F.struct(*(key[c].alias(c) for c in ("epoch", "release", "stage", "stage_number", "post", "dev")))


def _base(key: Column) -> Column:
    return F.struct(key["epoch"].alias("epoch"), key["release"].alias("release"))


def _padded(release: Column, n: Column) -> Column:
    """The first ``n`` numbers of a release, with zeros where it ends before."""
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.coalesce(F.try_element_at(release, i), F.lit(0).cast("bigint")))


def _begins(key: Column, epoch: Column, numbers: Column) -> Column:
    return (key["epoch"] == epoch) & (_padded(key["release"], F.size(numbers)) == numbers)


def _read_clause(clause: Column) -> Column:
    """``operator, text, star, numbers, other, pre`` of a clause: what doesn't depend on the version, ``other`` null where it can't be read."""

    def read(raw: Column) -> Column:
        text = F.lower(raw)
        star = text.endswith(".*")
        stem = F.when(star, F.left(text, F.length(text) - 2)).otherwise(text)
        fields = lambda parts, key: F.struct(
            F.regexp_extract(clause, CLAUSE, 1).alias("operator"), text.alias("text"), star.alias("star"), F.when(parts.isNotNull(), _numbers(F.element_at(parts, 2))).alias("numbers"), key.alias("other"),
            F.coalesce(~star & is_prerelease(key), F.lit(False)).alias("pre"),
        )
        return let(_parts(stem), lambda parts: let(F.when(parts.isNotNull(), _key(parts)), lambda key: fields(parts, key)))

    return let(F.regexp_extract(clause, CLAUSE, 2), read)


def _clause(version: Column, key: Column, clause: Column) -> Column:
    """Whether one clause that was read holds; null if it can't be read."""
    operator, star, numbers, other = clause["operator"], clause["star"], clause["numbers"], clause["other"]
    equal = F.when(star, _begins(key, other["epoch"], numbers)).when(F.size(other["local"]) > 0, key == other).otherwise(_public(key) == _public(other))
    compatible = (_public(key) >= _public(other)) & _begins(key, other["epoch"], F.slice(numbers, 1, F.size(numbers) - 1))
    below = (_public(key) < _public(other)) & ~(~is_prerelease(other) & is_prerelease(key) & (_base(key) == _base(other)))
    above = (_public(key) > _public(other)) & ~((other["post"] < 0) & (key["post"] >= 0) & (_base(key) == _base(other)))
    held = (
        F.when(operator == "==", equal).when(operator == "!=", ~equal).when(star, F.lit(None).cast("boolean")).when((operator == "~=") & (F.size(numbers) > 1), compatible)
        .when(operator == "<=", _public(key) <= _public(other)).when(operator == ">=", _public(key) >= _public(other)).when(operator == "<", below).when(operator == ">", above)
    )
    return F.when(operator == "===", F.lower(F.trim(version)) == clause["text"]).when(other.isNotNull(), held)


def satisfies(version: Column, specifiers: Column, prereleases: bool | None = None) -> Column:
    """Whether a version is in a specifier set; null where either can't be read.

    Pre-releases are only in a set that names one (or where ``prereleases`` says so); an empty set has all final versions.
    """
    clauses = F.transform(F.filter(F.split(specifiers, ","), lambda c: F.trim(c) != ""), _read_clause)

    def judged(read: Column) -> Column:
        named = F.exists(read, lambda c: c["pre"] & ~c["operator"].isin("!=", "", "<", ">"))
        allowed = named if prereleases is None else F.lit(prereleases)

        def of(key: Column) -> Column:
            held = F.transform(read, lambda c: _clause(version, key, c))
            whole = lambda h: F.when(~F.exists(h, lambda x: x.isNull()), F.forall(h, lambda x: x) & (allowed | ~is_prerelease(key)))
            return F.when(key.isNotNull(), let(held, whole))

        return let(version_key(version), of)

    return let(clauses, judged)


def fitted(rows: DataFrame, version: str, specifiers: str, name: str) -> DataFrame:
    """``rows`` with ``name``: whether a row's version is in its specifier set.  Versions and sets repeat, so each distinct pair is judged once."""
    pairs = rows.select(F.col(version).alias("__version"), F.col(specifiers).alias("__specifiers")).distinct()
    judged = pairs.withColumn(name, satisfies(F.col("__version"), F.col("__specifiers")))
    met = (F.col(version) == F.col("__version")) & (F.col(specifiers) == F.col("__specifiers"))  # what is null is in no set and of no version
    return rows.join(judged, met, "left").select(*rows.columns, name)
