"""Licence texts by digests of their canonical form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm.tables import small

# Names of licences and texts that grant them.
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
)
#: Digests of the canonical forms of entire licences, from the texts that Debian ships.
ENTIRE = (
    ("Apache-2.0", "fc9ffa028053110bf363230820573237249ec02f2aab9e78655c07e76608775a"),
    ("GPL-1.0", "7412ff2677cbe3b67d2b61d311f51117fd0a088c2e4088d244f68725205ef71e"),
    ("GPL-2.0", "3bd042f258c23713d7bdbe60b357b278140c335f8b98d10f884839c03fd8935f"),
    ("GPL-3.0", "e11dc2868c732141453a8a32ecbd8e4ecbc15557f48f9dccbc2b9e021090becd"),
    ("LGPL-2.0", "06f66afedc39c06ef113f8ce043df8c4b61896d0064a75974828928b06694072"),
    ("LGPL-2.1", "7ebe1296044411dba1a546f344d21899dbf82f3ee3c8d6e742bd711db70b0917"),
    ("LGPL-3.0", "b732f620d8e49727b82f5c0330ec38c6b5739e4a48b007b9d690023deae07bfe"),
    ("MPL-1.1", "ed0f7105bdaaa40af19183644353d7c683fbf3beeb13e16f5ebef3461342b253"),
    ("MPL-2.0", "e314442c72eff3a2d7b87ece2ae6c4d440fd043fded85fccd3463ee7b0a0b0fe"),
    ("CC0-1.0", "92f195ae84ff559b03177551e6c1166f57d3cc30f5a7d806b4039e24906bd8de"),
    ("GFDL-1.2", "0d90ce7c40b7d94fdb2c54865c9d05605cccd6b41490c1a0c903f97fd640434b"),
    ("GFDL-1.3", "dfc72622f41cff073eb79e4352db65ec945971bd581b1338954e1ce56ce7b58d"),
)
#: Equivalent spellings after lower-casing, applied in this order.
SPELLINGS = (
    ("licence", "license"),
    ("copyright owner", "copyright holder"),
    ("sublicence", "sublicense"),
    ("https:", "http:"),
    ("&", " and "),
    ("version", "v"),
)


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, one spelling, no punctuation, single spaces; ASCII rules only."""
    form = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    form = F.regexp_replace(form, r"(^|\n)[ \t]*(copyright|\(c\)|©)[^\n]*", "$1")
    for spelling, one in SPELLINGS:
        form = F.replace(form, F.lit(spelling), F.lit(one))
    return F.trim(F.regexp_replace(form, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known_licenses(spark: SparkSession) -> DataFrame:
    """``license, text, digest``: notices by their text, entire licences by the digest of theirs."""
    rows = [(name, text, None) for name, text in KNOWN] + [(name, None, known) for name, known in ENTIRE]
    return spark.createDataFrame(rows, "license string, text string, digest string")


def license_scan(
    documents: DataFrame, licenses: DataFrame, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The licence that a whole text is, and the licences that its single lines are.

    ``licenses`` has license and text, or a digest in place of a text. Whole texts and lines are joined on the digest of their
    canonical form, so case, punctuation, copyright lines and equivalent spellings don't matter and
    nothing but a full match counts. Known digests are broadcast only within a counted bound.

    Returns ``key, digest, license, notices, n_notice_lines``: ``license`` is null without a whole
    match; ``notices`` are the distinct licences of lines, sorted and joined by commas, empty
    without one. A form without words matches nothing, nor do null and empty texts. A digest known
    for several licences means the first by name. Rows equal in key and text get the same result,
    one row each. Other columns are not read.
    """
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    form = digest(F.col("text"))
    form = F.coalesce("digest", form) if "digest" in licenses.columns else form
    known = (
        licenses.where("license is not null").select(form.alias("known"), "license")
        .where(F.col("known") != nothing).groupBy("known").agg(F.min("license").alias("license"))
    )
    known = small(known, known.count())
    whole = documents.select(
        F.col(key).alias("key"), digest(F.col(text)).alias("digest"),
        F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("body"), F.col(text).alias("text"),
    )
    lines = whole.select("key", "body", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    found = (
        lines.select("key", "body", digest(F.col("line")).alias("known")).join(known, "known")
        .groupBy("key", "body", "license").agg(F.count("*").alias("n"))
        .groupBy("key", "body").agg(
            F.array_join(F.sort_array(F.collect_set("license")), ",").alias("notices"), F.sum("n").alias("lines"))
    )  # fmt: skip  # a set holds each known licence once at most
    # equal rows share their lines, so a row has its part of them
    copies = whole.groupBy("key", "body").agg(F.count("*").alias("copies"))
    per_row = found.join(copies, ["key", "body"]).select(
        F.col("key").alias("k"), F.col("body").alias("b"), "notices", F.expr("lines div copies").alias("lines")
    )
    return (
        whole.drop("text").join(known.withColumnRenamed("known", "digest"), "digest", "left")
        .join(per_row, F.col("key").eqNullSafe(F.col("k")) & (F.col("body") == F.col("b")), "left")
        .select(
            F.col("key").alias(key), "digest", "license", F.coalesce("notices", F.lit("")).alias("notices"),
            F.coalesce("lines", F.lit(0)).alias("n_notice_lines"))
    )
