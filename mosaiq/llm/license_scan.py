"""License scans: canonical digests of whole texts, hash-joined to the digests of known licences.

Canonical form, in this order: lower case; copyright lines go (a line that begins, after comment marks, with
"copyright", "(c)" or a copyright sign and names a year, a sign or a placeholder; before the first grant any line that
begins with "copyright", and what is indented below it), SPDX lines, lines that only reserve all
rights, and list marks at the beginning of a line; punctuation, symbols and white space, of Unicode too, become single
spaces; equivalent spellings become one. The digest is SHA-256 of the trimmed result. A licence is known by several
digests: with each of its usual headings and without, and long ones with and without what follows their terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm.license_texts import DIGESTS, HEADINGS, TEXTS

#: What a grant begins with: a heading ends before the first of these.
GRANTS = ("permission", "redistribution", "licensed", "everyone", "this software", "terms and conditions", "this is free")
#: Lines of a heading that go, in lower case: any that begins with copyright, and what is indented below it.
HEADING_LINE = r"(?m)^[^a-z0-9\n]*copyright\b[^\n]*(?:\n(?:[ \t]{2,}|\t)[a-z0-9][^\n]*)*$"
#: Lines that go, in lower case.
SPDX_LINE = r"(?m)^[^a-z0-9\n]*spdx-[a-z-]+:[^\n]*$"
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(?:(?:portions[ \t]+)?copyright\b[^\n]*(?:\(c\)|©|[0-9]{4}|[\[<{][^\n]*[\]>}])|\(c\)[^\n]*[0-9]{4}|©)[^\n]*$"
RIGHTS_LINE = r"(?m)^[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*$"
LIST_MARK = r"(?m)^[^a-z0-9\n(]*\(?(?:[0-9]{1,2}|[a-z])[.)](?:[ \t]+|$)"
NOT_A_WORD = r"[\p{P}\p{S}\p{Z}\p{Cc}\p{Cf}]+"
#: Spellings that count as equal, after punctuation has become spaces: pattern, replacement.
SPELLINGS = (
    (r"(^| )licenc(e|i)", "$1licens$2"),
    (r"(^| )(sub|non) (licens|infringement)", "$1$2$3"),
    (r"(^| )(author|organ|util|recogn|initial|general|special|summar|standard|custom)is(e|ation|ing)", "$1$2iz$3"),
    (r"(^| )(fav|behavi|col|hon|lab)our", "$1$2or"),
    (r"(^| )(acknowledg|judg)ement", "$1$2ment"),
    (r"(^| )copyright owner", "$1copyright holder"),
    (r"(^| )https( |$)", "$1http$2"),
    (r"(^| )per cent( |$)", "$1percent$2"),
    (r"(^| )whilst( |$)", "$1while$2"),
)


def canonical(text: Column) -> Column:
    """The canonical form of a text; null stays null."""
    t = F.lower(text)
    at = F.least(*(F.nullif(F.instr(t, g), F.lit(0)) for g in GRANTS))  # null without a grant
    t = F.when(at > 1, F.concat(F.regexp_replace(F.substring(t, F.lit(1), at - 1), HEADING_LINE, " "), F.substring(t, at, F.length(t)))).otherwise(t)
    for line in (SPDX_LINE, COPYRIGHT_LINE, RIGHTS_LINE, LIST_MARK, NOT_A_WORD):
        t = F.regexp_replace(t, line, " ")
    for pattern, new in SPELLINGS:
        t = F.regexp_replace(t, pattern, new)
    return F.trim(t)


def headed_texts() -> list[tuple[str, str]]:
    """license_id and text of the licences kept whole, under each of their headings."""
    return sorted((k, f"{h}\n\n{t}") for k, texts in TEXTS.items() for t in texts for h in HEADINGS.get(k, ("",)))


def known_licenses(spark: SparkSession) -> DataFrame:
    """The licences that come with the library: license_id, canonical_sha256."""
    own = spark.createDataFrame(headed_texts(), "license_id string, text string").select("license_id", F.sha2(canonical(F.col("text")), 256).alias("canonical_sha256"))
    return own.unionByName(spark.createDataFrame(sorted((k, d) for k, ds in DIGESTS.items() for d in ds), "license_id string, canonical_sha256 string"))


def scan_licenses(documents: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Per row of documents: doc_id, canonical_sha256, license_id (null where no licence has that digest).

    known: license_id and text or canonical_sha256; of licences with one digest the smallest id counts. Null text: null digest and no
    licence. An empty canonical form never matches. Repeated rows give repeated results; other columns are ignored.
    The known side is a table of licences; Catalyst broadcasts it where it is small and shuffles by digest otherwise.
    """
    known = known_licenses(documents.sparkSession) if known is None else known
    digest = F.col("canonical_sha256") if "canonical_sha256" in known.columns else F.sha2(canonical(F.col("text")), 256)
    digests = known.select(digest.alias("canonical_sha256"), "license_id").where((F.col("canonical_sha256") != F.sha2(F.lit(""), 256)) & F.col("license_id").isNotNull())
    digests = digests.groupBy("canonical_sha256").agg(F.min("license_id").alias("license_id"))
    own = documents.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("canonical_sha256"))
    return own.join(digests, "canonical_sha256", "left").select("doc_id", "canonical_sha256", "license_id")


def _sql_canonical(text: str) -> str:
    low = f"lower({text})"
    at = f"least({', '.join(f"nullif(instr({low}, '{g}'), 0)" for g in GRANTS)})"
    t = f"(case when {at} > 1 then regexp_replace(left({low}, {at} - 1), '{HEADING_LINE}', ' ', 'g') || substr({low}, {at}) else {low} end)"
    for line in (SPDX_LINE, COPYRIGHT_LINE, RIGHTS_LINE, LIST_MARK, NOT_A_WORD):
        t = f"regexp_replace({t}, '{line}', ' ', 'g')"
    for pattern, new in ((p, n.replace("$", "\\")) for p, n in SPELLINGS):
        t = f"regexp_replace({t}, '{pattern}', '{new}', 'g')"
    return f"sha256(trim({t}))"


def oracle() -> str:
    texts = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in headed_texts())
    digests = ", ".join(f"('{k}', '{d}')" for k, ds in DIGESTS.items() for d in ds)
    return f"""with k as (select min(license_id) as license_id, canonical_sha256 from (select license_id, {_sql_canonical("text")} as canonical_sha256 from (values {texts}) as t(license_id, text) union all select * from (values {digests}) as u(license_id, canonical_sha256)) group by 2),
d as (select doc_id, {_sql_canonical("text")} as canonical_sha256 from documents)
select d.doc_id, d.canonical_sha256, k.license_id from d left join k using (canonical_sha256)"""
