"""License scans by canonical digest, in DataFrame functions only.

An entire text is normalised, digested with SHA-256 and hash-joined to the digests of known license texts. How the text is wrapped,
indented or commented does not matter: notices are cut from the word "copyright" with a year to where the license's own words begin, or to
the end of their line; then all that is no letter or digit becomes one space; spellings are made equal; and a title in front goes.

Defined results: a null or empty text has the digest of the empty text and no license. Repeated rows each get their result; nulls and
extra columns pass through, but for columns that the results replace. An empty table gives an empty result. The license table is a
constant of a few dozen rows, so it is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from copresence.llm.common import quoted, table
from copresence.llm.license_texts import DIGESTS, LICENSES, TITLES

#: Spellings that count as equal, after all has been lower-cased and parted by single spaces, applied in this order.
SPELLINGS = (
    ("licence", "license"), ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("artefact", "artifact"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("favour", "favor"), ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"),
    ("labelled", "labeled"), ("merchantibility", "merchantability"), ("non infringement", "noninfringement"), ("organisation", "organization"),
    ("recognise", "recognize"), ("sub license", "sublicense"), ("copyright copyright", "copyright"), ("copyright holder", "copyright owner"),
    (" all rights reserved", ""), ("http ", "https "),
)
#: How the words behind a notice begin.
BEHIND_NOTICES = (
    "permission is hereby granted", "permission to use", "redistribution and use", "this software is provided", "everyone is permitted",
    "licensed under the", "this program is free software", "this library is free software", "permission is granted to copy", "gnomovision comes with",
    "this program comes with",
)
_GAP = r"[^\p{L}\p{N}]+"
_YEAR = r"(?:\d{4}|[\[<{]?(?:yyyy|year)[\]>}]?)"
NOTICE = rf"(?:copyright|\(c\)|©)[ \t]*(?:\(c\)|©|copyright)?[ \t]*{_YEAR}"
NOTICE_TO_TEXT = rf"(?s){NOTICE}.{{0,400}}?({'|'.join(_GAP.join(x.split()) for x in BEHIND_NOTICES)})"
NOTICE_LINE = rf"{NOTICE}[^\n]*"
TITLE = f"^(?:(?:the )?(?:{'|'.join(sorted(TITLES, key=lambda t: (-len(t), t)))}) )+"


def normalized(text: Column) -> Column:
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NOTICE_TO_TEXT, " $1")
    out = F.regexp_replace(out, NOTICE_LINE, " ")
    out = F.replace(F.replace(out, F.lit("(c)"), F.lit("copyright")), F.lit("©"), F.lit("copyright"))
    out = F.btrim(F.regexp_replace(out, _GAP, " "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.btrim(F.regexp_replace(out, TITLE, ""))


def digest(text: Column) -> Column:
    return F.sha2(normalized(text), 256)


def known_licenses(spark: SparkSession, texts: dict[str, str] = LICENSES, digests: dict[str, str] = DIGESTS) -> DataFrame:
    """(license, license_digest) of texts, and of licenses of which only the digest is kept here."""
    rows = spark.createDataFrame(sorted(texts.items()), "license string, body string").select("license", digest(F.col("body")).alias("license_digest"))
    return rows.unionByName(spark.createDataFrame(sorted(digests.items()), "license string, license_digest string"))


def scan(docs: DataFrame, text: str = "text", texts: dict[str, str] = LICENSES, digests: dict[str, str] = DIGESTS) -> DataFrame:
    """docs with license_digest, of the normalised text, and the license that it is, else null, in place of any columns of those names."""
    kept = [F.col(quoted(c)) for c in docs.columns if c not in ("license_digest", "license")]
    digested = docs.select(*kept, digest(F.col(text)).alias("license_digest"))
    known = known_licenses(docs.sparkSession, texts, digests)
    return digested.join(F.broadcast(known), "license_digest", "left").select(*(F.col(quoted(c)) for c in digested.columns), "license")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest and license of every document."""
    return scan(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "license_digest", "license")


def _quoted_sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql(text: str) -> str:
    out = f"regexp_replace(lower(coalesce({text}, '')), {_quoted_sql(NOTICE_TO_TEXT)}, ' \\1', 'g')"
    out = f"regexp_replace({out}, {_quoted_sql(NOTICE_LINE)}, ' ', 'g')"
    out = f"replace(replace({out}, '(c)', 'copyright'), '©', 'copyright')"
    out = f"trim(regexp_replace({out}, '{_GAP}', ' ', 'g'))"
    for old, new in SPELLINGS:
        out = f"replace({out}, '{old}', '{new}')"
    return f"sha256(trim(regexp_replace({out}, {_quoted_sql(TITLE)}, '')))"


_KNOWN = ", ".join(f"({_quoted_sql(name)}, {_quoted_sql(body)})" for name, body in sorted(LICENSES.items()))
_DIGESTS = ", ".join(f"({_quoted_sql(name)}, {_quoted_sql(value)})" for name, value in sorted(DIGESTS.items()))
ORACLE_SQL = f"""
WITH k AS (SELECT license, {_sql("body")} AS license_digest FROM (VALUES {_KNOWN}) AS v(license, body) UNION ALL SELECT * FROM (VALUES {_DIGESTS}) AS w(license, license_digest)),
d AS (SELECT doc_id, {_sql("text")} AS license_digest FROM documents)
SELECT d.doc_id, d.license_digest, k.license FROM d LEFT JOIN k USING (license_digest)
"""
