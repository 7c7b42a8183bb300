"""WARC archives, content-addressed (operator 9), in DataFrame functions.

An archive is a folder with two parts. ``payloads``: each distinct payload once, as a WARC resource record named by
the payload's SHA-256. ``headers``: the exact header block of every record. Reading verifies each payload's length
and SHA-256 and joins headers with payloads on that digest, which gives the original records back.

Both parts are gzipped text files that Spark writes and reads in parallel. Records begin with a version line and a
boundary field that holds the archive's random name, so a payload can hold "WARC/1.1" without being split.

Defined results: a null payload is empty; of records with equal payloads of at least LEAST bytes the one with the
largest id is response and the others are revisits of it; line breaks in a URL are percent-encoded; a null URL has
no field; repeated rows are repeated records; a record without an id is written, and is never referred to.
"""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm.common import table
from concord.shared import shared_dir

LEAST = 1000
FILE_RECORDS = 2000
CRLF = "\r\n"
DATE = "%Y-%m-%dT%H:%M:%SZ"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _field(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(name + ": "), value.cast("string"), F.lit(CRLF))).otherwise("")


def _first(boundary: str) -> str:
    return f"WARC/1.1{CRLF}WARC-Archive-Boundary: {boundary}{CRLF}"


def records(df: DataFrame, record_id: str, url: str, payload: str, at: str | None = None) -> DataFrame:
    """record_id, url, date, address (SHA-256), digest (SHA-1), bytes, record_type, refers_to: a row for each row of ``df``."""
    date = F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'") if at else F.lit(None).cast("string")
    data = F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary"))
    thin = df.select(F.col(record_id).cast("long").alias("record_id"), F.col(url).cast("string").alias("url"), date.alias("date"), F.sha2(data, 256).alias("address"), F.sha1(data).alias("digest"), F.octet_length(data).cast("long").alias("bytes"))
    owners = thin.where(F.col("bytes") >= LEAST).groupBy("address").agg(F.max("record_id").alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    both = thin.join(owners, "address", "left")
    revisit = F.col("owner").isNotNull() & ~F.col("owner").eqNullSafe(F.col("record_id"))
    return both.select("record_id", "url", "date", "address", "digest", "bytes", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("owner")).alias("refers_to"))


def write(df: DataFrame, path: str, record_id: str = "page_id", url: str = "url", payload: str = "html", at: str | None = None) -> str:
    """Writes every row of ``df`` as a record of a new archive in folder ``path``; the archive's boundary. ``at``: a timestamp
    column for WARC-Date, by default the time of writing."""
    boundary, now = uuid.uuid4().hex, datetime.now(UTC).strftime(DATE)
    options = {"lineSep": CRLF + CRLF, "compression": "gzip", "maxRecordsPerFile": str(FILE_RECORDS)}
    data = F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary"))
    once = df.select(F.sha2(data, 256).alias("address"), data.alias("payload")).groupBy("address").agg(F.first("payload").alias("payload"))
    body = F.concat(
        F.lit(_first(boundary) + "WARC-Type: resource" + CRLF), _field("WARC-Record-ID", F.concat(F.lit("<urn:sha256:"), "address", F.lit(">"))),
        _field("WARC-Date", F.lit(now)), _field("WARC-Target-URI", F.concat(F.lit("urn:sha256:"), "address")),
        F.lit("Content-Length: "), F.octet_length("payload").cast("string"), F.lit(CRLF + CRLF), F.col("payload").cast("string"),
    )
    once.select(body.alias("value")).write.options(**options).text(f"{path}/payloads")
    r = records(df, record_id, url, payload, at)
    revisit = F.col("record_type") == "revisit"
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), _field("WARC-Type", F.col("record_type")), _field("WARC-Date", F.coalesce("date", F.lit(now))), _field("WARC-Record-ID", F.concat(F.lit("<urn:record:"), F.col("record_id").cast("string"), F.lit(">"))),
        _field("WARC-Target-URI", F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))), _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        _field("WARC-Profile", F.when(revisit, PROFILE)), _field("WARC-Refers-To", F.concat(F.lit("<urn:record:"), F.col("refers_to").cast("string"), F.lit(">"))), _field("X-Payload-Address", F.concat(F.lit("sha256:"), "address")), F.lit("Content-Length: "), F.when(revisit, "0").otherwise(F.col("bytes").cast("string")),
    )
    r.select(head.alias("value")).write.options(**options).text(f"{path}/headers")
    return boundary


def _named(head: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(head, rf"(?:^|\r\n){name}: ([^\r\n]*)", 1), F.lit(""))


def payloads(spark: SparkSession, path: str, boundary: str) -> DataFrame:
    """address, payload; a payload whose length or digest is wrong ends the read with an error."""
    rows = spark.read.option("lineSep", _first(boundary)).text(f"{path}/payloads").where("value <> ''")
    head = F.substring_index("value", CRLF + CRLF, 1)
    size = _named(head, "Content-Length").cast("int")
    got = rows.select(_named(head, "WARC-Target-URI").alias("uri"), F.substring(F.col("value").cast("binary"), F.octet_length(head) + 5, size).alias("payload"), size.alias("size"))
    right = (F.octet_length("payload") == F.col("size")) & (F.concat(F.lit("urn:sha256:"), F.sha2("payload", 256)) == F.col("uri"))
    return got.select(F.substring_index("uri", ":", -1).alias("address"), F.when(right, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), "uri")).cast("binary")).alias("payload"))


def headers(spark: SparkSession, path: str) -> DataFrame:
    """record_id, url, record_type, refers_to, digest, address, head: the exact header block of every record."""
    rows = spark.read.option("lineSep", CRLF + CRLF).text(f"{path}/headers").where("value <> ''").withColumnRenamed("value", "head")

    def number(name: str) -> Column:
        return F.regexp_extract(_named(F.col("head"), name), r"(-?\d+)>$", 1).try_cast("long")

    return rows.select(number("WARC-Record-ID").alias("record_id"), _named(F.col("head"), "WARC-Target-URI").alias("url"), _named(F.col("head"), "WARC-Type").alias("record_type"), number("WARC-Refers-To").alias("refers_to"),
                       F.substring_index(_named(F.col("head"), "WARC-Payload-Digest"), ":", -1).alias("digest"), F.substring_index(_named(F.col("head"), "X-Payload-Address"), ":", -1).alias("address"), "head")


def read(spark: SparkSession, path: str, boundary: str) -> DataFrame:
    """The original records: the columns of headers(), payload, and record (the exact bytes of the record: header block, empty
    line, block, two line ends)."""
    got = headers(spark, path).join(payloads(spark, path, boundary), "address")
    block = F.when(F.col("record_type") == "revisit", F.lit("").cast("binary")).otherwise(F.col("payload"))
    return got.withColumn("record", F.concat(F.encode("head", "utf-8"), F.lit(CRLF + CRLF).cast("binary"), block, F.lit(CRLF + CRLF).cast("binary")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    boundary = write(table(spark, sf_dir, "pages"), path)
    return read(spark, path, boundary).select(F.col("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", "refers_to")


QUERIES = {"op9_warc": query}
ORACLES = {
    "op9_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT html, max(page_id) AS owner FROM p WHERE strlen(html) >= 1000 GROUP BY html)
SELECT p.page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN g.owner <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.owner <> p.page_id THEN g.owner END AS refers_to
FROM p LEFT JOIN g ON p.html = g.html""",
}
