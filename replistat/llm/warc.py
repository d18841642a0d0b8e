"""Content-addressed WARC archive: payload bytes once, record headers apart, records rebuilt by a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from replistat.llm.common import shared_folder, table

CRLF = "\r\n"
HTTP = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _line(name: str, value: Column) -> Column:
    """One header line, none for a null value."""
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)))


def _urn(id_: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), id_.cast("string"), F.lit(">"))


def write_archive(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", least: int = 1000) -> None:
    """Write ``pages`` (page_id, url, html) as ``path``/headers and ``path``/payloads.

    One record per row. Null html is an empty payload, null url writes no target line, control
    characters in a url are percent-encoded, a null id writes no id line. Payloads of at least
    ``least`` bytes: the row with the largest id is the response, others revisit it; rows that repeat
    the largest id are all responses. Smaller payloads are all responses. Bytes are stored once per
    SHA-256, found by grouping on digest and bytes. An empty table gives empty folders with a schema.
    """
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", body.alias("payload"))
    rows = rows.withColumns({"key": F.sha2("payload", 256), "sha1": F.sha1("payload"), "n": F.octet_length("payload").cast("long")})
    rows.groupBy("key", "payload").agg(F.count(F.lit(1)).alias("records")).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/payloads")

    first = rows.filter(F.col("n") >= least).groupBy("key").agg(F.max("page_id").alias("first_id"))
    named = rows.drop("payload").join(first, "key", "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    uri = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), r"[\x00-\x1F\x7F]", "%20")
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _urn(F.col("page_id"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", uri),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("WARC-Refers-To", F.when(again, _urn(F.col("first_id")))),
        _line("WARC-Profile", F.when(again, F.lit(PROFILE))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", (F.lit(len(HTTP)) + F.when(again, F.lit(0)).otherwise(F.col("n"))).cast("string")),
        F.lit(CRLF),
    )
    named.select("page_id", "url", "key", header.alias("header")).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/headers")


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract("header", rf"\r\n{name}: ([^\r\n]*)\r\n", 1), F.lit(""))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records rebuilt from the archive: page_id, url, header, payload, record (bytes), type, refers_to, intact.

    Headers meet their bytes on the digest; a digest with very many headers is split by adaptive
    execution, as the payload side has one row. ``record`` is header, HTTP head, payload (responses
    only) and two line ends. ``intact``: the bytes still have the digest they are stored under, the
    SHA-1 of the header and the length it names.
    """
    rows = spark.read.parquet(f"{path}/headers").join(spark.read.parquet(f"{path}/payloads").drop("records"), "key")
    is_response = _field("WARC-Type") == "response"
    block = F.concat(F.lit(HTTP).cast("binary"), F.when(is_response, F.col("payload")).otherwise(F.lit("").cast("binary")))
    rows = rows.withColumns({
        "record_type": _field("WARC-Type"), "refers_to": F.regexp_extract(F.coalesce(_field("WARC-Refers-To"), F.lit("")), r"<urn:x-page:(-?\d+)>", 1).try_cast("long"),
        "record": F.concat(F.encode("header", "UTF-8"), block, F.lit(CRLF * 2).cast("binary")), "payload_digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long"),
    })
    intact = (F.sha2("payload", 256) == F.col("key")) & (F.concat(F.lit("sha1:"), F.col("payload_digest")) == _field("WARC-Payload-Digest")) & (
        F.octet_length("record") == F.octet_length("header") + _field("Content-Length").cast("long") + 2 * len(CRLF))
    return rows.withColumn("intact", intact)


def write_warc_files(spark: SparkSession, path: str, out: str) -> None:
    """Standard WARC files from the archive; each record's trailing line ends are the text writer's separator."""
    body = F.col("record").substr(F.lit(1), F.octet_length("record") - 2 * len(CRLF)).cast("string")
    read_archive(spark, path).select(body.alias("value")).write.mode("overwrite").option("lineSep", CRLF * 2).text(out)


def op8_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    write_archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    back = read_archive(spark, path)
    checked = F.when(F.col("intact"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a stored payload does not match its digest")))
    return back.select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to")


QUERIES = {"op8_warc_archive": op8_warc_archive}
ORACLE = {
    "op8_warc_archive": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, html, CAST(strlen(html) AS BIGINT) AS payload_bytes, max(page_id) OVER (PARTITION BY html) AS last_id FROM p)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN last_id END AS refers_to
FROM q""",
}
