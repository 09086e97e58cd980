"""A content-addressed web archive: payload bytes once by SHA-256, exact record headers apart, records rebuilt by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arachne.llm import shared as S

#: Payloads below this many bytes are never revisits.
REVISIT_BYTES = 1000
#: Distinct payloads up to which their digests and keepers are broadcast: about 50 MB.
KEEPERS = 200_000
#: WARC-Date of records whose time of capture isn't known.
NO_DATE = "1970-01-01T00:00:00Z"
_EOL = r"\r\n"


def write_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Saves and returns (headers, payloads): (header) for each row, (sha256, payload) for each distinct payload.

    Payload: the html in UTF-8, empty if null. Of records with equal payloads of at least REVISIT_BYTES the one with
    the largest id is the response and the others revisit it; all smaller ones are responses. A header holds the
    payload's SHA-1 and SHA-256, the exact url (one with control characters in base64, a null one not at all) and
    date_col (WARC's date format; NO_DATE where it is null or not given).
    """
    date = F.coalesce(F.col(date_col).cast("string"), F.lit(NO_DATE)) if date_col else F.lit(NO_DATE)
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), date.alias("date"), F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("payload")
    ).withColumn("sha256", F.sha2("payload", 256))
    spark = pages.sparkSession
    meta, meta_at = S.write_out(rows.select("page_id", "url", "date", F.length("payload").cast("long").alias("bytes"), F.sha1("payload").alias("sha1"), "sha256"), "records")
    keep, keep_at = S.write_out(meta.groupBy("sha256").agg(F.max("page_id").alias("keeper")), "keepers")
    kind = F.when((F.col("bytes") >= REVISIT_BYTES) & (F.col("page_id") < F.col("keeper")), "revisit").otherwise("response")
    typed = meta.join(keep, "sha256").withColumn("kind", kind)
    header = F.expr(f"""concat(
        'WARC/1.1{_EOL}WARC-Type: ', kind,
        '{_EOL}WARC-Record-ID: <urn:page:', coalesce(cast(page_id as string), ''), '>',
        '{_EOL}WARC-Date: ', date,
        case when url is null then '' when url rlike '[\\x00-\\x1f]' then concat('{_EOL}Target-URI-Base64: ', replace(base64(encode(url, 'UTF-8')), '{_EOL}', '')) else concat('{_EOL}WARC-Target-URI: ', url) end,
        '{_EOL}WARC-Payload-Digest: sha1:', sha1,
        '{_EOL}Payload-SHA256: ', sha256,
        '{_EOL}Content-Type: text/html; charset=utf-8',
        if(kind = 'revisit', concat('{_EOL}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{_EOL}WARC-Refers-To: <urn:page:', cast(keeper as string), '>'), ''),
        '{_EOL}Content-Length: ', if(kind = 'revisit', '0', cast(bytes as string)), '{_EOL}{_EOL}')""")
    headers = S.saved(typed.select(F.encode(header, "UTF-8").alias("header")), "headers")
    # The payload goes to the store with its keeper. A list of keepers of checked size is broadcast, so that payloads don't
    # move; only where keepers' rows repeat (a page twice, null ids) are payloads brought together, to store each once.
    keeper = S.maybe_broadcast(keep.select("sha256", F.struct("keeper").alias("keeper")), keep.count(), KEEPERS)
    owned = lambda table: table.withColumn("keeper", F.struct(F.col("page_id").alias("keeper"))).join(keeper, ["sha256", "keeper"], "left_semi")  # noqa: E731  (structs, as null ids are equal in them)
    repeated = owned(meta.select("page_id", "sha256")).groupBy("sha256").count().where("count > 1")
    stored = owned(rows.select("page_id", "sha256", "payload")).select("sha256", "payload")
    payloads = S.saved(stored if repeated.isEmpty() else stored.dropDuplicates(["sha256"]), "payloads")
    S.remove(spark, meta_at, keep_at)
    S.free_shuffles(spark)
    return headers, payloads


def _field(name: str, value: str) -> Column:
    """The value of a field of the header text `fields`; null without it."""
    found = F.regexp_extract("fields", rf"(?s)\r\n{name}: {value}\r\n", 1)
    return F.when(F.col("fields").rlike(rf"\r\n{name}: "), found)


def _fields() -> dict[str, Column]:
    """What the header text `fields` says."""
    coded = F.unbase64(_field("Target-URI-Base64", r"([^\r]*)")).cast("string")
    return {
        "page_id": F.expr("try_cast(regexp_extract(fields, '\\r\\nWARC-Record-ID: <urn:page:(-?[0-9]*)>\\r\\n', 1) as long)"),
        "url": F.coalesce(_field("WARC-Target-URI", r"([^\r]*)"), coded),
        "record_type": _field("WARC-Type", r"(\w+)"),
        "digest": _field("WARC-Payload-Digest", r"sha1:([0-9a-f]{40})"),
        "sha256": _field("Payload-SHA256", r"([0-9a-f]{64})"),
        "refers_to": F.expr("try_cast(regexp_extract(fields, '\\r\\nWARC-Refers-To: <urn:page:(-?[0-9]+)>\\r\\n', 1) as long)"),
        "content_length": _field("Content-Length", r"([0-9]+)").cast("long"),
    }


def read_records(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """Rows (record, payload): the bytes of each record as a WARC file holds them, and the full payload, which a revisit's record lacks."""
    text = headers.withColumn("fields", F.col("header").cast("string"))
    h = text.select("header", _fields()["sha256"].alias("sha256"), (_fields()["record_type"] == "response").alias("full"))
    joined = h.join(payloads, "sha256", "left")
    return joined.select(F.concat("header", F.when(F.col("full"), F.col("payload")).otherwise(F.lit(b"")), F.lit(b"\r\n\r\n")).alias("record"), "payload")


def read_index(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """Rows (page_id, payload_bytes, payload_digest, record_type, refers_to, url), read from the records that the archive's two tables rebuild.

    Every record is taken apart again: its header's length and both digests are held against the bytes of its block, or
    for a revisit of the payload that it stands for; what differs fails the query. Cases: null html is the empty
    payload; rows that repeat an id with equal payloads are responses each; a null page_id never refers to another page,
    and is a response; among ties of equal payloads the largest id is the response; very long pages are stored and
    hashed whole; an empty table gives an empty archive; other columns are ignored.
    """
    cut = read_records(headers, payloads).withColumn("fields", F.concat(F.split(F.col("record").cast("string"), "\r\n\r\n", 2)[0], F.lit("\r\n")))
    block = cut.withColumns(_fields()).withColumn("block", F.expr("substring(record, octet_length(fields) + 3, length(record) - octet_length(fields) - 6)"))
    block = block.withColumn("full", F.when(F.col("record_type") == "revisit", F.col("payload")).otherwise(F.col("block")))
    good = (F.length("block") == F.col("content_length")) & (F.sha1("full") == F.col("digest")) & (F.sha2("full", 256) == F.col("sha256"))
    checked = F.when(F.coalesce(good, F.lit(False)), F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("damaged record of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("?")))).cast("string"))
    return block.select("page_id", F.length("full").cast("long").alias("payload_bytes"), checked.alias("payload_digest"), "record_type", "refers_to", "url")


ORACLE = f"""
WITH r AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest, url FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS keeper FROM r)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id < keeper THEN keeper END AS refers_to, url
FROM k"""
