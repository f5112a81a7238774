"""WARC archives: writing, and reading with boundary-chain verification.

Writing: payloads of 100 bytes or more that occur more than once are stored once, by the
row with the least id (``response``); the others become ``revisit`` records, whose block
has the HTTP header only. Each task writes archives of a bounded number of records with
Spark's text writer, whose line separator is the record's last line end, so archives go
to any store that Spark reaches.

Reading: the text reader splits archives at the version line, so large files are read by
many tasks, each of which emits candidate records: the offset of the version line and,
from the header that follows, the offset where the record ends. A version line may also
stand inside a payload. Pointer jumping over (offset -> successor) from the file's start
keeps the reachable candidates only; the offsets of unreachable ones lie inside a record
and their text is put back into it. Only offsets and digests are exchanged, and text only
for records that contain a version line. Texts that are read a second time are found by
their SHA-256, so both scans may split the archives in any way.

Defined cases: null html is the empty payload, null url the empty target; ids may be null
(written as nothing, read as null) or repeated (one record per row; rows with the group's
least id are all responses, so ties stay whole); a record's id names its page, and where a page's id is null or
repeated a random part makes it unique; payloads of any length up to Spark's two billion bytes of a
string are whole; line ends in urls are percent-encoded; an empty table gives
an archive without records and an empty result; extra columns are ignored. Bytes before
the first version line, after a broken header or beyond a truncated record end the chain,
and records after them are not returned.
"""

from __future__ import annotations

from datetime import UTC, datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from readloom.llm.common import materialize, shared_dir, small_or_shuffled

VERSION = "WARC/1.1"
MAGIC = VERSION + "\r\n"
#: Payload bytes from which equal payloads become revisits.
LEAST_SHARED = 100
#: Records of one archive file at most.
FILE_RECORDS = 50_000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _concat(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def with_first(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """pages as page_id, url, html, digest, bytes, first_id (the least id of the payload's group, else null)."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"),
        F.coalesce(F.col("url"), F.lit("")).alias("url"),
        html.alias("html"),
        F.sha2(html.cast("binary"), 256).alias("digest"),
        F.octet_length(html).cast("bigint").alias("bytes"),
    )
    # Partial counts fold a large group of equal payloads before the exchange; only repeated digests remain.
    groups = rows.where(F.col("bytes") >= LEAST_SHARED).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    groups = materialize(groups.where("n > 1").select("digest", "first_id"), merge=True)
    return rows.join(small_or_shuffled(groups), "digest", "left")


def with_name(pages: DataFrame, id_col: str) -> DataFrame:
    """page_id and twice of each null or repeated id; materialized, no row for ids that occur once."""
    ids = pages.select(F.col(id_col).cast("bigint").alias("page_id")).groupBy("page_id").agg(F.count("*").alias("n"))
    return materialize(ids.where("n > 1 and page_id is not null").select("page_id", F.lit(True).alias("twice")), merge=True)


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", html_col: str = "html", date: str | None = None) -> None:
    """Writes one record per row of pages into archive files below path; date: that of all records, by default now."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = with_first(pages, id_col, html_col).join(small_or_shuffled(with_name(pages, id_col)), "page_id", "left")
    plain = F.col("page_id").isNotNull() & F.col("twice").isNull()
    name = F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.when(plain, "").otherwise(F.concat(F.lit(":"), F.expr("uuid()"))))
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = _concat("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: ", F.col("bytes").cast("string"), "\r\n\r\n")
    block = F.when(revisit, http).otherwise(_concat(http, F.col("html")))
    record = _concat(
        MAGIC,
        "WARC-Type: ",
        F.when(revisit, "revisit").otherwise("response"),
        "\r\nWARC-Record-ID: <urn:page:",
        name,
        f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: ",
        url,
        "\r\nWARC-Payload-Digest: sha256:",
        F.col("digest"),
        F.when(revisit, _concat(f"\r\nWARC-Profile: {REVISIT_PROFILE}\r\nWARC-Refers-To: <urn:page:", F.col("first_id").cast("string"), ">")).otherwise(""),
        "\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: ",
        F.octet_length(block).cast("string"),
        "\r\n\r\n",
        block,
        "\r\n",
    )
    rows.select(record.alias("value")).write.option("lineSep", "\r\n").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """The text after each version line of each archive: file, split, seq (its order), text, size and sha, the digest of text.

    A split's rows come in file order, and its first row begins where the rows of the splits before
    it end, so offsets are running sums of lengths. split and seq hold within one scan, sha in all.
    """
    raw = spark.read.option("lineSep", MAGIC).text(path)
    rows = raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("seq"),
        F.col("value").alias("text"),
    )
    return rows.withColumn("size", F.octet_length("text").cast("bigint") + len(MAGIC)).withColumn("sha", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def _header(name: str) -> Column:
    """A header field of the record whose text follows the version line, or null."""
    head = F.substring_index(F.col("text"), "\r\n\r\n", 1)
    found = F.regexp_extract(F.concat(F.lit("\r\n"), head), rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", found)


def _scan(spark: SparkSession, path: str) -> DataFrame:
    """Candidates without their text: place, lengths, and the fields and digest of a record that is whole within its text."""
    rows = candidates(spark, path)
    head_end = F.instr("text", "\r\n\r\n")
    head = F.octet_length(F.substring_index(F.col("text"), "\r\n\r\n", 1)).cast("bigint") + 4
    length = F.expr("try_cast(clen AS BIGINT)")
    rows = rows.withColumn("clen", _header("Content-Length")).withColumn("head", F.when(head_end > 0, head)).withColumn("clen", length)
    need = F.col("head") + F.col("clen") + 4  # of the text, with both line ends after the block
    rows = rows.withColumn("need", F.when(F.col("clen") >= 0, need))
    whole = (F.col("need") == F.col("size") - len(MAGIC)) & F.col("text").endswith("\r\n\r\n")
    return rows.withColumn("whole", F.coalesce(whole, F.lit(False))).select("file", "split", "seq", "size", "sha", "need", "whole", *(c.alias(n) for n, c in _fields(F.col("whole")).items()))


def _payload() -> Column:
    """The payload of the record whose whole text is in column text."""
    return F.expr(
        "substring(text, instr(text, '\\r\\n\\r\\n') + 3 + locate('\\r\\n\\r\\n', substring(text, instr(text, '\\r\\n\\r\\n') + 4)) + 4, "
        "char_length(text) - instr(text, '\\r\\n\\r\\n') - 3 - locate('\\r\\n\\r\\n', substring(text, instr(text, '\\r\\n\\r\\n') + 4)) - 3 - 4)"
    )


def _fields(valid: Column) -> dict[str, Column]:
    """What a reader reports of a record whose whole text is in column text, where valid."""
    rest = F.expr("substring(text, instr(text, '\\r\\n\\r\\n') + 4)")
    block = F.expr("substring(text, instr(text, '\\r\\n\\r\\n') + 4, char_length(text) - instr(text, '\\r\\n\\r\\n') - 7)")
    http_at = F.instr(rest, "\r\n\r\n")
    payload = _payload()
    kind = _header("WARC-Type")
    http_length = F.regexp_extract(F.substring_index(block, "\r\n\r\n", 1), r"(?i)\r\nContent-Length:[ \t]*([0-9]+)", 1)
    return {
        "kind": F.when(valid, kind),
        "page": F.when(valid, F.regexp_extract(_header("WARC-Record-ID"), "<urn:page:([^:>]*)", 1)),
        "refers": F.when(valid, F.regexp_extract(_header("WARC-Refers-To"), "<urn:page:([^>]*)>", 1)),
        "stated": F.when(valid, F.regexp_extract(_header("WARC-Payload-Digest"), "sha256:([0-9a-f]+)", 1)),
        "http_length": F.when(valid & (http_length != ""), http_length.cast("bigint")),
        "digest": F.when(valid & (kind != "revisit") & (http_at > 0), F.sha2(payload.cast("binary"), 256)),
        "payload_size": F.when(valid & (kind != "revisit") & (http_at > 0), F.octet_length(payload).cast("bigint")),
    }


def reachable(offsets: np.ndarray, successors: np.ndarray) -> np.ndarray:
    """Which candidates the chain from offset 0 visits; pointer jumping, in log2(candidates) rounds.

    A successor that is no candidate's offset ends the chain.
    """
    n = len(offsets)
    at = np.searchsorted(offsets, successors)
    real = (at < n) & (offsets[np.minimum(at, n - 1)] == successors) if n else np.zeros(0, bool)
    jump = np.append(np.where(real, at, n), n)  # n: nowhere
    seen = np.zeros(n + 1, dtype=bool)
    if n and offsets[0] == 0:
        seen[0] = True
    for _ in range(max(1, n.bit_length())):
        seen[jump[np.nonzero(seen[:n])[0]]] = True
        jump = jump[jump]
    return seen[:n]


def _chain(part: pd.DataFrame) -> pd.DataFrame:
    """Of one file's candidates: which are reached, and the offset of the record each lies in.

    A record is whole if its chain goes on at a candidate or at the file's end; a broken one is no record.
    """
    part = part.sort_values("at", ignore_index=True)
    at, end = part["at"].to_numpy(), part["end"].to_numpy()
    ends = part["stop"].max() if len(part) else 0
    seen = reachable(at, np.where(end < 0, -1, end))
    sound = seen & (np.isin(end, at) | (end == ends))
    owner = np.maximum.accumulate(np.where(seen, np.arange(len(part)), -1)) if len(part) else np.zeros(0, int)
    part["rec"] = np.where(owner >= 0, at[np.maximum(owner, 0)], -1) if len(part) else at
    inside = owner >= 0
    good = np.zeros(len(part), dtype=bool)
    good[inside] = sound[owner[inside]] & (at[inside] < end[owner[inside]])
    part["rec"] = part["rec"].where(good, -1)
    part["start"] = seen & good
    return part[["file", "split", "seq", "sha", "at", "rec", "start"]]


def verify(skinny: DataFrame) -> DataFrame:
    """file, split, seq, sha, at, rec and start of each candidate that lies in a record of the chain.

    Offsets are running sums: per split, then over the splits of a file. A file's candidates are one
    group; it holds offsets only, and is bounded by the size of a file.
    """
    sums = skinny.groupBy("file", "split").agg(F.sum("size").alias("sum"))
    base = F.coalesce(F.sum("sum").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sums.select("file", "split", base.alias("base"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("file", "split").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A file's first piece of text stands before its first version line.
    placed = skinny.withColumn("before", before).join(bases, ["file", "split"]).withColumn("text_at", F.col("base") + F.col("before"))
    placed = placed.where("text_at > 0").select(
        "file",
        "split",
        "seq",
        "sha",
        (F.col("text_at") - len(MAGIC)).alias("at"),
        F.coalesce(F.col("text_at") + F.col("need"), F.lit(-1)).cast("bigint").alias("end"),
        (F.col("text_at") + F.col("size") - len(MAGIC)).alias("stop"),
    )
    return placed.groupBy("file").applyInPandas(_chain, "file string, split bigint, seq bigint, sha binary, at bigint, rec bigint, start boolean").where("rec >= 0")


_SKINNY = ["file", "split", "seq", "sha", "size", "need"]


def _texts(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """sha and text, once, of each sha of wanted (materialized): a second scan, whatever its splits."""
    shas = wanted.select("sha").distinct()
    return candidates(spark, path).select("sha", "text").join(small_or_shuffled(materialize(shas, merge=True)), "sha", "left_semi").groupBy("sha").agg(F.first("text").alias("text"))


def _joined(spark: SparkSession, path: str, pieces: DataFrame) -> DataFrame:
    """text of each record (file, rec) that contains version lines; pieces: its candidates, materialized."""
    parts = pieces.join(_texts(spark, path, pieces), "sha").groupBy("file", "rec").agg(F.sort_array(F.collect_list(F.struct("at", "text"))).alias("parts"))
    return parts.select(F.array_join(F.transform("parts", lambda p: p["text"]), MAGIC).alias("text"))


def _split_up(found: DataFrame) -> DataFrame:
    """The candidates of records that contain version lines; materialized."""
    records = materialize(found.where("not start").select("file", "rec").distinct(), merge=True)
    return materialize(found.join(small_or_shuffled(records), ["file", "rec"], "left_semi"), merge=True)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives below path: page_id, record_type, refers_to, payload_bytes, payload_digest.

    Of a response the payload is measured; of a revisit its length and digest are read from its headers.
    """
    scanned = materialize(_scan(spark, path))
    found = materialize(verify(scanned.select(*_SKINNY)), merge=True)
    pieces = _split_up(found)
    place = ["file", "split", "seq"]
    fields = list(_fields(F.lit(True)))
    whole = scanned.join(found.where("start").select(*place, "rec"), place)
    if pieces.count():
        # Records that contain a version line: their pieces are read again and joined.
        whole = whole.join(pieces.select("file", "rec").distinct(), ["file", "rec"], "left_anti")
        joined = _joined(spark, path, pieces)
        whole = whole.select(*fields).unionByName(joined.select(*(c.alias(n) for n, c in _fields(F.lit(True)).items())))
    revisit = F.col("kind") == "revisit"
    return whole.select(
        F.expr("try_cast(page AS BIGINT)").alias("page_id"),
        F.when(revisit, F.col("http_length")).otherwise(F.col("payload_size")).alias("payload_bytes"),
        F.when(revisit, F.col("stated")).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("kind").alias("record_type"),
        F.when(revisit, F.expr("try_cast(refers AS BIGINT)")).alias("refers_to"),
    )


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """The pages of the archives below path, one row per record: page_id, url, html, record_type, refers_to.

    A revisit gets the payload of a response with the digest that it states, or null if there is none. Texts
    are read again and found by their digests: by broadcast of the digests up to BROADCAST_ROWS records, else by a shuffle.
    """
    found = materialize(verify(_scan(spark, path).select(*_SKINNY)), merge=True)
    pieces = _split_up(found)
    records = found.where("start").join(pieces.select("file", "rec").distinct(), ["file", "rec"], "left_anti")
    # Equal texts (of one page written twice) are one text and several records.
    times = materialize(records.groupBy("sha").agg(F.count("*").cast("int").alias("times")), merge=True)
    texts = _texts(spark, path, times).join(small_or_shuffled(times), "sha")
    whole = texts.select("text", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).select("text").unionByName(_joined(spark, path, pieces))
    fields = _fields(F.lit(True))
    rows = whole.select(
        fields["page"].try_cast("bigint").alias("page_id"),
        F.coalesce(_header("WARC-Target-URI"), F.lit("")).alias("url"),
        F.when(fields["kind"] != "revisit", _payload()).alias("html"),
        fields["kind"].alias("record_type"),
        F.when(fields["kind"] == "revisit", fields["refers"].try_cast("bigint")).alias("refers_to"),
        F.when(fields["kind"] == "revisit", fields["stated"]).alias("stated"),
        fields["digest"].alias("digest"),
    )
    columns = ["page_id", "url", "html", "record_type", "refers_to"]
    named = materialize(rows.where("stated is not null").select(F.col("stated").alias("digest")).distinct(), merge=True)
    shared = rows.where("stated is null").join(small_or_shuffled(named), "digest", "left_semi").dropDuplicates(["digest"])
    shared = shared.select(F.col("digest").alias("stated"), F.col("html").alias("shared"))
    again = rows.where("stated is not null").join(shared, "stated", "left").withColumn("html", F.col("shared"))
    return rows.where("stated is null").select(*columns).unionByName(again.select(*columns))


def round_trip(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", path: str | None = None) -> DataFrame:
    """Writes pages as WARC below path (by default in the shared folder) and reads the archives back."""
    spark = pages.sparkSession
    path = path or shared_dir(spark) + "/warc"
    write_warc(pages, path, id_col, html_col)
    return read_warc(spark, path)
