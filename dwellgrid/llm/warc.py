"""Web archives: write pages as WARC records, read them back along verified record boundaries.

Writing is Spark's text writer with the end of a record as its line end, so tasks that are repeated or
speculative leave one copy. Equal payloads are stored once: later ones become revisit records.

Reading does not trust the magic at a place, because a payload can hold it. Each task lists, for every
place of the magic in its files, where the record would end: a candidate and its successor. From the
start of each file, pointer jumping (the reached set doubles its stride every round) marks the
candidates that lie on the chain; the rest is payload.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellgrid.llm.common import quoted

# Fixed values of the format.
VERSION = "WARC/1.1"
BREAK = "\r\n"
RECORD_END = BREAK + BREAK
MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
LENGTH = re.compile(rb"\r\ncontent-length:[ \t]*([0-9]{1,18})[ \t]*\r\n", re.I)

#: Payloads below this are always stored in full.
LEAST_SHARED = 100
#: Records of one file at most, so that a file fits a reading task.
RECORDS_A_FILE = 5_000

CANDIDATE = (
    "file string, begin long, after long, size long, kind string, record_id string, refers string, uri string,"
    " stated string, payload_bytes long, digest string"
)


def records(pages: DataFrame, key: str, url: str, page: str) -> DataFrame:
    """One row per page: its record without the end. Of equal payloads the smallest key is kept in full."""
    rows = pages.select(
        quoted(key).cast("long").alias("page_id"),
        F.regexp_replace(F.coalesce(quoted(url).cast("string"), F.lit("")), r"[\x00-\x20\x7f]", "%20").alias("url"),
        F.coalesce(quoted(page).cast("string"), F.lit("")).alias("html"),
    ).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    first = (
        rows.where(F.octet_length("html") >= LEAST_SHARED)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies"))
        .where("copies > 1")
        .select(F.col("digest").alias("shared"), "first_id")
    )
    rows = rows.join(first, F.col("digest") == F.col("shared"), "left")
    revisit = F.coalesce(F.col("page_id") != F.col("first_id"), F.lit(False))
    header = [
        (F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        (F.lit("WARC-Record-ID: <urn:page:"), F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        (F.lit("WARC-Target-URI: "), F.col("url")),
        (F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        (F.lit("Content-Type: "), F.lit("text/html; charset=utf-8")),
    ]
    lines = [F.lit(VERSION), *(F.concat(*pair) for pair in header)]
    refers = F.when(revisit, F.concat(F.lit(f"{BREAK}WARC-Refers-To: <urn:page:"), F.col("first_id").cast("string"), F.lit(">")))
    body = F.when(revisit, "").otherwise(F.col("html"))
    return rows.select(
        F.concat(
            F.concat_ws(BREAK, *lines),
            F.coalesce(refers, F.lit("")),
            F.lit(f"{BREAK}Content-Length: "),
            F.octet_length(body).cast("string"),
            F.lit(RECORD_END),
            body,
        ).alias("value")
    )


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", page: str = "html") -> None:
    """Write an archive of every page into ``folder`` as gzip files.

    Null html is an empty payload, a null key an empty record id, a null url an empty one; equal keys give
    a record each, and of equal payloads all rows with the smallest key are kept in full. Other columns are
    ignored; no pages give an archive without records.
    """
    rows = records(pages, key, url, page)
    rows.write.option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_A_FILE).text(folder)


def _candidates(file: str, data: bytes) -> list[tuple]:
    out = []
    stop, length = -1, LENGTH.search(data)
    for found in MAGIC.finditer(data):
        begin = found.start()
        # The next header end and length are looked for once, however many places of the magic lie before them.
        if stop < begin:
            stop = data.find(b"\r\n\r\n", begin)
        if length is not None and length.start() < begin:
            length = LENGTH.search(data, begin)
        if stop < 0 or length is None:
            break
        if length.end() > stop + 2:
            continue
        body, size = stop + 4, int(length[1])
        after = body + size + 4
        if data[body + size : after] != b"\r\n\r\n":
            continue
        fields = {}
        for line in data[found.end() : stop].split(b"\r\n"):
            name, _, value = line.partition(b":")
            fields[name.strip().lower()] = value.strip().decode("utf-8", "replace")
        payload = data[body : body + size]
        out.append(
            (
                file, begin, after, len(data), fields.get(b"warc-type"), fields.get(b"warc-record-id"), fields.get(b"warc-refers-to"),
                fields.get(b"warc-target-uri"), fields.get(b"warc-payload-digest"), size, hashlib.sha256(payload).hexdigest(),
            )
        )
    _whole(file, data, {begin: after for _, begin, after, *_ in out})
    return out


def _whole(file: str, data: bytes, successor: dict[int, int]) -> None:
    """Raise where the chain from the file's start ends before its end, unless the file breaks off within a record."""
    at = 0
    while at in successor:
        at = successor[at]
    if at == len(data):
        return
    magic = MAGIC.match(data, at)
    stop = data.find(b"\r\n\r\n", at)
    length = LENGTH.search(data, at, stop + 2) if stop >= 0 else None
    if stop < 0:
        broken_off = magic is not None or len(data) - at < len(VERSION) + 2
    else:
        broken_off = magic is not None and length is not None and stop + 4 + int(length[1]) + 4 > len(data)
    if not broken_off:
        raise ValueError(f"{file}: no well-formed record at byte {at} of {len(data)}")


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Every place in the files where a well-formed record could begin, with its successor."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in CANDIDATE.split(",")]
        kinds = [pa.int64() if " long" in f else pa.string() for f in CANDIDATE.split(",")]
        for part in parts:
            for file, content in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                raw = content.as_py() or b""
                found = _candidates(file, gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw)
                columns = list(zip(*found, strict=True)) if found else [[] for _ in names]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,warc}*").load(folder).select("path", "content")
    return files.mapInArrow(batches, CANDIDATE)


def reached(begin: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Which candidates lie on the chain from place 0, by pointer jumping; ``begin`` is ascending."""
    n = len(begin)
    at = np.searchsorted(begin, after)
    jump = np.where((at < n) & (begin[np.minimum(at, n - 1)] == after), at, n)
    jump = np.append(jump, n)
    on = np.zeros(n + 1, bool)
    on[0] = n > 0 and begin[0] == 0
    while True:
        grown = on.copy()
        grown[jump[on]] = True
        if (grown == on).all():
            return on[:n]
        on, jump = grown, jump[jump]


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The records of an archive's files that lie on the chain from the file's start, in ``CANDIDATE``'s columns.

    A file that breaks off within a record ends at its last whole record; anything else that is no record where
    one should begin raises ``ValueError``. Headers have any length. An archive without records gives no rows.
    """

    def chain(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("begin", ignore_index=True)
        return group[reached(group["begin"].to_numpy(), group["after"].to_numpy())]

    return candidates(spark, folder).groupBy("file").applyInPandas(chain, CANDIDATE)


def payloads(found: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to``; a revisit has its response's payload.

    A page id can stand on several records, so the response of a revisit is the one of the id it refers to whose
    payload has the digest that the revisit states.
    """
    number = lambda c: F.expr(f"try_cast(nullif(regexp_extract({c}, '<urn:page:(.*)>', 1), '') AS BIGINT)")
    rows = found.select(number("record_id").alias("page_id"), F.col("kind").alias("record_type"), number("refers").alias("refers_to"), "payload_bytes", "digest", "stated")
    full = rows.where("record_type = 'response' AND page_id IS NOT NULL").groupBy(
        F.col("page_id").alias("full_id"), F.col("digest").alias("full_digest")
    ).agg(F.min("payload_bytes").alias("full_bytes"))
    stated = F.regexp_replace("stated", "^sha256:", "")
    again = rows.where("record_type = 'revisit'").join(full, (F.col("refers_to") == F.col("full_id")) & (stated == F.col("full_digest")), "left")
    return (
        rows.where("record_type = 'response'")
        .select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")
        .unionByName(again.select("page_id", F.col("full_bytes").alias("payload_bytes"), F.col("full_digest").alias("payload_digest"), "record_type", "refers_to"))
    )
