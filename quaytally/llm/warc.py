"""WARC archives of pages, and a globally ordered index of their captures by external merging.

Writing. Of rows with equal payloads (by SHA-256 and length) of at least `least` bytes, that with the largest id is a
`response` and the others are `revisit` records that refer to it; smaller payloads are always responses. Tasks
put records into archives of some ARCHIVE_BYTES (a larger record has one to itself), each a gzip file that Spark's
own writer commits in the shared folder.

Reading. Each archive is parsed by the lengths that its records state. SHA-1 digests are taken of the payloads
read back and held against the records' own; every revisit must refer to a response, with its digest and length, that
was read. The captures of an archive, sorted by URL key, time and id, are a run.

Index. Ranges of (URL key, time, id, archive, place) are dealt over tasks, so neither a range nor one much-captured URL is
bounded by a key. A task has fragments of many runs and merges them k ways with a loser tree: one comparison a level
for each capture. Ranges follow each other, so the captures are in order over all partitions.

A null payload counts as empty, a null URL as ''; a null id is smaller than any other and its revisits refer to null.
Of repeated ids with one payload one row is the response. Line ends and other control characters in a URL
are percent-encoded. Very long payloads are whole. An empty table gives no archive and an empty index. Other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaytally.llm.common import new_path, numbered, written

#: Payloads of fewer bytes are stored again each time.
LEAST_BYTES = 1000
#: Bytes of records (before compression) after which an archive ends; revisited payloads that a broadcast may list.
ARCHIVE_BYTES, BROADCAST_CLASSES = 32 << 20, 200_000
#: Fixed by the WARC format: version, record end, profile of revisits by equal payload.
VERSION, END = b"WARC/1.1\r\n", b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str) -> str:
    """The URL with its host's labels from last to first, lower-cased: com,example)/path?query."""
    rest = url.split("://", 1)[-1].split("#", 1)[0]
    at = re.search(r"[/?]", rest)
    host, path = (rest[: at.start()], rest[at.start() :]) if at else (rest, "")
    host = host.rsplit("@", 1)[-1].lower().removeprefix("www.")
    name, _, port = host.partition(":")
    labels = ",".join(reversed(name.split(".")))
    return f"{labels}{':' + port if port not in ('', '80', '443') else ''}){path if path.startswith('/') else '/' + path}".lower()


def _digest(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _plain(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(kind: str, headers: dict[str, object], block: bytes) -> bytes:
    lines = [f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers.items() if v is not None), f"Content-Length: {len(block)}"]
    return VERSION + "\r\n".join(lines).encode("utf-8", "surrogateescape") + END + block + END


def page_record(kind: str, record_id: str, refers: str | None, refers_page: object, page: object, url: str, date: str, payload: bytes) -> bytes:
    """The record of a page; a revisit has the reply's head only, which states the payload's length."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = {
        "WARC-Record-ID": f"<urn:uuid:{record_id}>",
        "WARC-Date": date,
        "WARC-Target-URI": _plain(url),
        "WARC-Payload-Digest": _digest(payload),
        "WARC-Profile": PROFILE if kind == "revisit" else None,
        "WARC-Refers-To": f"<urn:uuid:{refers}>" if kind == "revisit" else None,
        "X-Page-ID": page,
        "X-Refers-To-Page-ID": refers_page if kind == "revisit" else None,
        "Content-Type": "application/http; msgtype=response",
    }
    return record(kind, headers, head + (payload if kind == "response" else b""))


def records(archive: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, headers and block of each record; ValueError where the bytes are no record."""
    at = 0
    while at < len(archive):
        ends = archive.find(END, at)
        if not archive.startswith(VERSION, at) or ends < 0:
            raise ValueError(f"no WARC record at byte {at}")
        lines = archive[at + len(VERSION) : ends].decode("utf-8", "surrogateescape").split("\r\n")
        headers = dict(line.split(": ", 1) for line in lines if line)
        begin = ends + len(END)
        stop = begin + int(headers["Content-Length"])
        if archive[stop : stop + len(END)] != END:
            raise ValueError(f"the record at byte {at} does not end where it says")
        yield at, stop + len(END) - at, headers, archive[begin:stop]
        at = stop + len(END)


def _choices(rows: DataFrame, key: str) -> DataFrame:
    """Of payloads (content) that several rows have, the row that stays: content, last_id, last_key, ties."""
    one = rows.groupBy("content", "id").agg(F.count(F.lit(1)).alias("n"), F.max(key).alias("key"))  # combined before the shuffle
    return (
        one.groupBy("content")
        .agg(F.max(F.struct("id", "key", "n")).alias("last"), F.sum("n").alias("rows"))
        .where("rows > 1")
        .select("content", F.col("last.id").alias("last_id"), F.col("last.key").alias("last_key"), F.col("last.n").alias("ties"))
    )


def judged(pages: DataFrame, id: str, url: str, payload: str, date: Column | None, least: int) -> DataFrame:
    """page, url, date, raw, kind (response or revisit), refers (the response's record id), own (likewise, if referred to), refers_page."""
    date = F.lit("2024-01-01T00:00:00Z") if date is None else date

    def narrow(rows: DataFrame, key: Column) -> DataFrame:
        raw = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
        content = F.when(F.length(raw) >= least, F.unhex(F.sha2(raw, 256)))
        return rows.select(F.col(id).alias("id"), key.alias("key"), F.coalesce(F.col(url), F.lit("")).alias("url"), date.alias("date"), raw.alias("raw"), content.alias("content"))

    rows = narrow(pages, F.lit(0).cast("long"))
    chosen = written(_choices(rows.where("content is not null"), "key"), "payloads")
    if not chosen.where("ties > 1").isEmpty():  # rows that only their place tells apart: places must stay
        own, number = numbered(pages)
        rows = narrow(own, F.col(number))
        chosen = written(_choices(rows.where("content is not null"), "key"), "payloads")
    # the list of revisited payloads is narrow; a long one is joined, where Spark splits a hot payload's partition
    classes = F.broadcast(chosen) if chosen.count() <= BROADCAST_CLASSES else chosen
    name = F.md5(F.concat(F.hex("content"), F.coalesce(F.col("last_id").cast("string"), F.lit("")).cast("string")))
    joined = rows.join(classes.withColumn("referred", name), "content", "left")
    several = F.col("referred").isNotNull()
    stays = F.col("id").eqNullSafe(F.col("last_id")) & (F.col("key") == F.col("last_key"))
    return joined.select("id", "url", "date", "raw", F.when(several & ~stays, "revisit").otherwise("response").alias("kind"), "referred", F.col("last_id").alias("refers_page"))


def write_archives(pages: DataFrame, path: str, id: str = "page_id", url: str = "url", payload: str = "html", date: Column | None = None, least: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """One WARC record per row of pages, in gzip files under path; date: ISO time of capture by row."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def archive(parts: list[bytes]) -> pa.RecordBatch:
            # the writer's line end closes the last record
            info = record("warcinfo", {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": "2024-01-01T00:00:00Z", "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")
            body = b"".join([info, *parts])[: -len(END)]
            offsets = pa.py_buffer(b"".join(n.to_bytes(4, "little") for n in (0, len(body))))
            return pa.RecordBatch.from_arrays([pa.StringArray.from_buffers(1, offsets, pa.py_buffer(body))], names=["value"])

        parts: list[bytes] = []
        held = 0
        for batch in batches:
            for i in range(batch.num_rows):
                page, at, day, raw, kind, referred, refers_page = (c[i].as_py() for c in batch.columns)
                own = str(uuid.UUID(referred)) if referred else str(uuid.uuid4())
                mine = str(uuid.uuid4()) if kind == "revisit" else own
                made = page_record(kind, mine, own, refers_page, page, at, day, raw)
                if parts and held + len(made) > archive_bytes:
                    yield archive(parts)
                    parts, held = [], 0
                parts.append(made)
                held += len(made)
        if parts:
            yield archive(parts)

    rows = judged(pages, id, url, payload, date, least).mapInArrow(pack, "value string")
    rows.write.option("lineSep", END.decode()).option("maxRecordsPerFile", 1).option("compression", "gzip").text(path)


CAPTURES = "archive string, place long, url_key string, time string, page string, record_type string, payload_bytes long, payload_digest string, record_id string, refers_id string, refers_page string, record_offset long, record_length long"


def captures(spark: SparkSession, path: str) -> DataFrame:
    """The page records of the archives under path; those of an archive are a run, in order of place."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                run = []
                for offset, length, headers, block in records(gzip.decompress(content.as_py())):
                    kind = headers["WARC-Type"]
                    if kind not in ("response", "revisit"):
                        continue
                    head, _, payload = block.partition(b"\r\n\r\n")
                    size = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
                    stated = headers["WARC-Payload-Digest"]
                    if kind == "response" and (len(payload) != size or _digest(payload) != stated):
                        raise ValueError(f"the payload at byte {offset} of {name} is not the one that was written")
                    digest = base64.b32decode(stated.removeprefix("sha1:")).hex()
                    time = re.sub(r"\D", "", headers["WARC-Date"])
                    run.append((url_key(headers.get("WARC-Target-URI", "")), time, headers.get("X-Page-ID"), kind, size, digest, headers["WARC-Record-ID"], headers.get("WARC-Refers-To"), headers.get("X-Refers-To-Page-ID"), offset, length))
                run.sort(key=lambda r: (r[0].encode("utf-8", "surrogateescape"), r[1].encode(), _number(r[2])))
                if run:
                    columns = [[name.as_py()] * len(run), range(len(run)), *zip(*run)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=_NAMES)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(parse, CAPTURES)


_NAMES = [c.split()[0] for c in CAPTURES.split(", ")]
_TYPES = [pa.int64() if c.endswith("long") else pa.string() for c in CAPTURES.split(", ")]


def _number(page: str | None) -> tuple[bool, int]:
    """A null id comes first."""
    return (False, 0) if page is None else (True, int(page))


def merged(runs: list[list[tuple]]) -> Iterator[tuple[int, int]]:
    """Run and place of each key of the sorted runs, in order, by a loser tree: a node holds the loser of its
    match, so the next key of the winner's run plays one match a level on its way up."""
    k, at = len(runs), [0] * len(runs)
    heads = [run[0] if run else None for run in runs]
    losers = [0] * k

    def beats(a: int, b: int) -> bool:
        return heads[b] is None or (heads[a] is not None and (heads[a], a) < (heads[b], b))

    winners = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if beats(a, b) else (b, a)
    best = winners[1] if k > 1 else 0
    while k and heads[best] is not None:
        yield best, at[best]
        at[best] += 1
        heads[best] = runs[best][at[best]] if at[best] < len(runs[best]) else None
        node = (best + k) // 2
        while node:
            if beats(losers[node], best):
                losers[node], best = best, losers[node]
            node //= 2


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a range, fragments of many runs, in order."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    rows = pa.Table.from_batches(parts)
    keys = zip(*(rows[c].to_pylist() for c in ("archive", "place", "url_key", "time", "page")))
    fragments: dict[str, list[tuple]] = {}
    for i, (archive, place, url, time, page) in enumerate(keys):
        fragments.setdefault(archive, []).append((url.encode("utf-8", "surrogateescape"), time.encode(), page is not None, page or 0, archive, place, i))
    runs = list(fragments.values())
    for run in runs:
        if any(a > b for a, b in zip(run, run[1:])):  # the shuffle gave its blocks in another order
            run.sort()
    order = pa.array([runs[r][p][-1] for r, p in merged(runs)], pa.int64())
    yield from rows.take(order).to_batches(max_chunksize=1 << 14)


def capture_index(spark: SparkSession, path: str) -> DataFrame:
    """The captures of the archives under path, in global order of URL key, time and id: page_id, url_key, time,
    record_type, payload_bytes, payload_digest, refers_to, archive, record_offset, record_length (of the unpacked archive)."""
    runs = written(captures(spark, path), "runs")
    of_response = ["record_id", "payload_digest", "payload_bytes"]
    referred = runs.where("record_type = 'revisit'").select(F.col("refers_id").alias("record_id"), *of_response[1:]).distinct()
    if not referred.join(runs.where("record_type = 'response'").select(of_response), of_response, "left_anti").isEmpty():
        raise ValueError(f"revisits under {path} refer to payloads that are not there")
    rows = runs.select("archive", "place", "url_key", "time", F.col("page").cast("long").alias("page"), "record_type", "payload_bytes", "payload_digest", F.col("refers_page").cast("long").alias("refers_page"), "record_offset", "record_length")
    index = rows.repartitionByRange("url_key", "time", "page", "archive", "place").mapInArrow(_merge, rows.schema)
    return index.select(F.col("page").alias("page_id"), "url_key", "time", "record_type", "payload_bytes", "payload_digest", F.col("refers_page").alias("refers_to"), "archive", "record_offset", "record_length")


def archived(pages: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html", date: Column | None = None, least: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """The index of archives written of pages into the shared folder."""
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path, id, url, payload, date, least, archive_bytes)
    return capture_index(pages.sparkSession, path)


def page_digest(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each row of pages. Pages state no time
    of capture: the second that their id numbers stands for it."""
    second = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, pmod(coalesce(page_id, 0), 1000000000))")
    date = F.date_format(second, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return archived(pages, date=date).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
             max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages)
"""
