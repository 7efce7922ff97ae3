"""WARC archives and a two-level capture index over them.

Archives are written by Spark's own text writer, a record per row: a WARC record ends in
CRLF CRLF, which is the writer's line separator. The index sorts reversed-host URL keys into
compressed blocks and keeps a sparse directory with each block's first key. A lookup finds
blocks by binary search in the directory, then lines by binary search in the block, and only
then reads the records' byte ranges.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_dir

CRLF = "\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: eight groups of 20 bits, four letters each."""
    digest = F.sha1(payload)
    letters = []
    for i in range(8):
        bits = F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(bits, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def surt(url: Column) -> Column:
    """``com,example,www)/path?query`` of a URL in lower case; host parts reversed, no scheme, port or fragment."""
    url = F.lower(F.coalesce(url, F.lit("")))
    rest = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*", 0), r"^.*@", ""), r":[0-9]*$", "")
    path = F.regexp_extract(rest, r"^[^/?]*(.*)$", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(path == "", "/").otherwise(path))


def write_archives(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    smallest_revisit: int = 0,
    file_bytes: int = 8 << 20,
    broadcast_rows: int = 50_000,
    date: str = "2024-01-01T00:00:00Z",
) -> None:
    """Write one record per row into ``path``. The payload is the text in UTF-8, null is empty.

    Of rows with equal payloads (by SHA-1) of at least ``smallest_revisit`` bytes those with
    the smallest id are responses and the others revisit it; smaller ones are all responses.
    Rows with a null id are always responses. Files hold about ``file_bytes`` each.

    Payloads are never shuffled if the revisits' ids are few (counted, at most
    ``broadcast_rows``); otherwise pages and revisits are joined by id.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    sized = rows.select("id", F.octet_length("payload").cast("long").alias("bytes"), F.sha1(F.col("payload").cast("binary")).alias("digest"))
    sized = materialize(sized, "warc-digests")
    firsts = sized.filter((F.col("bytes") >= smallest_revisit) & F.col("id").isNotNull()).groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").drop("last")
    again = sized.filter((F.col("bytes") >= smallest_revisit)).join(firsts, "digest").filter(F.col("id") > F.col("first")).select(F.col("id").alias("rid"), F.col("digest").alias("rdigest"), "first").distinct()
    again = materialize(again, "warc-revisits")
    facts = sized.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()
    per_file = max(1, file_bytes * facts["n"] // max(1, facts["b"] + 600 * facts["n"]))
    if again.count() <= broadcast_rows:
        again = F.broadcast(again)
    # one id may come with several payloads; a row revisits only by its own
    joined = rows.withColumn("digest", F.sha1(F.col("payload").cast("binary"))).join(again, (F.col("id") == F.col("rid")) & (F.col("digest") == F.col("rdigest")), "left")
    safe = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\r\n]", "%20")
    ident = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    size = F.octet_length("payload").cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), size, F.lit(CRLF + CRLF))
    revisit = F.col("first").isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{CRLF}WARC-Record-ID: "),
        ident(F.col("id")),
        F.lit(f"{CRLF}WARC-Date: {date}{CRLF}WARC-Target-URI: "),
        safe,
        F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"),
        base32_sha1(F.col("payload").cast("binary")),
        F.when(revisit, F.concat(F.lit(f"{CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}WARC-Refers-To: "), ident(F.col("first")))).otherwise(F.lit("")),
        F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(CRLF + CRLF),
    )
    joined.select(F.concat(head, block).alias("record")).write.option("lineSep", CRLF + CRLF).option("maxRecordsPerFile", int(per_file)).text(path)


def _headers(data: bytes, at: int) -> dict[str, str]:
    lines = data.decode().split(CRLF)
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record at byte {at}")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers with lower-case names, block, length with the closing CRLFs) of the record at ``at``."""
    end = data.index(b"\r\n\r\n", at)
    headers = _headers(data[at:end], at)
    stop = end + 4 + int(headers["content-length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at byte {at} doesn't end where its length says")
    return headers, data[end + 4 : stop], stop + 4 - at


class RangeReader:
    """Byte ranges of archive files, local or in any store that pyarrow knows; the last file stays open."""

    def __init__(self):
        self.name, self.file = None, None

    def read(self, uri: str, offset: int, length: int) -> bytes:
        if uri != self.name:
            self.close()
            parts = urlparse(uri)
            if parts.scheme in ("", "file"):
                self.file = open(unquote(parts.path), "rb")
            else:
                from pyarrow import fs

                store, at = fs.FileSystem.from_uri(uri)
                self.file = store.open_input_file(at)
            self.name = uri
        self.file.seek(offset)
        return self.file.read(length)

    def close(self) -> None:
        if self.file:
            self.file.close()
        self.file = self.name = None


def _walk(reader: RangeReader, file: str, length: int, head: int = 4096):
    """Capture rows of one archive, record by record: only headers are read, whatever the size of the file."""
    at = 0
    while at < length:
        size, data = head, b""
        while b"\r\n\r\n" not in data and len(data) < length - at:
            data = reader.read(file, at, min(size, length - at))
            size *= 4
        end = data.index(b"\r\n\r\n")
        h = _headers(data[:end], at)
        n = end + 4 + int(h["content-length"]) + 4
        yield h["warc-target-uri"], h["warc-record-id"], h["warc-type"], h["warc-payload-digest"].removeprefix("sha1:"), h["warc-date"], file, at, n
        at += n


def captures(spark: SparkSession, path: str) -> DataFrame:
    """(url, record, kind, digest, date, file, offset, length): one row per record, found by walking every archive, one task a file."""
    import pandas as pd

    def walk(batches):
        reader = RangeReader()
        for batch in batches:
            for file, length in zip(batch["path"], batch["length"]):
                yield pd.DataFrame(list(_walk(reader, file, int(length))), columns=["url", "record", "kind", "digest", "date", "file", "offset", "length"])
        reader.close()

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).filter("length > 0").select("path", "length")
    return files.mapInPandas(walk, "url string, record string, kind string, digest string, date string, file string, offset long, length long")


def _key(url: Column) -> Column:
    return F.regexp_replace(surt(url), r"\s", "%20")


def build_index(found: DataFrame, path: str, block_lines: int = 500, segment_lines: int = 50_000) -> None:
    """Write the captures of :func:`captures` as an index: Parquet rows (segment, first_key, last_key, lines, data), sorted by key.

    ``data`` is a zlib-compressed block of at most ``block_lines`` lines ``key date json``. A
    segment is one range of sorted lines, about ``segment_lines``; a key with many captures
    may run over several blocks and segments. An empty table gives an empty index.
    """
    import pandas as pd
    from pyspark import TaskContext

    def pack(batches):
        keys, lines, segment = [], [], TaskContext.get().partitionId()

        def block(n):
            return pd.DataFrame([(segment, keys[0], keys[n - 1], n, zlib.compress("\n".join(lines[:n]).encode()))], columns=["segment", "first_key", "last_key", "lines", "data"])

        for batch in batches:
            keys += batch["key"].tolist()
            lines += batch["line"].tolist()
            while len(keys) >= block_lines:
                yield block(block_lines)
                del keys[:block_lines], lines[:block_lines]
        if keys:
            yield block(len(keys))

    entry = F.to_json(F.struct("url", "record", "kind", "digest", "file", F.col("offset").cast("string").alias("offset"), F.col("length").cast("string").alias("length")))
    # written first: the sort by ranges reads its input twice
    keyed = materialize(found.select(_key(F.col("url")).alias("key"), "date", entry.alias("entry")), "warc-captures").select("key", F.concat_ws(" ", "key", "date", "entry").alias("line"))
    segments = max(1, -(-keyed.count() // segment_lines))
    keyed.repartitionByRange(segments, "key", "line").sortWithinPartitions("key", "line").mapInPandas(pack, "segment int, first_key string, last_key string, lines int, data binary").write.parquet(path)


ENTRY = "key string, url string, record string, kind string, digest string, file string, offset long, length long"
_FIELDS = ["url", "record", "kind", "digest", "file", "offset", "length"]


def search_block(lines: list[str], keys: list[str]) -> list[str]:
    """The lines of a sorted block whose key is one of the sorted ``keys``: two binary searches for each key."""
    found, at, name = [], 0, lambda line: line.partition(" ")[0]
    for k in keys:
        at = bisect_left(lines, k, at, key=name)
        end = bisect_right(lines, k, at, key=name)
        found += lines[at:end]
        at = end
    return found


def lookup(spark: SparkSession, path: str, urls: DataFrame, url_col: str = "url") -> DataFrame:
    """Every capture (see ``ENTRY``) of the URLs, in any order: their distinct keys meet the index through its two levels.

    A first directory has each segment's first and last key (a row per ``segment_lines``
    captures reaches the driver); each key is sent to the segments that may hold it, found by
    binary search. There the segment's own directory, the blocks' first and last keys, is
    searched for each key, only the blocks named are unpacked, and their lines are searched
    again. A key that isn't in the index gives no row; null URLs have the key of an empty URL.
    """
    import pandas as pd

    index = spark.read.schema("segment int, first_key string, last_key string, lines int, data binary").parquet(path)
    top = sorted((r["lo"], r["hi"], r["segment"]) for r in index.groupBy("segment").agg(F.min("first_key").alias("lo"), F.max("last_key").alias("hi")).collect())
    lows, highs, numbers = [t[0] for t in top], [t[1] for t in top], [t[2] for t in top]
    keys = urls.select(_key(F.col(url_col)).alias("key")).distinct()

    def route(batches):
        for batch in batches:
            out = []
            for k in batch["key"]:
                i = bisect_left(highs, k)  # segments are ranges: their last keys ascend too
                while i < len(lows) and lows[i] <= k:
                    out.append((numbers[i], k))
                    i += 1
            yield pd.DataFrame(out, columns=["segment", "key"]).astype({"segment": "int32"})

    def search(wanted: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        found = []
        names = sorted(wanted["key"])
        for first, last, data in zip(blocks["first_key"], blocks["last_key"], blocks["data"]):
            asked = names[bisect_left(names, first) : bisect_right(names, last)]
            if asked:
                for line in search_block(zlib.decompress(bytes(data)).decode().split("\n"), asked):
                    key, _, rest = line.partition(" ")
                    e = json.loads(rest.partition(" ")[2])
                    found.append((key, *[e.get(f, "") for f in _FIELDS]))
        return pd.DataFrame(found, columns=["key", *_FIELDS]).astype({"offset": "int64", "length": "int64"})

    routed = keys.mapInPandas(route, "segment int, key string")
    return routed.groupBy("segment").cogroup(index.select("segment", "first_key", "last_key", "data").groupBy("segment")).applyInPandas(search, ENTRY)


def read_records(entries: DataFrame, with_payload: bool = False) -> DataFrame:
    """(record, url, kind, refers_to, digest, payload_bytes, payload) of index entries, by range reads.

    ``digest`` is computed from the payload read; a record that doesn't match its own header
    raises. Of a revisit, digest and payload are null here, see :func:`read_back`.
    """
    import pandas as pd

    def run(batches):
        reader = RangeReader()
        for batch in batches:
            out = []
            for file, offset, length in zip(batch["file"], batch["offset"], batch["length"]):
                h, block, _ = parse_record(reader.read(file, int(offset), int(length)))
                payload = block[block.index(b"\r\n\r\n") + 4 :]
                digest = None
                if h["warc-type"] == "response":
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    if digest != h["warc-payload-digest"].removeprefix("sha1:"):
                        raise ValueError(f"digest of {h['warc-record-id']} in {file} at {offset}")
                out.append((h["warc-record-id"], h["warc-target-uri"], h["warc-type"], h.get("warc-refers-to"), digest, len(payload) if digest else None, payload if with_payload and digest else None))
            df = pd.DataFrame(out, columns=["record", "url", "kind", "refers_to", "digest", "payload_bytes", "payload"])
            yield df.astype({"payload_bytes": "Int64"})
        reader.close()

    near = entries.select("file", "offset", "length").repartition("file").sortWithinPartitions("file", "offset")
    schema = "record string, url string, kind string, refers_to string, digest string, payload_bytes long, payload binary"
    return near.mapInPandas(run, schema)


def archive_and_read_back(pages: DataFrame, block_lines: int = 500, segment_lines: int = 50_000, **options) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: pages written, indexed, looked up by their URLs, and read back.

    A row per page: null ids, null URLs and repeated rows are records like any other, a null
    payload is empty; other columns are passed over; an empty table gives an empty result. A
    revisit's size and digest are those of the response it refers to, met by a join.
    """
    spark = pages.sparkSession
    root = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, f"{root}/archives", **options)
    build_index(captures(spark, f"{root}/archives"), f"{root}/index", block_lines, segment_lines)
    entries = lookup(spark, f"{root}/index", pages, options.get("url_col", "url"))
    records = materialize(read_records(entries).drop("payload"), "warc-records")
    number = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1)
    number_or_null = lambda c: F.when(number(c) != "", number(c).cast("long"))
    responses = records.filter("kind = 'response'")
    revisits = records.filter("kind = 'revisit'").select("record", "kind", "refers_to")
    digests = responses.select(F.col("record").alias("of"), "digest", "payload_bytes").join(revisits.select(F.col("refers_to").alias("of")).distinct(), "of", "left_semi").dropDuplicates(["of"])
    full = revisits.join(digests, F.col("refers_to") == F.col("of"))
    cols = ["record", "payload_bytes", "digest", "kind", "refers_to"]
    return (
        responses.select(*cols)
        .unionByName(full.select(*cols))
        .select(number_or_null(F.col("record")).alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), number_or_null(F.col("refers_to")).alias("refers_to"))
    )
