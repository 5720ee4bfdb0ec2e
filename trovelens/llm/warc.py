"""WARC archives of pages: records, files, reading, and a Merkle audit that finds what differs between replicas.

Each record is hashed together with its place. Hashes of FANOUT neighbours and the offset range that
they cover make a node, level by level up to a file's root, and files' roots make nodes up to the
archive's root. Replicas are compared from the top; only children of nodes that differ are looked at.
"""

from __future__ import annotations

import gzip
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trovelens.llm.columns import needed
from trovelens.plans.lineage import cut
from trovelens.plans.skew import skewed_join

FANOUT = 16
#: Pages of this many consecutive page_ids go to one file, or to several that hold about as many rows and bytes at most.
FILE_SPAN, FILE_BYTES = 1000, 256 << 20
#: The numbers of further files of a span are this far apart.
FURTHER = 1 << 40
#: Bytes of a record that one gzip member holds at most; the last byte of such a member is always 0.
MEMBER_BYTES = (1 << 24) - 1
#: Records and bytes in one batch of the reader.
READ_ROWS, READ_BYTES = 500, 16 << 20
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"


def record(page_id: Column, url: Column, html: Column) -> Column:
    """The text of a WARC resource record, with the blank lines that end it."""
    block = F.coalesce(html, F.lit(""))
    address = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20]", "")  # a header is one line
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: resource{CRLF}WARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")),
        F.lit(f">{CRLF}WARC-Date: {DATE}{CRLF}WARC-Target-URI: "), address,
        F.lit(f"{CRLF}Content-Type: text/html{CRLF}WARC-Block-Digest: sha256:"), F.sha2(block, 256),
        F.lit(f"{CRLF}Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF), block, F.lit(CRLF + CRLF),
    )


def placed(pages: DataFrame) -> DataFrame:
    """page_id, url, html and file of each page: FILE_SPAN consecutive ids share a file, pages without an id another.

    Where repeated ids, pages without one or very long pages make more than that, a span has further
    files and its pages are dealt to them by their content, so a file's size does not grow with the
    table. Rows that are equal in all three columns are always in one file.
    """
    own = needed(pages, "page_id", "url", "html").withColumn("file", F.coalesce(F.floor(F.col("page_id") / FILE_SPAN).cast("long"), F.lit(-1).cast("long")))
    sizes = own.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("html")).alias("bytes"))
    parts = F.greatest(F.ceil(F.col("n") / FILE_SPAN), F.ceil(F.coalesce("bytes", F.lit(0)) / FILE_BYTES))
    more = cut(sizes.withColumn("parts", parts).filter("parts > 1").select("file", "parts", "n"))
    if more.isEmpty():
        return own
    dealt = skewed_join(own, more.select("file", "parts"), ["file"], "left", sizes=more.select("file", "n"))
    part = F.coalesce(F.pmod(F.xxhash64("page_id", "url", "html"), F.col("parts")), F.lit(0).cast("long"))
    return dealt.select("page_id", "url", "html", (F.col("file") + part * FURTHER).alias("file"))


def written(placed_: DataFrame) -> DataFrame:
    """page_id, file and text of the record of each placed page."""
    return placed_.select("page_id", "file", record(F.col("page_id"), F.col("url"), F.col("html")).alias("text"))


def records(pages: DataFrame) -> DataFrame:
    """page_id, file and text of each page's record.

    Null html is an empty block, a null url an empty address, a null id is written as none; repeated
    rows are repeated records; other columns are ignored; an empty table has no records.
    """
    return written(placed(pages))


def write_archive(pages: DataFrame, path: str, codec: str | None = None) -> None:
    """Write WARC files below ``path``/file=N, records in the order of their ids.

    With ``codec`` gzip each record is a gzip member of its own, as archives have it (several, if it is
    longer than MEMBER_BYTES). Nulls, repeated rows and other columns are as in ``records``; an empty
    table writes no file.
    """
    out = records(pages)
    order = [F.col("page_id"), F.sha2("text", 256)]
    if codec is None:
        # The writer adds a line end after each row: the record's last one.
        out = out.repartition("file").sortWithinPartitions("file", *order)
        out.select("file", F.expr(f"substring(text, 1, length(text) - {len(CRLF)})").alias("text")).write.partitionBy("file").option("lineSep", CRLF).text(path)
        return
    if codec != "gzip":
        raise ValueError(f"no codec {codec}")

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                raw = batch.column(2)[k].as_py().encode("utf-8")
                data = b"".join(gzip.compress(raw[a : a + MEMBER_BYTES], mtime=0) for a in range(0, len(raw), MEMBER_BYTES))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([data[:-1]], pa.binary())], names=["page_id", "file", "text"])

    # A member ends with its size, whose last byte is 0: that is what the writer adds after each row.
    members = out.select("page_id", "file", "text").mapInArrow(compress, "page_id long, file long, text binary")
    members = members.repartition("file").sortWithinPartitions("file", *order)
    members.select("file", F.col("text").cast("string")).write.partitionBy("file").option("lineSep", "\x00").text(path)


def parse(data: bytes | memoryview) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of each record of an archive, plain or with a gzip member for each record.

    The block is what Content-Length says, whatever it holds. Offsets and lengths are those in ``data``.
    One record is held at a time.
    """
    data, at = memoryview(data), 0
    while at < len(data):
        if bytes(data[at : at + 2]) == b"\x1f\x8b":
            raw, start = b"", at
            while at < len(data) and bytes(data[at : at + 2]) == b"\x1f\x8b":
                member = zlib.decompressobj(wbits=31)
                for k in range(at, len(data), 1 << 16):
                    raw += member.decompress(data[k : k + (1 << 16)])
                    if member.eof:
                        at = min(k + (1 << 16), len(data)) - len(member.unused_data)
                        break
                else:
                    raise ValueError(f"the record at {start} is cut off")
                if _length(raw, start) <= len(raw):
                    break
            size = _length(raw, start)
            if size != len(raw):
                raise ValueError(f"the record at {start} is cut off")
            yield start, at - start, *_fields(raw, start)
        else:
            size = _length(data[at:], at)
            if at + size > len(data):
                raise ValueError(f"the record at {at} is cut off")
            yield at, size, *_fields(data[at : at + size], at)
            at += size


def _head(raw: bytes | memoryview, at: int) -> tuple[int, dict[str, str]]:
    """Where the block of a record begins, and its headers."""
    top = bytes(raw[: 1 << 16])
    end = top.find(b"\r\n\r\n")
    if end < 0:
        top = bytes(raw)
        end = top.find(b"\r\n\r\n")
    if not top.startswith(b"WARC/") or end < 0:
        raise ValueError(f"no record at {at}")
    lines = top[:end].decode("utf-8").split(CRLF)[1:]
    return end + 4, {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def _length(raw: bytes | memoryview, at: int) -> int:
    start, headers = _head(raw, at)
    return start + int(headers["content-length"]) + 4


def _fields(raw: bytes | memoryview, at: int) -> tuple[dict[str, str], bytes]:
    start, headers = _head(raw, at)
    if bytes(raw[-4:]) != b"\r\n\r\n":
        raise ValueError(f"the record at {at} is cut off")
    return headers, bytes(raw[start:-4])


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, html, path, offset, length of the records in WARC files below ``path``, plain or with gzip members.

    One task reads one file, which ``write_archive`` bounds (Spark itself takes files up to 2 GB); its
    records are read one after the other and leave in batches of READ_ROWS rows and about READ_BYTES. Ids
    written as none are null, records of other makers have a null id; empty addresses and blocks are empty
    texts. A broken record is an error that names its place. A folder without files gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(found: list[tuple]) -> pa.RecordBatch:
            ids, urls, html, names, offsets, lengths = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(html, pa.string()), pa.array(names, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())],
                names=["page_id", "url", "html", "path", "offset", "length"],
            )

        for files in batches:
            for k in range(files.num_rows):
                name, found, size = files.column(0)[k].as_py(), [], 0
                for offset, length, headers, block in parse(files.column(1)[k].as_buffer()):
                    own = re.fullmatch(r"<urn:page:(-?\d+)>", headers.get("warc-record-id", ""))
                    found.append((int(own[1]) if own else None, headers.get("warc-target-uri", ""), block.decode("utf-8", "replace"), name, offset, length))
                    size += len(block)
                    if len(found) >= READ_ROWS or size >= READ_BYTES:
                        yield batch(found)
                        found, size = [], 0
                if found:
                    yield batch(found)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, "page_id long, url string, html string, path string, offset long, length long")


def leaves(texts: DataFrame) -> DataFrame:
    """file, i, page_id, offset, length, digest: records in their places, from (file, page_id, text).

    The running sum of a file is one task's work; ``placed`` bounds its rows, which have no texts.
    """
    sized = texts.select("file", "page_id", F.octet_length("text").cast("long").alias("length"), F.sha2("text", 256).alias("digest"))
    order = Window.partitionBy("file").orderBy("page_id", "digest")
    return sized.select(
        "file", (F.row_number().over(order) - 1).cast("long").alias("i"), "page_id",
        (F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")).alias("offset"), "length", "digest",
    )


def _node(level: DataFrame, *keys: Column) -> DataFrame:
    """Nodes over children (i, hash, start, end) that share keys and i div FANOUT."""
    group = [*keys, F.floor(F.col("i") / FANOUT).cast("long").alias("i")]
    child = F.transform(F.array_sort(F.collect_list(F.struct("i", "hash"))), lambda c: c["hash"])
    made = level.groupBy(*group).agg(child.alias("c"), F.min("start").alias("start"), F.max("end").alias("end"))
    return made.select(*[c for c in made.columns if c not in ("c", "start", "end")], F.sha2(F.concat_ws("|", F.lit("node"), F.col("start"), F.col("end"), F.array_join("c", "|")), 256).alias("hash"), "start", "end")


def tree(own: DataFrame, levels: int, file_levels: int) -> list[DataFrame]:
    """Levels of nodes (file, i, hash) from the leaves up; the last one is the archive's root.

    The first ``levels`` are within files; then a file's root is a child, numbered by the file.
    """
    level = own.select("file", "i", F.sha2(F.concat_ws("|", F.lit("leaf"), "offset", "length", "digest"), 256).alias("hash"), F.col("offset").alias("start"), (F.col("offset") + F.col("length")).alias("end"))
    out = [level]
    for _ in range(levels):
        out.append(level := cut(_node(level, F.col("file"))))
    level = level.select((F.col("file") + 1).alias("i"), "hash", "start", "end")
    for _ in range(file_levels):
        level = cut(_node(level))
        out.append(level.select(F.lit(0).cast("long").alias("file"), "i", "hash"))
    return out


def _depth(most: int) -> int:
    depth = 0
    while most > 0:
        most, depth = most // FANOUT, depth + 1
    return max(1, depth)


def differing(one: DataFrame, two: DataFrame, under: DataFrame | None, top_of_files: bool = False) -> DataFrame:
    """(file, i) of the nodes that differ or that one side lacks, among the children of ``under``."""
    a, b = (x.select("file", "i", "hash") for x in (one, two))
    if under is not None:
        if top_of_files:  # children are files' roots: i is 0, the file's number tells the parent
            parent = under.select(F.col("i").alias("p"))
            a, b = (x.withColumn("p", F.floor((F.col("file") + 1) / FANOUT).cast("long")).join(parent, "p", "left_semi").drop("p") for x in (a, b))
        else:
            parent = under.select("file", F.col("i").alias("p"))
            a, b = (x.withColumn("p", F.floor(F.col("i") / FANOUT).cast("long")).join(parent, ["file", "p"], "left_semi").drop("p") for x in (a, b))
    both = a.withColumnRenamed("hash", "ha").join(b.withColumnRenamed("hash", "hb"), ["file", "i"], "full")
    return both.filter(~F.col("ha").eqNullSafe(F.col("hb"))).select("file", "i")


def audit(one: DataFrame, two: DataFrame) -> DataFrame:
    """Compare the leaves of two replicas: file, page_id, offset, length, digest and status of each record.

    Status is ok, corrupt (other bytes), moved (same bytes elsewhere in the file), missing (not in the
    second) or extra (only in the second; its own place and digest). Leaves below equal nodes are not
    compared: they are ok. Records are matched by file, page_id and their order under that id, so
    repeated rows and null ids are matched one to one. Empty archives give an empty result.
    """
    one, two = cut(one), cut(two)
    most = one.select("file", "i").unionByName(two.select("file", "i")).agg(F.max("i"), F.max("file")).first()
    levels, file_levels = _depth(most[0] or 0), _depth((most[1] or 0) + 1)
    trees = [tree(x, levels, file_levels) for x in (one, two)]
    bad: DataFrame | None = None
    for k in range(levels + file_levels, -1, -1):
        bad = cut(differing(trees[0][k], trees[1][k], bad, top_of_files=k == levels))
    nth = F.row_number().over(Window.partitionBy("file", F.coalesce("page_id", F.lit(-1)), F.col("page_id").isNull()).orderBy("i"))
    places = [x.join(bad, ["file", "i"], "left_semi") for x in (one, two)]
    a, b = (x.select("file", "page_id", nth.alias("nth"), "offset", "length", "digest") for x in places)
    b = b.select(*[F.col(c).alias(f"{c}_2") for c in b.columns])
    met = a.join(b, (a["file"] == b["file_2"]) & a["page_id"].eqNullSafe(b["page_id_2"]) & (a["nth"] == b["nth_2"]), "full")
    status = F.when(F.col("digest_2").isNull(), "missing").when(F.col("digest").isNull(), "extra").when(F.col("digest") != F.col("digest_2"), "corrupt").otherwise("moved")
    found = met.select(*[F.coalesce(c, f"{c}_2").alias(c) for c in ("file", "page_id", "offset", "length", "digest")], status.alias("status"))
    fine = one.join(bad, ["file", "i"], "left_anti").select("file", "page_id", "offset", "length", "digest", F.lit("ok").alias("status"))
    return fine.unionByName(found)


#: The audited replica of the query has the first byte of these pages' blocks changed.
ROT_MODULO, ROT_REST = 101, 7


def rotten(pages: DataFrame) -> DataFrame:
    """The pages with planted damage: a first character of one byte replaced where page_id says so."""
    first = F.substring("html", 1, 1)
    hit = (F.pmod("page_id", F.lit(ROT_MODULO)) == ROT_REST) & (F.octet_length(first) == 1)
    other = F.when(first == "~", "^").otherwise("~")
    return pages.withColumn("html", F.when(hit, F.concat(other, F.expr("substring(html, 2)"))).otherwise(F.col("html")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages, archive a damaged replica under the first one's headers, and audit it."""
    own = placed(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    found = audit(leaves(written(own)), leaves(written(rotten(own))))
    return found.select("page_id", F.col("file").alias("warc_file"), F.col("offset").alias("warc_offset"), F.col("length").alias("warc_length"), F.col("digest").alias("record_sha256"), "status")


ORACLE_SQL = rf"""
WITH p AS (SELECT page_id, CAST(page_id // {FILE_SPAN} AS BIGINT) AS warc_file, coalesce(html, '') AS html,
  regexp_replace(coalesce(url, ''), '[\x00-\x20]', '', 'g') AS url FROM pages),
r AS (SELECT page_id, warc_file, html, concat('WARC/1.1', e, 'WARC-Type: resource', e, 'WARC-Record-ID: <urn:page:', page_id, '>', e, 'WARC-Date: {DATE}', e,
  'WARC-Target-URI: ', url, e, 'Content-Type: text/html', e, 'WARC-Block-Digest: sha256:', sha256(html), e, 'Content-Length: ', strlen(html), e, e, html, e, e) AS t
  FROM p, (SELECT chr(13) || chr(10) AS e))
SELECT page_id, warc_file, CAST(sum(strlen(t)) OVER (PARTITION BY warc_file ORDER BY page_id) - strlen(t) AS BIGINT) AS warc_offset,
  CAST(strlen(t) AS BIGINT) AS warc_length, sha256(t) AS record_sha256,
  CASE WHEN page_id % {ROT_MODULO} = {ROT_REST} AND strlen(substr(html, 1, 1)) = 1 THEN 'corrupt' ELSE 'ok' END AS status FROM r
"""
