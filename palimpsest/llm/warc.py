"""A content-addressed WARC archive in two tables.

``payloads`` holds every distinct payload once, deflated, under its SHA-256 digest and length, beside the exact header bytes
of its response; ``records`` holds the header bytes of every record. A record's bytes are its header and, for a
response, its payload, verified against its digest on the way out. Of records with equal payloads that with the largest page_id is
the response; the others are revisits that refer to it. A payload is shuffled once, to meet the header that it is stored with.

Defined results: null html is an empty payload; a null url is an omitted header; of rows with equal page_id and payload one is
the response and the others revisit it; a null page_id is smaller than any other. A payload whose bytes no
longer match its digest stops the reading with an error.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import HEAVY, Scratch, lookup_by_group

#: The base32 alphabet, and the profile of a revisit.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
#: Digests that a task remembers, to pass on each once; those that it forgets are told apart after the shuffle.
SEEN = 1 << 18


def base32_of_hex(digest: Column) -> Column:
    """Bare upper-case base32 of a 40-digit hex string: five hex digits are four base32 digits."""
    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(digest, i * 5 + 1, F.lit(5)), 16, 10).cast("int"))
    letters = F.transform(
        groups,
        lambda g: F.concat(*[F.substring(F.lit(BASE32), F.shiftright(g, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]),
    )
    return F.array_join(letters, "")


def _payload(html: Column) -> Column:
    return F.encode(F.coalesce(html, F.lit("")), "UTF-8")


def _mapped(column: pa.Array, each) -> pa.Array:
    return pa.array([None if x is None else each(x) for x in column.to_pylist()], pa.binary())


def _packed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``payload`` deflated, so that shuffles and the archive hold less; of rows with one digest a task passes on the first."""

    def run(batches):
        seen = set()
        for batch in batches:
            fresh = []
            for i, digest in enumerate(batch.column("digest").to_pylist()):
                if (key := bytes.fromhex(digest)) not in seen:
                    seen.add(key)
                    fresh.append(i)
            if len(seen) > SEEN:
                seen.clear()
            if len(fresh) < batch.num_rows:
                batch = batch.take(pa.array(fresh, pa.int64()))
            at = batch.schema.get_field_index("payload")
            yield batch.set_column(at, "payload", _mapped(batch.column(at), lambda x: zlib.compress(x, 6)))

    return rows.mapInArrow(run, rows.schema)


def _inflated(data: bytes) -> bytes:
    try:
        return zlib.decompress(data)
    except zlib.error:
        return data  # its digest will not match


def _unpacked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``payload`` inflated, in batches of bounded size."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("payload")
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                yield part.set_column(at, "payload", _mapped(part.column(at), _inflated))

    return rows.mapInArrow(run, rows.schema)


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def _record_id(page: Column, uid: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), uid.cast("string"), F.lit(">"))


def write_archive(pages: DataFrame, scratch: Scratch, least_bytes: int = 0) -> tuple[DataFrame, DataFrame]:
    """The written tables ``records`` (uid, digest, size, holder, shared, header) and ``payloads`` (the same of its response, payload).

    ``holder`` is the uid of the response with the payload; where ``shared`` holds, it is that of more responses too.
    """
    body = _payload(F.col("html"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload"))
    keyed = rows.select("page_id", "url", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("size"), F.sha1("payload").alias("sha1"))
    index = scratch.cut(keyed.withColumn("uid", F.monotonically_increasing_id()))
    top = F.struct("page_id", "uid")
    found = lookup_by_group(index, ["digest", "size"], {"first": F.max(top), "n": F.count("*")}, scratch)
    revisit = (F.col("uid") != F.col("first.uid")) & (F.col("size") >= least_bytes)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(CRLF + CRLF))
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("size"))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("uid"))),
        F.coalesce(_line("WARC-Target-URI", url), F.lit("")),
        _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_hex(F.col("sha1")))),
        F.when(revisit, F.concat(_line("WARC-Refers-To", _record_id(F.col("first.page_id"), F.col("first.uid"))), _line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _line("Content-Length", length.cast("string")),
        F.lit(CRLF),
        http,
    )
    shared = (F.col("n") > 1) & (F.col("size") < least_bytes)
    listed = scratch.cut(found.select("uid", "digest", "size", F.col("first.uid").alias("holder"), shared.alias("shared"), header.alias("header")))
    scratch.drop(index)
    # Equal digests are equal payloads, so any row's will do. As many copies meet the header as there are tasks, not rows.
    moved = _packed(rows.select(F.sha2("payload", 256).alias("digest"), "payload"))
    payloads = scratch.cut(moved.join(listed.filter("uid = holder"), "digest").dropDuplicates(["digest"]).select(*listed.columns, "payload"))
    others = scratch.cut(listed.filter("uid != holder"))
    scratch.drop(listed)
    return others.union(payloads.select(*listed.columns)), payloads


def _verified(payload: Column, digest: Column) -> Column:
    good = F.sha2(payload, 256) == digest
    return F.when(good, payload).otherwise(F.raise_error(F.concat(F.lit("payload does not match its digest "), digest)).cast("binary"))


def read_records(records: DataFrame, payloads: DataFrame) -> DataFrame:
    """uid, record: the exact bytes of every record; a revisit's block ends with its HTTP header."""
    revisit = F.col("header").contains("\r\nWARC-Type: revisit\r\n")
    more = records.filter(~revisit & (F.col("uid") != F.col("holder"))).select("uid", "digest", "header")
    more = more.join(payloads.filter("shared").select("digest", "payload"), "digest")
    full = _unpacked(payloads.select("uid", "digest", "header", "payload").unionByName(more))
    full = full.withColumn("payload", _verified(F.col("payload"), F.col("digest")))
    full = full.select("uid", "digest", F.concat(F.encode("header", "UTF-8"), F.col("payload"), F.encode(F.lit(CRLF * 2), "UTF-8")).alias("record"))
    bare = records.filter(revisit).select("uid", "digest", F.encode(F.concat("header", F.lit(CRLF * 2)), "UTF-8").alias("record"))
    return full.union(bare)


def original_payloads(records: DataFrame, payloads: DataFrame, scratch: Scratch) -> DataFrame:
    """uid, payload of every record, revisits included: the page as it was before it was archived.

    A payload of many records is copied for every 1 / ``HEAVY`` of all records that have it, so its records part.
    """
    total = records.count()
    found = lookup_by_group(records.select("uid", "digest"), ["digest"], {"n": F.count("*")}, scratch)
    copies = F.ceil(F.col("n") * HEAVY / F.lit(max(1, total))).cast("int")
    dealt = found.select("uid", "digest", F.pmod(F.xxhash64("uid"), copies).cast("int").alias("copy"))
    several = payloads.join(records.groupBy("digest").agg(F.count("*").alias("n")), "digest")
    several = several.select("digest", "payload", F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"))
    full = _unpacked(dealt.join(several, ["digest", "copy"]).select("uid", "digest", "payload"))
    return full.select("uid", _verified(F.col("payload"), F.col("digest")).alias("payload"))


def _field(head: Column, name: str) -> Column:
    found = F.regexp_extract(head, f"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def parse(rows: DataFrame) -> DataFrame:
    """uid, digest, page_id, url, record_type, refers_to, declared, payload_bytes, payload_digest from record bytes.

    Payload length and digest are computed from the block of a response, and null for a revisit.
    """
    text_end = F.instr(F.decode("record", "ISO-8859-1"), CRLF * 2)
    head = F.decode(F.substring("record", 1, text_end + 3), "UTF-8")
    rows = rows.select("uid", "digest", "record", head.alias("head"), F.octet_length(F.encode(head, "UTF-8")).alias("at"))
    block = F.substring(F.col("record"), F.col("at") + 1, _field(F.col("head"), "Content-Length").cast("int"))
    rows = rows.select("uid", "digest", "head", block.alias("block"))
    http = F.instr(F.decode("block", "ISO-8859-1"), CRLF * 2) + 3
    kind = _field(F.col("head"), "WARC-Type")
    rows = rows.select("uid", "digest", "head", kind.alias("record_type"), F.substring(F.col("block"), http + 1, F.octet_length("block")).alias("payload"))
    own = F.col("record_type") == "response"
    page = lambda name: F.regexp_extract(_field(F.col("head"), name), "<urn:page:(-?[0-9]*):", 1)
    as_id = lambda c: F.when(c != "", c.cast("long"))
    return rows.select(
        "uid", "digest", as_id(page("WARC-Record-ID")).alias("page_id"), _field(F.col("head"), "WARC-Target-URI").alias("url"), "record_type",
        F.when(~own, as_id(page("WARC-Refers-To"))).alias("refers_to"), F.substring(_field(F.col("head"), "WARC-Payload-Digest"), 6, 32).alias("declared"),
        F.when(own, F.octet_length("payload").cast("long")).alias("payload_bytes"), F.when(own, base32_of_hex(F.sha1("payload"))).alias("payload_digest"),
    )


def round_trip(pages: DataFrame, least_bytes: int = 0, scratch: Scratch | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, read back from a written archive."""
    scratch = scratch or Scratch(pages.sparkSession, "warc")
    records, payloads = write_archive(pages, scratch, least_bytes)
    back = scratch.cut(parse(read_records(records, payloads)))
    # Of records with one digest the responses hold size and digest of the payload.
    told = lookup_by_group(back.select("digest", "page_id", "record_type", "refers_to", "declared", F.col("payload_bytes").alias("bytes"), F.col("payload_digest").alias("found")), ["digest"], {"payload_bytes": F.max("bytes"), "payload_digest": F.max("found")}, scratch)
    same = F.when(F.col("declared") == F.col("payload_digest"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("record and payload digests differ")))
    return told.select("page_id", "payload_bytes", same.alias("payload_digest"), "record_type", "refers_to")
