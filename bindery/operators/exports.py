"""Archives of bundles, member by member: no task, group or row holds a whole bundle.

Each file is deflated as a row of its own. Where a member begins is a running sum over the members' lengths, and the
directory at an archive's end is made of their names, lengths and checksums alone. A part is what stands at `at` in the
archive: the parts of a job, in order, are the ZIP file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bindery.functions.frames import settled
from bindery.functions.guard import inflated
from bindery.operators.bundles import PRODUCT

#: Fixed values of the ZIP format: signatures, lengths of the records without names, the flag of UTF-8 names, methods, the first
#: date that it can tell (as time and date), and where its short fields end.
LOCAL, CENTRAL, END, END64, LOCATOR64 = "504B0304", "504B0102", "504B0506", "504B0606", "504B0607"
LOCAL_BYTES, CENTRAL_BYTES, END_BYTES, END64_BYTES, WIDE_BYTES = 30, 46, 22, 56, 12
UTF8_NAMES, STORED, DEFLATED, FIRST_DATE = 0x0800, 0, 8, "00002100"
MOST_MEMBERS, MOST_BYTES = 0xFFFF, 0xFFFFFFFF


def little(value: Column | int, size: int) -> Column:
    """The low bytes of a number in hex, the lowest first."""
    number = F.lit(value) if isinstance(value, int) else value
    return F.regexp_replace(F.reverse(F.lpad(F.hex(number.cast("long")), 2 * size, "0")), "(.)(.)", "$2$1")


def deflated(content: Column, level: int) -> Column:
    @F.pandas_udf("binary")
    def deflate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            out = []
            for data in b:
                z = zlib.compressobj(level, zlib.DEFLATED, -zlib.MAX_WBITS)
                out.append(z.compress(data) + z.flush())
            yield pd.Series(out, dtype=object)

    return deflate(content)


def archive_parts(files: DataFrame, jobs: DataFrame, level: int = 6, product: str = PRODUCT) -> DataFrame:
    """job_id, name, ord, path, at, part: a row for each file of a job, by path, and a last one, with path null, of its directory.

    Files are (job_id, path, content); jobs (job_id, original_name). A null content is empty; a job without files has no row, and
    files of no job are left out. Members with the same path stay, in no set order. With level 0 contents are stored as they are.
    """
    data = F.coalesce("content", F.lit(b""))
    packed = data if level == 0 else deflated(data, level)
    name = F.encode("path", "UTF-8")
    members = files.filter("path IS NOT NULL").select("job_id", "path", F.monotonically_increasing_id().alias("id"), F.hex(name).alias("label"), F.octet_length(name).alias("label_bytes"), F.crc32(data).alias("crc"), F.octet_length(data).alias("size"), packed.alias("packed"))
    members = settled(members)  # deflated once, read for its lengths and for its bytes

    facts = members.select("job_id", "id", "path", "label", "label_bytes", "crc", "size", F.octet_length("packed").alias("packed_size"))
    order = Window.partitionBy("job_id").orderBy("path", "id")
    length = (F.col("packed_size") + F.col("label_bytes") + LOCAL_BYTES).cast("long")
    before = F.coalesce(F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = facts.withColumn("ord", F.row_number().over(order).cast("long")).withColumn("at", before).withColumn("length", length)

    method = F.lit(little_hex(STORED if level == 0 else DEFLATED, 2))
    common = F.concat(F.lit(little_hex(UTF8_NAMES, 2)), method, F.lit(FIRST_DATE), little(F.col("crc"), 4), little(F.col("packed_size"), 4), little(F.col("size"), 4), little(F.col("label_bytes"), 2))
    head = F.unhex(F.concat(F.lit(LOCAL + little_hex(20, 2)), common, F.lit("0000"), F.col("label")))
    wide = F.col("at") >= MOST_BYTES
    extra = F.when(wide, F.concat(F.lit(little_hex(1, 2) + little_hex(8, 2)), little(F.col("at"), 8))).otherwise("")
    short = F.when(wide, F.lit("F" * 8)).otherwise(little(F.col("at"), 4))
    version = F.when(wide, F.lit(little_hex(45, 2))).otherwise(F.lit(little_hex(20, 2)))
    entry = F.concat(F.lit(CENTRAL), version, version, common, F.when(wide, F.lit(little_hex(WIDE_BYTES, 2))).otherwise("0000"), F.lit("0" * 20), short, F.col("label"), extra)

    placed = placed.withColumn("head", head)
    parts = members.select("id", "packed").join(placed.select("job_id", "id", "path", "ord", "at", "head"), "id")
    parts = parts.select("job_id", "ord", "path", "at", F.concat("head", "packed").alias("part"))

    entries = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", entry.alias("entry")))), lambda e: e["entry"]), "")
    ends = placed.groupBy("job_id").agg(F.count("*").alias("n"), F.sum("length").alias("at"), entries.alias("entries"))
    ends = ends.select("job_id", (F.col("n") + 1).alias("ord"), F.lit(None).cast("string").alias("path"), "at", F.unhex(F.concat("entries", ending(F.col("n"), F.col("at"), F.octet_length("entries") / 2))).alias("part"))
    named = jobs.select("job_id", archive_name(F.col("original_name"), product).alias("name"))
    return parts.unionByName(ends).join(named, "job_id").select("job_id", "name", "ord", "path", "at", "part")


def little_hex(value: int, size: int) -> str:
    return value.to_bytes(size, "little").hex().upper()


def ending(n: Column, at: Column, size: Column) -> Column:
    """The records after a directory of n entries and so many bytes at that place, in hex; with the wide ones where it takes them."""
    size = size.cast("long")
    wide = (n >= MOST_MEMBERS) | (at >= MOST_BYTES) | (size >= MOST_BYTES)
    more = F.concat(
        F.lit(END64 + little_hex(END64_BYTES - 12, 8) + little_hex(45, 2) * 2 + "0" * 16), little(n, 8), little(n, 8), little(size, 8), little(at, 8),
        F.lit(LOCATOR64 + "0" * 8), little(at + size, 8), F.lit(little_hex(1, 4)),
    )
    fields = [little(F.least(n, F.lit(MOST_MEMBERS)), 2)] * 2 + [little(F.least(size, F.lit(MOST_BYTES)), 4), little(F.least(at, F.lit(MOST_BYTES)), 4)]
    return F.concat(F.when(wide, more).otherwise(""), F.lit(END + "0" * 8), *fields, F.lit("0000"))


def archive_name(original_name: Column, product: str = PRODUCT) -> Column:
    return F.concat(F.regexp_replace(original_name, r"\.[^.]*$", ""), F.lit(f"-{product.lower()}.zip"))


def streamed(parts: DataFrame, job_id: str) -> Iterator[bytes]:
    """The bytes of one job's archive, part by part, as they go to whoever asked for it; none for a job without files."""
    for row in parts.filter(F.col("job_id") == job_id).orderBy("ord").select("part").toLocalIterator():
        yield bytes(row["part"])


def members_of(parts: DataFrame) -> DataFrame:
    """job_id, name, path, content of the files in parts: each is read from its own part, by the part's own record.

    A part whose bytes don't bear out its length or checksum is an error, as is one that inflates beyond the limit.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths, contents = [], []
            for part in b.column("part").to_pylist():
                method, crc, packed, size, label = (int.from_bytes(part[i:j], "little") for i, j in ((8, 10), (14, 18), (18, 22), (22, 26), (26, 28)))
                body = part[LOCAL_BYTES + label :]
                data = body if method == STORED else inflated(body, raw=True)
                if (len(body), len(data), zlib.crc32(data)) != (packed, size, crc):
                    raise ValueError("a member isn't what its record says")
                paths.append(part[LOCAL_BYTES : LOCAL_BYTES + label].decode())
                contents.append(data)
            yield pa.RecordBatch.from_arrays([b.column("job_id"), b.column("name"), pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["job_id", "name", "path", "content"])

    return parts.filter("path IS NOT NULL").select("job_id", "name", "part").mapInArrow(read, "job_id string, name string, path string, content binary")
