"""Merkle fixity audit of WARC replicas.

Records are digested at their offsets. A leaf covers a fixed range of an archive's bytes and hashes the
records that start there, in order; a node hashes its children's ranges, in order, up to one root for
each archive. An audit compares the roots of two replicas and goes down only where digests differ, so equal
archives cost one row each. At the leaves the records of the mismatching ranges are compared by offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketflow.llm.registry import query, table
from docketflow.llm.rows import FILE_BITS, keyed
from docketflow.session import stored

#: Bytes of an archive that a leaf covers, and children of a node.
LEAF_BYTES = 1 << 16
FANOUT = 8
#: Records of an archive when a table is written as WARC.
ARCHIVE_RECORDS = 256


def record_text(url: Column, body: Column, number: Column) -> Column:
    """A response record of the WARC format as text; nulls are written as empty."""
    url, body = F.coalesce(url, F.lit("")), F.coalesce(body, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:record:"), number.cast("string"), F.lit(">\r\nWARC-Target-URI: "), url,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def records_of(pages: DataFrame, id_column: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """Pages as WARC records: archive, ordinal, page_id, record. Archives hold consecutive written rows.

    Repeated rows are records of their own.
    """
    rows = keyed(pages.select(F.col(id_column).alias("page_id"), F.col(url).alias("url"), F.col(body).alias("body")))
    part, place = F.shiftright("row_key", FILE_BITS), F.col("row_key").bitwiseAND(F.lit((1 << FILE_BITS) - 1))
    name = F.format_string("part-%05d-%06d.warc", part, F.floor(place / ARCHIVE_RECORDS))
    return rows.select(
        name.alias("archive"), F.pmod(place, F.lit(ARCHIVE_RECORDS)).cast("int").alias("ordinal"), "page_id",
        record_text(F.col("url"), F.col("body"), F.col("row_key")).alias("record"),
    )


def with_offsets(lengths: DataFrame) -> DataFrame:
    """Narrow rows with archive, ordinal and length, and the offset of each record. An archive has a fixed number of records."""
    before = Window.partitionBy("archive").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return lengths.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def length_of(record: Column) -> Column:
    return F.octet_length(record).cast("long")


def archived(pages: DataFrame, id_column: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """Pages as WARC records with their offset and length in the archive."""
    records = records_of(pages, id_column, url, body)
    placed = with_offsets(records.select("archive", "ordinal", length_of(F.col("record")).alias("length")))
    return records.join(placed, ["archive", "ordinal"])


def digested(records: DataFrame) -> DataFrame:
    """(archive, offset, length, page_id, digest) of a replica's records."""
    return records.select("archive", "offset", "length", "page_id", F.sha2("record", 256).alias("digest"))


class Tree:
    """The stored levels of a replica's trees; level 0 are the leaves."""

    def __init__(self, records: DataFrame, leaf_bytes: int = LEAF_BYTES, fanout: int = FANOUT):
        self.records, self.leaf_bytes, self.fanout = stored(records), leaf_bytes, fanout
        own = F.concat_ws(":", "offset", "length", "digest")
        leaves = self.records.groupBy("archive", F.floor(F.col("offset") / leaf_bytes).alias("node"))
        ordered = F.array_sort(F.collect_list(F.struct("offset", own.alias("d"))))
        self.levels = [stored(leaves.agg(self._hash(ordered)))]

    @staticmethod
    def _hash(ordered: Column) -> Column:
        return F.sha2(F.array_join(F.transform(ordered, lambda x: x["d"]), "|"), 256).alias("digest")

    def highest(self) -> int:
        return self.levels[-1].agg(F.max("node")).first()[0] or 0

    def grow(self) -> None:
        """One level up: each node hashes up to ``fanout`` child ranges."""
        below = self.levels[-1].groupBy("archive", F.floor(F.col("node") / self.fanout).alias("up"))
        own = F.concat_ws(":", "node", "digest")
        nodes = below.agg(self._hash(F.array_sort(F.collect_list(F.struct("node", own.alias("d"))))))
        self.levels.append(stored(nodes.withColumnRenamed("up", "node")))


def trees(*replicas: DataFrame, leaf_bytes: int = LEAF_BYTES, fanout: int = FANOUT) -> list[Tree]:
    """Trees of equal height, so that their roots can be compared."""
    out = [Tree(r, leaf_bytes, fanout) for r in replicas]
    top = max(t.highest() for t in out)
    while top > 0:
        for tree in out:
            tree.grow()
        top //= fanout
    return out


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Nodes that one side lacks or whose digests differ."""
    both = a.withColumnRenamed("digest", "x").join(b.withColumnRenamed("digest", "y"), ["archive", "node"], "full_outer")
    return both.where(~F.col("x").eqNullSafe(F.col("y"))).select("archive", "node")


def damaged_leaves(a: Tree, b: Tree) -> DataFrame:
    """(archive, node) of the leaf ranges that differ, found from the roots down."""
    wrong = stored(_differing(a.levels[-1], b.levels[-1]))
    for level in range(len(a.levels) - 2, -1, -1):
        def inside(tree: Tree) -> DataFrame:
            own = tree.levels[level].withColumn("up", F.floor(F.col("node") / tree.fanout))
            return own.join(wrong.withColumnRenamed("node", "up"), ["archive", "up"], "left_semi").select("archive", "node", "digest")

        wrong = stored(_differing(inside(a), inside(b)))
    return wrong


def audit(a: Tree, b: Tree) -> DataFrame:
    """Records that differ between two replicas: missing, unexpected, or corrupt at their offset.

    A null page id stays null. Records of equal content at other offsets are missing there and unexpected here.
    """
    ranges = damaged_leaves(a, b)

    def inside(tree: Tree, prefix: str) -> DataFrame:
        own = tree.records.withColumn("node", F.floor(F.col("offset") / tree.leaf_bytes)).join(ranges, ["archive", "node"], "left_semi")
        return own.select("archive", "offset", *[F.col(c).alias(f"{prefix}_{c}") for c in ("length", "page_id", "digest")])

    met = inside(a, "a").join(inside(b, "b"), ["archive", "offset"], "full_outer")
    status = F.when(F.col("b_digest").isNull(), "missing").when(F.col("a_digest").isNull(), "unexpected").otherwise("corrupt")
    return met.where(~F.col("a_digest").eqNullSafe(F.col("b_digest"))).select(
        "archive", "offset", F.coalesce("a_length", "b_length").alias("length"), F.coalesce("a_page_id", "b_page_id").alias("page_id"),
        status.alias("status"), F.col("a_digest").alias("expected_sha256"), F.col("b_digest").alias("found_sha256"),
    )


def aged_text(record: Column) -> Column:
    """A record with a fault that follows from its digest's first digits: about one in 64 has a wrong sign, one in
    256 is cut short, and one in 256 is lost, which is null."""
    mark = F.substring(F.sha2(record, 256), 1, 2)
    wrong = F.concat(F.left(record, F.length(record) - 7), F.lit("\x00"), F.right(record, F.lit(6)))
    short = F.left(record, F.floor(F.length(record) / 2).cast("int"))
    return F.when(mark.isin("00", "01", "02", "03"), wrong).when(mark == "04", short).when(mark != "05", record)


def aged(records: DataFrame) -> DataFrame:
    """A replica with faults. Offsets stay."""
    return records.withColumn("record", aged_text(F.col("record"))).where("record IS NOT NULL")


@query("op6_warc_fixity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC archives against a replica with faults; tested against comparing every record.

    Both replicas are digested as the records are written, so only digests are placed and compared.
    """
    record = F.col("record")
    digests = records_of(table(spark, sf_dir, "pages")).select(
        "archive", "ordinal", "page_id", length_of(record).alias("length"), F.sha2(record, 256).alias("digest"), F.sha2(aged_text(record), 256).alias("aged"),
    )
    placed = stored(with_offsets(stored(digests)))
    columns = ["archive", "offset", "length", "page_id"]
    return audit(*trees(placed.select(*columns, "digest"), placed.where("aged IS NOT NULL").select(*columns, F.col("aged").alias("digest"))))
