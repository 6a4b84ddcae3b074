"""Graph and crawl file formats."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import url as U

#: Magic code and version of a page record (fixed values).
MAGIC, VERSION = 0xFEDB2003, 2
HEAD = struct.Struct(">7I")
#: Colours of the first 24 numbers (fixed values).
COLOURS = "blue brown cyan darkgreen darkorchid darksalmon darkviolet deeppink gold3 green magenta navy red yellow palegreen gray65 gray21 bisque2 greenyellow indianred4 lightblue2 mediumspringgreen orangered orange"


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with their number, counted file by file without a global sort."""
    lines = spark.read.text(path).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    sizes = sorted((r["_p"], r["n"]) for r in lines.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect())
    base, rows = 0, []
    for p, n in sizes:
        rows.append((p, base))
        base += n
    starts = spark.createDataFrame(rows, "_p int, _b bigint") if rows else spark.createDataFrame([], "_p int, _b bigint")
    return lines.join(F.broadcast(starts), "_p").select("value", (F.row_number().over(Window.partitionBy("_p").orderBy("_i")) - 1 + F.col("_b")).alias("no"))


def read_metis(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (id, weight) and edges (src, dst, eid, weight) of a METIS graph, ids from 0.

    Edges and vertices without weights have weight 0; an undirected edge stands twice in the file and
    is returned once.
    """
    lines = _numbered(spark, path).filter(~F.col("value").startswith("%"))
    first = lines.orderBy("no").first()
    head = [int(x) for x in first["value"].split()]
    fmt = f"{head[2]:03d}" if len(head) > 2 else "000"
    edge_w, vertex_w = fmt[-1] == "1", fmt[-2] == "1"
    ncon = head[3] if len(head) > 3 else 1
    skip = ncon if vertex_w else 0
    body = lines.filter(F.col("no") > first["no"]).withColumn("id", F.col("no") - first["no"] - 1).filter(F.col("id") < head[0])
    nums = body.select("id", F.expr("transform(filter(split(trim(value), '\\\\s+'), x -> x <> ''), x -> try_cast(x AS bigint))").alias("a"))
    vertices = nums.select("id", (F.element_at("a", 1) if vertex_w else F.lit(0)).cast("bigint").alias("weight"))
    rest = nums.select("id", F.slice("a", skip + 1, F.greatest(F.size("a") - skip, F.lit(0))).alias("a"))
    step = 2 if edge_w else 1
    each = rest.select("id", F.posexplode("a").alias("k", "x"), "a").filter(F.col("k") % step == 0)
    weight = F.element_at("a", F.col("k") + 2) if edge_w else F.lit(0)
    e = each.select(F.col("id").alias("src"), (F.col("x") - 1).alias("dst"), weight.cast("bigint").alias("weight")).filter("src <= dst")
    return vertices, e.withColumn("eid", F.col("src") * head[0] + F.col("dst"))


def read_metis_parts(spark: SparkSession, path: str) -> DataFrame:
    """``id``, ``part``: line k names the part of vertex k."""
    return _numbered(spark, path).select(F.col("no").alias("id"), F.trim("value").cast("int").alias("part"))


def read_dimacs(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    """Number of vertices and edges (src, dst, weight, eid) of a DIMACS file, ids from 0."""
    lines = _numbered(spark, path)
    words = lines.select("no", F.split(F.trim("value"), r"\s+").alias("w"))
    n = words.filter("w[0] = 'p'").select(F.col("w")[2].cast("int")).first()
    e = words.filter("w[0] IN ('a', 'e')").select((F.col("w")[1].cast("bigint") - 1).alias("src"), (F.col("w")[2].cast("bigint") - 1).alias("dst"), F.coalesce(F.try_element_at("w", F.lit(4)).cast("bigint"), F.lit(0)).alias("weight"), F.col("no").alias("eid"))
    return (n[0] if n else 0), e


def paint(number):
    """The attribute that paints a node: a colour for the first 24 numbers, a label beyond."""
    names = F.array(*[F.lit(c) for c in COLOURS.split()])
    return F.when(number < 24, F.concat(F.lit(' [ style="filled", fillcolor="'), F.element_at(names, (number + 1).cast("int")), F.lit('" ]'))).otherwise(F.concat(F.lit(' [ label="('), number.cast("string"), F.lit(')" ]')))


def dot_lines(vertices: DataFrame, edges: DataFrame, directed: bool = True) -> DataFrame:
    """Ordered lines of a Graphviz file: a cluster for each ``part`` of the vertices, then the edges."""
    arrow = "->" if directed else "--"
    v = vertices if "part" in vertices.columns else vertices.withColumn("part", F.lit(0))
    spark = vertices.sparkSession
    head = spark.createDataFrame([(0, 0, 0, 0, f"{'digraph' if directed else 'graph'} g {{")], "s int, a bigint, b bigint, c bigint, line string")
    opens = v.select("part").distinct().select(F.lit(1).alias("s"), F.col("part").cast("bigint").alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"), F.concat(F.lit("subgraph cluster_"), F.col("part"), F.lit(" {")).alias("line"))
    nodes = v.select(F.lit(1), F.col("part"), F.lit(1), F.col("id"), F.concat(F.lit("  n"), F.col("id"), F.lit(";")))
    closes = v.select("part").distinct().select(F.lit(1), F.col("part"), F.lit(2), F.lit(0), F.lit("}"))
    links = edges.select(F.lit(2), F.col("src"), F.col("dst"), F.col("eid"), F.concat(F.lit("n"), F.col("src"), F.lit(f" {arrow} n"), F.col("dst"), F.lit(";")))
    tail = spark.createDataFrame([(3, 0, 0, 0, "}")], "s int, a bigint, b bigint, c bigint, line string")
    return head.union(opens).union(nodes).union(closes).union(links).union(tail).orderBy("s", "a", "b", "c").select("line")


# page store -----------------------------------------------------------------------------------


def pack_page(url: str, header: str, body: bytes, timestamp: int) -> bytes:
    """One page record: fixed head, URL, HTTP header, compressed body; the CRC covers head and texts."""
    raw_url, raw_header, packed = url.encode(), header.encode(), zlib.compress(body)
    head = HEAD.pack(MAGIC, VERSION, timestamp & 0xFFFFFFFF, len(body), len(packed), len(raw_url), len(raw_header))
    check = U.crc(head + raw_url + raw_header, 0x04C11DB7, 32, 0xFFFFFFFF)
    return head + struct.pack(">I", check) + raw_url + raw_header + packed


def unpack_pages(data: bytes) -> Iterator[tuple[int, int, str, str, bytes]]:
    """(offset, timestamp, url, header, body) of the sound records; after damage the next magic code is sought."""
    at, code = 0, struct.pack(">I", MAGIC)
    while True:
        at = data.find(code, at)
        if at < 0 or at + HEAD.size + 4 > len(data):
            return
        _, version, ts, size, packed, url_len, header_len = HEAD.unpack_from(data, at)
        start = at + HEAD.size + 4
        end = start + url_len + header_len + packed
        ok = version == VERSION and url_len <= U.MAX_URL and end <= len(data)
        if ok:
            texts = data[start : start + url_len + header_len]
            ok = struct.unpack_from(">I", data, at + HEAD.size)[0] == U.crc(data[at : at + HEAD.size] + texts, 0x04C11DB7, 32, 0xFFFFFFFF)
        if ok:
            try:
                body = zlib.decompress(data[start + url_len + header_len : end])
                yield at, ts, texts[:url_len].decode("utf-8", "replace"), texts[url_len:].decode("utf-8", "replace"), body
                at = end
                continue
            except zlib.error:
                pass
        at += 1


def read_page_store(spark: SparkSession, path: str) -> DataFrame:
    """Page records of all container files: ``file``, ``offset``, ``ts``, ``url``, ``header``, ``body``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = [(name, *r) for r in unpack_pages(data)]
                cols = list(zip(*rows)) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()))], ["file", "offset", "ts", "url", "header", "body"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, offset bigint, ts bigint, url string, header string, body binary")


def write_page_store(pages: DataFrame, path: str, site: str) -> None:
    """Pages appended to one folder a site, columnar and prunable by site."""
    pages.write.mode("append").partitionBy(site).parquet(path)


def scan_page_store(spark: SparkSession, path: str, site: str | None = None, column: str = "site", offset: int | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    df = df if site is None else df.filter(F.col(column) == site)
    return df if offset is None else df.filter(F.col("offset") >= offset)


def site_sizes(pages: DataFrame, site: str) -> DataFrame:
    """Pages of each site, as the store notes them when a site ends."""
    return pages.groupBy(site).agg(F.count(F.lit(1)).alias("num_pages"))


def load_conf(path: str) -> dict[str, str]:
    """``name=value`` lines; ``#`` in the first column is a comment, blanks fall away, ``include file`` reads another."""
    out: dict[str, str] = {}
    for line in Path(path).read_text().splitlines():
        if line.startswith("#"):
            continue
        if line.strip().startswith("include "):
            out |= load_conf(str(Path(path).parent / line.split(None, 1)[1].strip()))
            continue
        text = "".join(line.split())
        if "=" in text:
            k, v = text.split("=", 1)
            out[k] = v
    return out


def text_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Blank-separated whole numbers in pairs."""
    w = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("w")).filter(F.size("w") >= 2)
    return w.select(F.col("w")[0].cast("bigint").alias("src"), F.col("w")[1].cast("bigint").alias("dst"))


def pair_text(pairs: DataFrame) -> DataFrame:
    """Pairs as two numbers of 20 digits, tab between."""
    return pairs.select(F.concat_ws("\t", U.padded(F.col("src")), U.padded(F.col("dst"))).alias("value"))
