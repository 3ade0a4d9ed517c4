"""Landed feed files as a data source of their own, and one dispatcher for all their types.

Files lie under ``type=<type>/feed=<feed>/stamp=<stamp>/``. Stamps ascend as files land, so a stream's offset is the last stamp seen, and
a restart goes on behind it. The stream's source lists files and deals them into partitions of a bounded size; bodies are read by the executors only, through
Arrow's file systems, so any URI that these open will do, and handed on in batches of a bounded size. A batch is read by Spark's own source of whole files,
which takes types, feeds and stamps from the folders' names and opens only the files of the types that a reader asks for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from trendspan.functions import text as tx
from trendspan.functions import urls as ur
from trendspan.operators.relational import first_per
from trendspan.sources import mappers as mp

LANDED = "type string, feed string, stamp string, name string, body string"
#: Bytes of the files that a task reads.
PARTITION_BYTES = 32 << 20
#: Bytes of bodies that a task hands on at once, if there is more than one.
BATCH_BYTES = 1 << 20
#: Types that are RSS or Atom.
XML_TYPES = ["rss", "atom", "rsshub", "curated_rss"]
#: Types whose items an editor chose.
CURATED_TYPES = ["curated_rss", "github_md_folder"]


@dataclass
class Files(InputPartition):
    """Paths of files with their types, feeds and stamps."""

    files: list[tuple[str, str, str, str]]

    def __post_init__(self):
        super().__init__(self.files)


def _file_system(uri: str):
    from pyarrow import fs

    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def listed(uri: str, after: str = "", upto: str | None = None) -> list[tuple[str, str, str, str, int]]:
    """``path, type, feed, stamp, size`` of the files whose stamp is after one and not after another, in the order of stamps."""
    from urllib.parse import unquote

    from pyarrow import fs

    system, root = _file_system(uri)
    out = []
    for info in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
        parts = dict(p.split("=", 1) for p in info.path.split("/")[:-1] if "=" in p)
        hidden = info.base_name.startswith(("_", "."))
        if info.type != fs.FileType.File or hidden or not {"type", "feed", "stamp"} <= parts.keys():
            continue
        stamp = unquote(parts["stamp"])
        if stamp > after and (upto is None or stamp <= upto):
            out.append((info.path, unquote(parts["type"]), unquote(parts["feed"]), stamp, info.size))
    return sorted(out, key=lambda f: (f[3], f[0]))


def dealt(files: list[tuple[str, str, str, str, int]], most: int = PARTITION_BYTES) -> list[Files]:
    out, held = [Files([])], 0
    for path, kind, feed, stamp, size in files:
        if out[-1].files and held + size > most:
            out.append(Files([]))
            held = 0
        out[-1].files.append((path, kind, feed, stamp))
        held += size
    return out


def bodies(uri: str, partition: Files) -> Iterator[tuple[str, str, str, str, str]]:
    system, _ = _file_system(uri)
    for path, kind, feed, stamp in partition.files:
        with system.open_input_stream(path) as f:
            yield kind, feed, stamp, path.rsplit("/", 1)[-1], f.read().decode("utf-8", "replace")


def batches(rows: Iterator[tuple[str, str, str, str, str]], most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches, each closed by the body that fills it; as single rows they would be held by the ten thousand."""
    names = [c.split()[0] for c in LANDED.split(", ")]
    batch = lambda held: pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held, strict=True)], names)
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size >= most:
            yield batch(held)
            held, size = [], 0
    if held:
        yield batch(held)


class LandedReader(DataSourceReader):
    def __init__(self, uri: str):
        self.uri = uri

    def partitions(self) -> list[Files]:
        return dealt(listed(self.uri))

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return batches(bodies(self.uri, partition))


class LandedStream(DataSourceStreamReader):
    def __init__(self, uri: str):
        self.uri = uri

    def initialOffset(self) -> dict:
        return {"stamp": ""}

    def latestOffset(self) -> dict:
        return {"stamp": max((f[3] for f in listed(self.uri)), default="")}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return dealt(listed(self.uri, start["stamp"], end["stamp"]))

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return batches(bodies(self.uri, partition))


class LandedFeeds(DataSource):
    """``spark.read.format("landed_feeds").load(uri)``, and ``readStream`` alike."""

    @classmethod
    def name(cls) -> str:
        return "landed_feeds"

    def schema(self) -> str:
        return LANDED

    def reader(self, schema) -> LandedReader:
        return LandedReader(self.options["path"])

    def streamReader(self, schema) -> LandedStream:
        return LandedStream(self.options["path"])


def _any_landed(uri: str) -> bool:
    """Whether the folder is there and has folders of types."""
    from pyarrow import fs

    system, root = _file_system(uri)
    return any(i.base_name.startswith("type=") for i in system.get_file_info(fs.FileSelector(root, allow_not_found=True)))


def landed(spark: SparkSession, uri: str, stream: bool = False) -> DataFrame:
    if stream:
        spark.dataSource.register(LandedFeeds)
        return spark.readStream.format("landed_feeds").load(uri)
    if not _any_landed(uri):
        return spark.range(0).select(*(F.lit("").alias(c.split()[0]) for c in LANDED.split(", ")))
    files = spark.read.schema("value string, type string, feed string, stamp string").text(uri, wholetext=True)
    # Bytes that are no UTF-8 become replacement characters; an empty file, which has no items, gives no row.
    return files.select("type", "feed", "stamp", F.col("_metadata.file_name").alias("name"), F.make_valid_utf8("value").alias("body"))


_TEXT = "struct<_VALUE:string,_type:string>"
RSS = f"struct<channel:struct<title:string,item:array<struct<title:string,link:string,guid:{_TEXT},pubDate:string,description:string>>>>"
ATOM = f"struct<title:string,entry:array<struct<title:string,link:array<struct<_href:string,_rel:string>>,id:string,published:string,updated:string,summary:string,content:{_TEXT}>>>"


def xml_items(df: DataFrame) -> DataFrame:
    """A row for each item of RSS or Atom bodies, whichever its root element is; ``at`` is its place in the file."""
    body = mp.repair_xml(F.col("body"))
    root = F.regexp_extract("body", r"<(rss|feed|rdf:RDF)[\s>]", 1)
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    parse = lambda kind, schema: F.from_xml(F.when(root == kind, body), schema, {"mode": "PERMISSIVE"})
    parsed = df.withColumns({"rss": parse("rss", RSS), "atom": parse("feed", ATOM)})
    rss = F.transform("rss.channel.item", lambda i: F.struct(i.title.alias("title"), F.coalesce(some(i.link), some(i.guid["_VALUE"])).alias("link"), i.pubDate.alias("date"), i.description.alias("summary")))
    atom = F.transform(
        "atom.entry",
        lambda e: F.struct(e.title.alias("title"), F.coalesce(some(F.get(F.filter(e.link, lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(0))["_href"]), some(e.id)).alias("link"), F.coalesce(e.published, e.updated).alias("date"), F.coalesce(e.summary, e.content["_VALUE"]).alias("summary")),
    )
    rows = parsed.select("type", "feed", "stamp", F.posexplode(F.coalesce(rss, atom)).alias("at", "i"))
    return rows.select("type", "feed", "stamp", "at", tx.strip_html(F.col("i.title")).alias("title"), F.col("i.link").alias("link"), mp.feed_time(F.col("i.date")).alias("published_at"), tx.strip_html(F.col("i.summary")).alias("summary"))


def markdown_items(df: DataFrame) -> DataFrame:
    """A row for each section of a newsletter."""
    split = df.select("type", "feed", "stamp", F.posexplode(F.split("body", r"\n---\n")).alias("at", "text"))
    return mp.newsletter_sections(split).select("type", "feed", "stamp", "at", "title", "link", F.lit(None).cast("timestamp_ntz").alias("published_at"), "summary")


def json_items(df: DataFrame) -> DataFrame:
    """A row for each sure article of an aggregate."""
    articles = F.from_json("body", "struct<articles:array<string>>")["articles"]
    one = df.select("type", "feed", "stamp", F.posexplode(articles).alias("at", "one"))
    files = one.select("type", "feed", "stamp", "at", F.concat(F.lit('{"articles":['), "one", F.lit("]}")).alias("json"))
    return mp.aggregate_articles(files).select("type", "feed", "stamp", "at", "title", F.col("url").alias("link"), F.lit(None).cast("timestamp_ntz").alias("published_at"), "summary")


def link_items(df: DataFrame) -> DataFrame:
    """A row for each link of a page of links (types ``link`` and ``code``)."""
    lines = df.select("type", "feed", "stamp", F.posexplode(F.split("body", "\n")).alias("at", "text"))
    return mp.markdown_links(lines).select("type", "feed", "stamp", "at", "title", "link", F.lit(None).cast("timestamp_ntz").alias("published_at"), F.col("title").alias("summary"))


#: Which reader takes which types.
READERS = [(XML_TYPES, xml_items), (["github_md_folder"], markdown_items), (["github_json"], json_items), (["link", "code"], link_items)]


def dispatched(rows: DataFrame) -> DataFrame:
    """The items of landed files of all types: every file goes to its type's reader; files of other types give none.

    Without shuffles and state, so it is the same for a batch and a stream.
    """
    parts = [reader(rows.where(F.col("type").isin(types))) for types, reader in READERS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.withColumn("title", F.trim("title")).where((F.length("title") > 0) & (F.length(F.trim("link")) > 0))
    return out.withColumns({"source_domain": ur.host(F.col("link")), "origin": F.when(F.col("type").isin(*CURATED_TYPES), "curated").otherwise("raw")})


def recent(published_at: Column, as_of: str, hours: float = 36.0) -> Column:
    """Whether an item is no older than so many hours; one without a date counts as recent."""
    start = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(mins=F.lit(int(hours * 60)))
    return published_at.isNull() | (published_at >= start)


def selected(items: DataFrame, as_of: str, score: Column, threshold: int, most_in: int = 6, most_out: int = 3) -> DataFrame:
    """Of each feed its best item and, up to ``most_out``, others whose score is enough; of XML feeds among their first recent items.

    Only ``most_in`` items of an XML feed are ranked. The order is by score, date and title, all descending.
    """
    xml = F.col("type").isin(*XML_TYPES)
    fresh = items.where(~xml | recent(F.col("published_at"), as_of))
    first = first_per(fresh.where(xml), ["type", "feed"], [F.asc("stamp"), F.asc("at")], most_in).unionByName(fresh.where(~xml))
    scored = first.withColumn("score", score)
    order = [F.desc("score"), F.desc(F.coalesce(F.col("published_at").cast("string"), F.lit(""))), F.desc("title"), F.asc("stamp"), F.asc("at")]
    placed = scored.withColumn("place", F.row_number().over(Window.partitionBy("type", "feed").orderBy(*order)))
    return placed.where((F.col("place") == 1) | ((F.col("place") <= most_out) & (F.col("score") >= threshold)))
