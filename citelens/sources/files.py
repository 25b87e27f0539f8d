"""Text files, archives, XML, lookups."""

from __future__ import annotations

import gzip
import io
import re
import tarfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BODY = re.compile(rb"\\begin\{document\}")
TEXT_SUFFIXES = (".tex", ".txt", ".bbl", ".ltx", "")


def write_named(files: DataFrame, folder: str) -> None:
    """Write each row of files (name, text) as a file of that name in a shared folder."""
    def put(batches):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        for batch in batches:
            for name, text in zip(batch["name"], batch["text"]):
                with store.open_output_stream(f"{path}/{name}") as out:
                    out.write(text.encode())
            yield batch[["name"]]

    files.mapInPandas(put, "name string").count()


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, parts: int, **options: str) -> DataFrame:
    """A table of a database, read in parts by ranges of a number column between its least and greatest value; filters and columns are pushed down to it."""
    source = lambda: spark.read.format("jdbc").option("url", url).options(**options)
    low, high = source().option("query", f'SELECT min("{column}") AS a, max("{column}") AS b FROM {table}').load().first()
    reader = source().option("dbtable", table)
    if low is not None and high > low:
        reader = reader.option("partitionColumn", column).option("lowerBound", str(low)).option("upperBound", str(high + 1)).option("numPartitions", str(parts))
    return reader.load()


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the file's stem), text of the .txt files of a folder; logs are left out."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt")
    return files.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.txt$", 1).alias("doc_id"), F.col("value").alias("text")).where("doc_id <> 'log'")


# Byte order marks, longest first.
MARKS = ((b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))


def encodings(content: bytes):
    """Encodings to try, the likeliest first: by its byte order mark, UTF-8, UTF-16 where every other byte is mostly zero, else the 8-bit one that leaves five bytes undefined."""
    for mark, name in MARKS:
        if content.startswith(mark):
            yield name
            break
    yield "utf-8"
    pairs = len(content) // 2
    if pairs and len(content) % 2 == 0:
        if content[1::2].count(0) > 0.4 * pairs:
            yield "utf-16-le"
        elif content[::2].count(0) > 0.4 * pairs:
            yield "utf-16-be"
    yield "cp1252"


def decoded(content: bytes) -> str:
    """The text by the first encoding that fits; by none of them, UTF-8 with replacements."""
    for name in encodings(content):
        try:
            text = content.decode(name)
        except UnicodeDecodeError:
            continue
        if name != "utf-8" or "\x00" not in text:
            return text
    return content.decode("utf-8", "replace")


def members(name: str, content: bytes) -> list[tuple[str, bytes]]:
    """Name and bytes of each file in a tar, a gzipped tar or a gzipped file; nested ones are opened. PDFs are dropped."""
    if name.lower().endswith(".pdf") or content[:5] == b"%PDF-":
        return []
    if content[:2] == b"\x1f\x8b":
        return members(re.sub(r"\.(gz|tgz)$", "", name), gzip.decompress(content))
    if len(content) > 262 and content[257:262] == b"ustar":
        with tarfile.open(fileobj=io.BytesIO(content)) as tar:
            return [m for t in tar.getmembers() if t.isfile() for m in members(t.name, tar.extractfile(t).read())]
    return [(name, content)]


def archive_members(archives: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """path, at, member, text of archives (path, content), at being the member's place in its archive; archives whose path is in done are left out."""
    if done is not None:
        archives = archives.join(done.select("path").distinct(), "path", "left_anti")

    def opened(batch, i):
        path, content = (batch.column(k)[i].as_py() for k in (0, 1))
        for at, (name, data) in enumerate(members(path.rsplit("/", 1)[-1], content)):
            yield path, at, name, decoded(data)

    return one_at_a_time(archives.select("path", "content"), opened, "path string, at long, member string, text string")


#: Bytes of texts, about, that a worker gathers before it passes them on.
GATHERED = 2 << 20


def one_at_a_time(rows: DataFrame, made, schema: str) -> DataFrame:
    """The rows that made(batch, i) yields for each row i of an Arrow batch. What is made is passed on whenever GATHERED bytes of it are there, so a worker holds
    a batch as it came and one row's results, not a batch's."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kinds = to_arrow_schema(_parse_datatype_string(schema))

    def every(batches):
        import pyarrow as pa

        def passed(held):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], kind.type) for k, kind in enumerate(kinds)], kinds.names)

        for batch in batches:
            held, size = [], 0
            for i in range(batch.num_rows):
                for row in made(batch, i):
                    held.append(row)
                    size += sum(len(x) if isinstance(x, (str, bytes)) else 8 for x in row)
                    if size >= GATHERED:
                        yield passed(held)
                        held, size = [], 0
            if held:
                yield passed(held)

    return rows.mapInArrow(every, schema)


def resumed(archives: DataFrame, done: str, out: str) -> DataFrame:
    """Members of all archives, written to out; paths listed at done are skipped, and those written now are appended there afterwards."""
    spark = archives.sparkSession
    listed = spark.read.schema("path string").parquet(done) if exists(spark, done) else None
    archive_members(archives, listed).write.mode("append").parquet(out)
    every = spark.read.parquet(out)
    now = archives.select("path").join(listed, "path", "left_anti") if listed is not None else archives.select("path")
    now.distinct().write.mode("append").parquet(done)
    return every


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def write_in_batches(rows: DataFrame, key: Column, n: int, out: str) -> DataFrame:
    """rows as JSON under out, in n batches by a hash of the key, each a result on its own: a run that was stopped goes on with the batches that are not there."""
    spark = rows.sparkSession
    for i in range(n):
        if not exists(spark, f"{out}/batch={i}/_SUCCESS"):
            rows.where(F.pmod(F.xxhash64(key), F.lit(n)) == i).write.mode("overwrite").json(f"{out}/batch={i}")
    return spark.read.schema(rows.schema).json(out)


def main_sources(found: DataFrame, group: list[str]) -> DataFrame:
    """group, member, text: of each submission the file with a document body; .tex files before others, the last in the archive counts."""
    tex = F.lower("member").endswith(".tex")
    body = found.where(F.col("text").contains("\\begin{document}"))
    best = F.max_by(F.struct("member", "text"), F.struct(tex.cast("int"), F.col("at")))
    return body.groupBy(*group).agg(best.alias("m")).select(*group, "m.*")


def archive_of(rows: pd.DataFrame) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as tar:
        for name, text in zip(rows["member"], rows["text"]):
            data = text.encode()
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    return gzip.compress(out.getvalue(), mtime=0)


def read_records(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def xml_record(name: str, /, **fields: Column) -> Column:
    """An element with one child for each field, escaped."""
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.concat(F.lit(f"<{name}>"), *[F.concat(F.lit(f"<{k}>"), escape(v.cast("string")), F.lit(f"</{k}>")) for k, v in fields.items()], F.lit(f"</{name}>"))


def search_document(**fields: Column) -> Column:
    """A search index's add document with named fields."""
    return F.concat(F.lit("<add><doc>"), *[F.concat(F.lit(f'<field name="{k}">'), v.cast("string"), F.lit("</field>")) for k, v in fields.items()], F.lit("</doc></add>"))


def numbered_batches(rows: DataFrame, n: int, order: Column) -> DataFrame:
    """rows with batch: the i-th of a count goes to min(i // (count // n), n - 1), rows being numbered by the order."""
    from citelens.operators.ranking import numbered

    found, count = numbered(rows, order, name="__i")
    return found.withColumn("batch", F.least(F.floor(F.col("__i") / max(count // n, 1)), F.lit(n - 1)).cast("int")).drop("__i")


def updated(rows: DataFrame, changes: DataFrame, key: str, value: str) -> DataFrame:
    """rows with the changed values where they differ: a rewrite, as plain files have no update in place."""
    new = changes.select(key, F.col(value).alias("__new"))
    return rows.join(new, key, "left").withColumn(value, F.coalesce("__new", value)).drop("__new")
