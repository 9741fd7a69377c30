"""Files as rows: scans, format detection, archives, manifests."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# File name endings and the kinds of their contents.
SUFFIXES = {
    "markdown": "md markdown mkd", "text": "txt text log", "rst": "rst rest", "json": "json geojson", "jsonl": "jsonl ndjson", "yaml": "yaml yml", "toml": "toml", "xml": "xml xsd svg",
    "csv": "csv", "tsv": "tsv tab", "python": "py pyi", "html": "html htm xhtml", "docx": "docx", "epub": "epub", "notebook": "ipynb", "latex": "tex latex", "xlsx": "xlsx xlsm",
    "parquet": "parquet pq", "sqlite": "sqlite sqlite3 db", "duckdb": "duckdb ddb", "npy": "npy", "npz": "npz", "arrow": "arrow feather ipc", "orc": "orc", "fits": "fits fit fts", "zip": "zip", "tar": "tar tgz",
}
DECLINED = {"pptx": "pptx", "pdf": "pdf", "hdf5": "h5 hdf5", "netcdf": "nc cdf", "code": "c cc cpp cs go h hpp java js jsx kt lua php pl r rb rs scala sh sql swift ts tsx zig"}
# First bytes (hex) of binary formats.
MAGIC = {
    "parquet": "50415231", "sqlite": "53514C69746520666F726D6174203300", "npy": "934E554D5059", "arrow": "4152524F5731", "orc": "4F5243", "pdf": "255044462D", "hdf5": "894844460D0A1A0A", "netcdf": "434446",
    "fits": "53494D504C4520203D", "gzip": "1F8B", "feather-v1": "46454131",
}
# Last bytes (hex) of formats that also end with a mark, and members that tell kinds of ZIP containers.
TAIL_MAGIC = {"parquet": "50415231$", "arrow": "4152524F5731$", "orc": "4F5243..$"}
ZIP_MEMBERS = {"xlsx": "xl/workbook.xml", "docx": "word/document.xml", "pptx": "ppt/presentation.xml", "epub": "mimetypeapplication/epub+zip"}


def scan(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(source, bytes, content, sha256) of the files below a path, hidden ones left out."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        read = read.option("pathGlobFilter", glob)
    return read.load(path).select(F.col("path").alias("source"), F.col("length").alias("bytes"), "content", F.sha2("content", 256).alias("sha256")).where(~F.col("source").rlike(r"/[._][^/]*(/|$)"))


def payload(spark: SparkSession, content: bytes, source: str = "stdin") -> DataFrame:
    """One file from bytes at hand (A3)."""
    df = spark.createDataFrame([(source, len(content), bytearray(content))], "source string, bytes long, content binary")
    return df.withColumn("sha256", F.sha2("content", 256))


def suffix_kind(source: Column) -> Column:
    end = F.lower(F.regexp_extract(source, r"\.([A-Za-z0-9]+)$", 1))
    kind = F.lit(None).cast("string")
    for name, ends in (SUFFIXES | DECLINED).items():
        kind = F.when(end.isin(*ends.split()), name).otherwise(kind)
    return kind


def kind_of(source: Column, content: Column, hint: Column | None = None) -> Column:
    """Kind of a file (D1): strong signature, then hint, then name ending, then a look at the text."""
    head, tail = F.hex(F.substring(content, 1, 16)), F.hex(F.substring(content, -8, 8))
    strong = F.lit(None).cast("string")
    for name, magic in MAGIC.items():
        here = head.startswith(magic)
        if name in TAIL_MAGIC:  # a whole file also ends so
            here = here & tail.rlike(TAIL_MAGIC[name])
        strong = F.when(here, name).otherwise(strong)
    strong = F.when(F.hex(F.substring(content, 9, 4)) == "4455434B", "duckdb").otherwise(strong)
    text = F.when(F.is_valid_utf8(content.cast("string")) & ~F.substring(content, 1, 4096).cast("string").rlike(r"[\x00-\x08\x0e-\x1f]"), F.substring(content, 1, 4096).cast("string"))
    start = F.ltrim(text)
    weak = F.when(F.lower(start).rlike("^<!doctype html|^<html"), "html").when(start.startswith("<?xml"), "xml").when(F.try_parse_json(text).isNotNull() & start.rlike(r"^[{\[]"), "json").when(text.isNotNull(), "text")
    # names of members stand in a ZIP container as they are
    inside = F.array_compact(F.array(*[F.when(F.contains(content, F.lit(mark.encode())), name) for name, mark in ZIP_MEMBERS.items()]))
    zipped = F.when(head.startswith("504B0304"), F.when(F.size(inside) == 1, inside[0]).when(F.size(inside) > 1, "ambiguous").otherwise(F.coalesce(suffix_kind(source), F.lit("zip"))))
    return F.coalesce(strong, zipped, *([hint] if hint is not None else []), suffix_kind(source), weak, F.lit("unknown"))


def unsafe_member(name: Column) -> Column:
    """Why an archive member's name is refused, or null (P10)."""
    return F.when(name == "", "empty").when(name.startswith("/") | name.rlike(r"^[A-Za-z]:"), "absolute").when(name.contains("\\"), "backslash").when(name.rlike(r"(^|/)\.\.(/|$)"), "traversal").when(name.rlike(r"[\x00-\x1f]"), "control")


MEMBER = "container string, source string, bytes long, content binary, sha256 string, reason string"


def members(archives: DataFrame, most: int = 2048, most_bytes: int = 64 << 20, ratio: int = 200, depth: int = 3) -> DataFrame:
    """Members of zip and tar files, nested ones to a depth (A8 to A10): content, or the reason for none.

    One task holds one archive and one member at a time. Refused: unsafe names, links, repeated names,
    encrypted members, sizes above the limit, ratios above ``ratio`` (beyond 1024 bytes), depth.
    """

    def walk(container: str, data: bytes, level: int):
        import hashlib
        import re

        seen: set[str] = set()

        def judge(name: str, size: int, packed: int | None, bad: str | None):
            if bad:
                return bad
            if not name or name.startswith("/") or re.match("[A-Za-z]:", name) or "\\" in name or ".." in name.split("/") or re.search(r"[\x00-\x1f]", name):
                return "unsafe-member"
            if name in seen:
                return "duplicate-member"
            seen.add(name)
            if len(seen) > most or size > most_bytes or (packed is not None and size > 1024 and size > ratio * max(1, packed)):
                return "limit"
            return None

        def emit(name, size, packed, bad, read):
            reason = judge(name, size, packed, bad)
            source = f"{container}!/{name}"
            if reason:
                yield container, source, size, None, None, reason
                return
            body = read()
            if zipfile.is_zipfile(io.BytesIO(body)) and name.endswith(".zip") or name.endswith((".tar", ".tgz", ".tar.gz")):
                if level + 1 >= depth:
                    yield container, source, size, None, None, "limit"
                else:
                    yield from walk(source, body, level + 1)
            else:
                yield container, source, size, body, hashlib.sha256(body).hexdigest(), None

        try:
            if zipfile.is_zipfile(io.BytesIO(data)):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for i in sorted(z.infolist(), key=lambda i: i.filename):
                        if not i.is_dir():
                            link = (i.external_attr >> 16) & 0o170000 == 0o120000
                            yield from emit(i.filename, i.file_size, i.compress_size, "encrypted-member" if i.flag_bits & 1 else "unsafe-member" if link else None, lambda i=i, z=z: z.read(i))
            else:
                with tarfile.open(fileobj=io.BytesIO(data)) as t:
                    for m in sorted(t.getmembers(), key=lambda m: m.name):
                        if not m.isdir():
                            yield from emit(m.name, m.size, None, None if m.isfile() else "unsafe-member", lambda m=m, t=t: t.extractfile(m).read())
        except (zipfile.BadZipFile, tarfile.TarError, EOFError, OSError) as e:
            yield container, container, len(data), None, None, f"extraction-error: {type(e).__name__}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in MEMBER.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.string()]
        for b in batches:
            for source, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for row in walk(source, content.as_py(), 0):
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

    return archives.select("source", "content").mapInArrow(run, MEMBER)


def manifest(files: DataFrame) -> DataFrame:
    """One row: number of files, their bytes and a digest over names and hashes in order."""
    line = F.concat_ws("\t", "source", "sha256")
    return files.agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("digest"))


def unclean_databases(files: DataFrame) -> DataFrame:
    """Databases with a non-empty side file of unfinished writes; they must not be read."""
    side = files.where("bytes > 0").select(F.regexp_extract("source", r"^(.*)(-wal|-journal|\.wal)$", 1).alias("source")).where("source <> ''")
    return files.join(side, "source", "left_semi").select("source")
