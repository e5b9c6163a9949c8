"""Files and archives as tables."""

from __future__ import annotations

import io
import re
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstream.functions import detect, persian

#: Folders that are never scanned; signatures of formats; encodings tried in turn; limits of an archive.
IGNORED = r"/(\.git|\.svn|node_modules|__pycache__|\.venv|venv|dist|build)/"
SIGNATURES = {"pdf": "%PDF", "zip": "PK\x03\x04", "html": "<!DOCTYPE", "xml": "<?xml", "latex": "\\documentclass", "rtf": "{\\rtf"}
ENCODINGS = ("utf-8", "utf-16", "windows-1256", "windows-1252", "latin-1")
MOST_MEMBERS = 10_000
MOST_BYTES = 2 * 1024**3


def scan(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, content, size_bytes, modified, format, kind): files below ``path`` without ignored folders, documents and assets.

    Contents are read only if a later step asks for them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    files = files.where(~F.col("path").rlike(IGNORED))
    kind = F.coalesce(detect.asset_kind(F.col("path")), F.when(detect.archive_kind(F.col("path")).isNotNull(), "archive"), F.lit("document"))
    return files.select("path", "content", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"), detect.format_of(F.col("path")).alias("format"), kind.alias("kind"))


def magic(content: Column) -> Column:
    """Format by the first bytes; null if none is known."""
    head = F.decode(F.substring(content, 1, 64), "iso-8859-1")
    head, out = F.regexp_replace(head, "^ï»¿", ""), None
    for name, sign in SIGNATURES.items():
        hit = F.lower(head).startswith(sign.lower())
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def decode(df: DataFrame, content: str = "content") -> DataFrame:
    """``df`` with text, encoding, has_bom, confidence and zwnj_count of a binary column.

    A byte-order mark is sure; valid UTF-8 is nearly so, and both stay in the
    JVM. Other bytes are tried in turn in one Arrow pass over those rows'
    contents only. Null contents have null texts.
    """

    @F.pandas_udf("struct<text:string,encoding:string,confidence:double>")
    def legacy(values):  # noqa: ANN001, ANN202
        import pandas as pd

        out = []
        for raw in values:
            found = (None, None, 0.0)
            if raw is not None:
                for name in ENCODINGS[1:]:
                    if name == "utf-16" and raw[:2] not in (b"\xff\xfe", b"\xfe\xff"):
                        continue
                    try:
                        found = (raw.decode(name), name, 0.8 if name == "utf-16" else 0.6)
                        break
                    except UnicodeDecodeError:
                        continue
            out.append(found)
        return pd.DataFrame(out, columns=["text", "encoding", "confidence"])

    c = F.col(content)
    bom = F.substring(c, 1, 3) == F.lit(b"\xef\xbb\xbf")
    rest = F.when(bom, F.expr(f"substring({content}, 4)")).otherwise(c)
    valid = F.is_valid_utf8(rest.cast("string"))
    df = df.withColumn("__old", F.when(~valid, legacy(F.when(~valid, c))))
    df = df.withColumn("text", F.when(valid, rest.cast("string")).otherwise(F.col("__old.text")))
    df = df.withColumn("encoding", F.when(bom, "utf-8-sig").when(valid, "utf-8").otherwise(F.col("__old.encoding")))
    df = df.withColumn("has_bom", bom).withColumn("confidence", F.when(bom, 1.0).when(valid, 0.8).otherwise(F.col("__old.confidence")))
    return df.withColumn("zwnj_count", persian.zwnj_count(F.col("text"))).drop("__old")


def _repaired(name: str, is_utf8: bool) -> str:
    """A member's name whose bytes were read as cp437, and Arabic letters in it."""
    if not is_utf8:
        try:
            raw = name.encode("cp437")
        except UnicodeEncodeError:
            raw = b""
        for codec in ("utf-8", "windows-1256"):
            try:
                better = raw.decode(codec)
            except UnicodeDecodeError:
                continue
            if re.search("[؀-ۿ]", better):
                name = better
                break
    return name.translate(str.maketrans(*persian.ARABIC_LETTERS_SHORT))


def _members(raw: bytes) -> Iterator[tuple[str, str, bytes | None, int, str | None]]:
    """(original name, name, content, size, error) of the regular files of one archive."""
    if raw[:4] == b"PK\x03\x04" or raw[:4] == b"PK\x05\x06":
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            infos = [i for i in z.infolist() if not i.is_dir()]
            if len(infos) > MOST_MEMBERS or sum(i.file_size for i in infos) > MOST_BYTES:
                raise ValueError("archive is too large")
            for i in infos:
                name = _repaired(i.filename, bool(i.flag_bits & 0x800) or i.filename.isascii())
                if i.flag_bits & 1:
                    yield i.filename, name, None, i.file_size, "encrypted"
                else:
                    yield i.filename, name, z.read(i), i.file_size, None
    else:
        with tarfile.open(fileobj=io.BytesIO(raw), mode="r:*") as t:
            total = count = 0
            for m in t:
                if m.isfile():
                    count, total = count + 1, total + m.size
                    if count > MOST_MEMBERS or total > MOST_BYTES:
                        raise ValueError("archive is too large")
                    yield m.name, _repaired(m.name, True), t.extractfile(m).read(), m.size, None


def expand(archives: DataFrame) -> DataFrame:
    """(archive, member, original_name, content, size_bytes, error) of ``archives`` (path, content).

    Names are repaired; a member that would leave the archive's root, an
    encrypted one, and an archive that is broken, too large or of an unknown
    kind is a row with an error and no content. Nothing is written to disk.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                try:
                    for original, name, content, size, error in _members(raw.as_py() or b""):
                        parts = re.split(r"[/\\]", name)
                        if ".." in parts or name.startswith(("/", "\\")) or re.match(r"[A-Za-z]:", name):
                            content, error = None, "unsafe path"
                        rows.append((path, name, original, content, size, error))
                except Exception as e:  # an error is a row
                    rows = [(path, None, None, None, None, str(e) or type(e).__name__)]
                types = (pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string())
                columns = list(zip(*rows, strict=True)) if rows else [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["archive", "member", "original_name", "content", "size_bytes", "error"])

    return archives.select("path", "content").mapInArrow(run, "archive string, member string, original_name string, content binary, size_bytes bigint, error string")
