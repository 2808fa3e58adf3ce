"""Token counts: a vectorised search for separators in flat token files without an index."""

from __future__ import annotations

import base64
import uuid
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .scratch import Scratch, ship

#: Bytes of a block, and of a file of the writer.
BLOCK_BYTES, FILE_BYTES = 4 << 20, 64 << 20
#: Blocks summed as one in the upper level of the prefix scan.
FAN = 1024


#: Names that Hadoop has for stores that the reader knows by another (fixed values).
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfss", "gs": "gs", "hdfs": "hdfs"}


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address, and the path there; a store that the reader does not know is an error that says so."""
    at = urlsplit(path)
    if at.scheme in ("", "file"):
        return pafs.LocalFileSystem(), at.path
    try:
        return pafs.FileSystem.from_uri(at._replace(scheme=SCHEMES.get(at.scheme, at.scheme)).geturl())
    except pa.ArrowInvalid as e:
        raise ValueError(f"token files cannot be read from {at.scheme}:// ({path})") from e


def sizes(spark: SparkSession, files: DataFrame) -> DataFrame:
    """(path, bytes) of token files named in column `path`."""
    ship(spark)

    @F.arrow_udf("bigint")
    def size(column: pa.Array) -> pa.Array:
        out = []
        for p in column.to_pylist():
            where, name = _open(p)
            out.append(where.get_file_info(name).size)
        return pa.array(out, pa.int64())

    return files.select("path", size("path").alias("bytes"))


def scan(files: DataFrame, separator: int, width: int = 2, block_bytes: int = BLOCK_BYTES, scratch: Scratch | None = None) -> DataFrame:
    """Documents of flat token files: (path, ordinal, start, n_tokens, closed).

    files has (path, bytes); each file is a run of little-endian unsigned integers of
    `width` bytes (2, 4 or 8), documents end with `separator`. ordinal counts the documents
    of a file from 0, start is the place of the first token, n_tokens leaves the separator
    out. Tokens after the last separator are one more document with closed = false; an
    empty file, or one that ends with a separator, has none. Bytes beyond the last whole
    token are refused. A path that files has twice is scanned as two rows of one file, so name
    each once; other columns of files are ignored; an empty table has no documents.

    Files are cut into blocks; a task reads a block, compares all of it with the
    separator at once and emits the places it finds. What is left to know of a block is
    three numbers, how many separators it holds and where the last one is: their prefix
    scan over the blocks of a file (two levels, FAN blocks to a sum) gives each block the
    ordinal of its first document and where that began, whichever earlier block that was.
    """
    spark = files.sparkSession
    ship(spark)
    step = block_bytes // width * width
    kind = {2: np.uint16, 4: np.uint32, 8: np.uint64}[width]
    bad = F.raise_error(F.concat(F.lit("not a whole number of tokens: "), F.col("path")))
    blocks = files.select("path", F.when(F.col("bytes") % width == 0, F.col("bytes")).otherwise(bad).alias("bytes")).where("bytes > 0")
    blocks = blocks.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(bytes - 1) div {step}"))).alias("block"))

    def search(batches):
        for b in batches:
            for p, size, k in zip(*[c.to_pylist() for c in b.columns]):
                where, name = _open(p)
                with where.open_input_file(name) as f:
                    f.seek(k * step)
                    data = np.frombuffer(f.read(min(step, size - k * step)), kind)
                at = np.flatnonzero(data == separator) + k * step // width
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([k], pa.int64()), pa.array([k * step // width + len(data)], pa.int64()), pa.array([at], pa.list_(pa.int64()))], names=["path", "block", "stop", "at"])

    parts = max(1, spark.sparkContext.defaultParallelism)
    found = blocks.repartition(parts * 4, "path", "block").mapInArrow(search, "path string, block bigint, stop bigint, at array<bigint>")
    # written, so that files are read once though the places are used twice
    return stitch((scratch or Scratch(spark, "separators")).keep(found, "separators"))


def stitch(found: DataFrame) -> DataFrame:
    """Documents from the separators of each block (path, block, stop, at): the prefix scan."""
    # the scan sorts three numbers of each block; the places of separators stay where they are
    facts = found.select("path", "block", F.size("at").cast("bigint").alias("n"), F.array_max("at").alias("last"), "stop", F.expr(f"block div {FAN}").alias("upper"))
    inner = Window.partitionBy("path", "upper").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    own = facts.select("path", "block", "upper", F.coalesce(F.sum("n").over(inner), F.lit(0)).alias("before"), F.max("last").over(inner).alias("from"))
    sums = facts.groupBy("path", "upper").agg(F.sum("n").alias("n"), F.max("last").alias("last"), F.max("stop").alias("stop"))
    outer = Window.partitionBy("path").orderBy("upper").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select("path", "upper", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("up_n"), F.max("last").over(outer).alias("up_last"))
    # the first document of a block began after the last separator of any earlier block
    begin = F.coalesce("from", "up_last", F.lit(-1).cast("bigint")) + 1
    begins = own.join(carry, ["path", "upper"]).select("path", "block", (F.col("before") + F.col("up_n")).alias("first"), begin.alias("begin"))
    placed = found.select("path", "block", "at").hint("merge").join(begins, ["path", "block"]).select("path", "first", "begin", "at")
    docs = placed.select("path", "first", "begin", "at", F.posexplode("at").alias("k", "end"))
    start = F.when(F.col("k") == 0, F.col("begin")).otherwise(F.get("at", F.col("k") - 1) + 1)
    closed = docs.select("path", (F.col("first") + F.col("k")).alias("ordinal"), start.alias("start"), (F.col("end") - start).alias("n_tokens"), F.lit(True).alias("closed"))
    total = sums.groupBy("path").agg(F.sum("n").alias("ordinal"), (F.coalesce(F.max("last"), F.lit(-1)) + 1).alias("start"), F.max("stop").alias("stop"))
    rest = total.where("stop > start").select("path", "ordinal", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.union(rest)


def _tokenizer(name: str):
    import public_tokenizers
    import tiktoken

    if name not in _LOADED:
        with open(SparkFiles.get(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[name] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[name]


_LOADED: dict = {}


def write_tokens(docs: DataFrame, folder: str, ranks: str, separator: int, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode texts into flat files of 16-bit tokens under folder, each text ended by separator.

    Returns the manifest (path, bytes, ids): one row per file, ids in the order of its
    texts. Null texts are empty ones, texts of any length are written whole, rows that repeat
    or have no id are written each; other columns are ignored, and an empty table makes no
    file. A file's bytes appear under its final name only when
    whole, and a task tried again writes a file of another name, so what the manifest
    names is complete whatever was lost before. folder must be shared by all executors.
    """
    spark = docs.sparkSession
    ship(spark)
    name = ranks.rsplit("/", 1)[-1]
    done = getattr(spark.sparkContext, "_filigree_files", None) or set()
    spark.sparkContext._filigree_files = done
    if ranks not in done:
        spark.sparkContext.addFile(ranks)
        done.add(ranks)
    kind = docs.schema[id_col].dataType.simpleString()

    def write(batches):
        encoding = _tokenizer(name)
        where, root = _open(folder)
        where.create_dir(root, recursive=True)
        end = np.array([separator], np.uint16).tobytes()
        part, n, ids, size, out, f = TaskContext.get().partitionId(), 0, [], 0, "", None

        def close():
            f.close()
            where.move(f"{out}.part", out)
            at = urlsplit(folder)
            uri = f"file://{out}" if at.scheme in ("", "file") else f"{at.scheme}://{at.netloc}{out if out.startswith('/') else '/' + out.partition('/')[2]}"
            return pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([size], pa.int64()), pa.array([ids], pa.list_(kind_of))], names=["path", "bytes", "ids"])

        kind_of = pa.int64()
        for b in batches:
            kind_of = b.column(0).type
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if f is None:
                    n, ids, size = n + 1, [], 0
                    out = f"{root}/{part:06d}-{n:04d}-{uuid.uuid4().hex}.bin"
                    f = where.open_output_stream(f"{out}.part")
                tokens = np.array(encoding.encode_ordinary(t or ""), np.uint16)
                f.write(tokens.tobytes())
                f.write(end)
                size += 2 * (len(tokens) + 1)
                ids.append(i)
                if size >= FILE_BYTES:
                    yield close()
                    f = None
        if f is not None:
            yield close()

    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(write, f"path string, bytes bigint, ids array<{kind}>")


def document_tokens(manifest: DataFrame, separator: int, scratch: Scratch | None = None) -> DataFrame:
    """(id, n_tokens) of each text behind a manifest of write_tokens, found by scanning its files; a row per row that was written, null ids and repeated ids too."""
    found = scan(manifest.select("path", "bytes"), separator, scratch=scratch).where("closed")
    names = manifest.select("path", F.posexplode("ids").alias("ordinal", "id"))
    names = names.withColumn("ordinal", F.col("ordinal").cast("bigint"))
    # both sides have a row per text, more than their file sizes tell: never broadcast
    return found.hint("merge").join(names, ["path", "ordinal"]).select("id", "n_tokens")
