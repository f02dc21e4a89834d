"""Files to pages, one row for each page: text files by chunks, others as whole binaries with a parser for each kind."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path
from typing import BinaryIO
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from claimweave.operators.triage import printed_page
from claimweave.sources.store import bounded, checkpointed

#: From a file's bytes to (title, pages' texts).
Parser = Callable[[bytes], tuple[str | None, list[str]]]


def parse_text(content: bytes) -> tuple[str | None, list[str]]:
    """Plain text with form feeds between pages; the first line that isn't blank is the title."""
    pages = content.decode("utf-8", "replace").split("\f")
    return next((line.strip() for line in pages[0].split("\n") if line.strip()), None), pages


def parse_pdf(content: bytes) -> tuple[str | None, list[str]]:
    """PDF by PyMuPDF, where that is installed on the executors."""
    try:
        import fitz
    except ImportError as e:
        raise RuntimeError("reading PDF files needs PyMuPDF; give read_documents another parser") from e
    with fitz.open(stream=content, filetype="pdf") as doc:
        return (doc.metadata or {}).get("title", "").strip() or None, [page.get_text() for page in doc]


#: Bytes of a text file in which a task looks for the starts of pages, and bytes read at a time.
CHUNK, STEP = 64 << 20, 1 << 20
#: Bytes that read_text_documents gives a task, however small the chunks are, and what opening a file counts as.
TASK, OPENING = 32 << 20, 1 << 20
#: The most documents whose names and titles are broadcast.
MOST_BROADCAST = 1_000_000


def as_uri(path: str) -> str:
    return path if re.match(r"[A-Za-z][\w+.-]*:/", path) else Path(path).absolute().as_uri()


def opened(uri: str) -> BinaryIO:
    files, path = fs.FileSystem.from_uri(uri)
    return files.open_input_file(path)


def placed_pages(f: BinaryIO, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(its first byte, page) of the pages of a text file that start from byte start on and before end, each with what follows of it; held one at a time.

    A page starts with the file and after each form feed, so a file that ends with one has an empty last page.
    """
    at, held, found, ended = max(start - 1, 0), b"", -1, False
    f.seek(at)
    if start:
        while found < 0:
            at += len(held)
            held = f.read(STEP)
            if not held or at >= end:
                return
            found = held.find(b"\f")
        at += found + 1
    here = found + 1
    while at < end:
        parts = []
        while (found := held.find(b"\f", here)) < 0:
            parts.append(held[here:])
            held, here = f.read(STEP), 0
            if not held:
                ended = True
                break
        page = b"".join(parts) + (b"" if ended else held[here:found])
        yield at, page
        if ended:
            return
        here = found + 1
        at += len(page) + 1


def pages_between(f: BinaryIO, start: int, end: int) -> Iterator[bytes]:
    return (page for _, page in placed_pages(f, start, end))


@dataclass
class Chunks(InputPartition):
    """Stretches (path, first byte, end) of files, each of whole chunks."""

    stretches: list[tuple[str, int, int]]


class PageSource(DataSource):
    """Text files as pages, (path, chunk, place, text): a partition for each task bytes of files, so that large files are split.

    place numbers the pages that start in a chunk from 0. Options: path, a folder's or a file's URI; suffix, .txt by
    itself; chunk; task, as large as a chunk by itself; show, all by itself, places for null texts, first for the first
    page of each file alone.
    """

    @classmethod
    def name(cls) -> str:
        return "formfeed_pages"

    def schema(self) -> str:
        return "path string, chunk int, place int, text string"

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)


#: Pages and bytes that are handed over at a time.
BATCH_PAGES, BATCH_BYTES = 10_000, 8 << 20


class PageReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.suffix, self.chunk = options["path"], options.get("suffix", ".txt"), int(options.get("chunk", CHUNK))
        self.task, self.show = int(options.get("task", self.chunk)), options.get("show", "all")

    def partitions(self) -> list[Chunks]:
        uri = urlsplit(as_uri(self.path))
        files, path = fs.FileSystem.from_uri(uri.geturl())
        there = files.get_file_info(path)
        found = files.get_file_info(fs.FileSelector(path, recursive=True)) if there.type == fs.FileType.Directory else [there]
        sizes = sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and x.path.endswith(self.suffix))
        lead = lambda name: f"{uri.scheme}://{uri.netloc if name.startswith('/') else ''}"
        out, room = [], 0
        for name, size in sizes:
            start, last = 0, 1 if self.show == "first" else size + 1
            while start < last:
                if room < self.chunk:
                    out.append(Chunks([]))
                    room = max(self.task, self.chunk)
                end = min(start + room // self.chunk * self.chunk, last)
                out[-1].stretches.append((lead(name) + name, start, end))
                room -= max(end - start, OPENING if self.task > self.chunk else 0)
                start = end
        return out

    def read(self, part: Chunks) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for path, start, end in part.stretches:
            with opened(path) as f:
                chunk, place = -1, 0
                for at, page in placed_pages(f, start, end):
                    place = place + 1 if at // self.chunk == chunk else 0
                    chunk = at // self.chunk
                    rows.append((path, chunk, place, None if self.show == "places" else page.decode("utf-8", "replace")))
                    held += 0 if self.show == "places" else len(page)
                    if len(rows) >= BATCH_PAGES or held >= BATCH_BYTES:
                        yield batch(rows)
                        rows, held = [], 0
        if rows:
            yield batch(rows)


def batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["path", "chunk", "place", "text"])


def read_text_documents(spark: SparkSession, path: str, suffix: str = ".txt", chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(documents, pages) of the text files under path, by chunks of them; the rows are those of read_documents with parse_text.

    Files are hashed in steps, so no task holds one; a page's number is its place in its chunk after the pages of the
    chunks before it, which are counted. A task reads many chunks if they are small. Texts are handed over once, and
    stay where they are read unless there are more files or chunks than can be broadcast.
    """
    spark.dataSource.register(PageSource)
    shown = lambda show: spark.read.format(PageSource.name()).option("suffix", suffix).option("chunk", chunk).option("task", max(chunk, TASK)).option("show", show).load(path)

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            digests = []
            for name in frame["path"]:
                with opened(name) as f:
                    own = hashlib.sha256()
                    while part := f.read(STEP):
                        own.update(part)
                digests.append(own.hexdigest())
            yield pd.DataFrame({"path": frame["path"], "sha256": digests})

    counted = shown("places").groupBy("path", "chunk").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = bounded(counted.withColumn("before", before))
    files = counted.select("path").distinct().mapInPandas(hashed, "path string, sha256 string")
    kept = checkpointed(files.groupBy("sha256").agg(F.min("path").alias("path")))
    documents = kept.select(F.substring("sha256", 1, 12).alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("filename"), "path", "sha256")
    own = F.broadcast if kept.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else lambda df: df
    numbered = shown("all").join(own(documents.select("doc_id", "path")), "path").join(counted.select("path", "chunk", "before"), ["path", "chunk"])
    pages = numbered.select("doc_id", (F.col("before") + F.col("place") + 1).cast("int").alias("page_no"), "text")
    first = F.filter(F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    titles = own(checkpointed(shown("first").join(own(documents.select("doc_id", "path")), "path").select("doc_id", F.get(first, 0).alias("title"))))
    return documents, with_printed_page(pages.join(titles, "doc_id").select("doc_id", "title", "page_no", "text"))


def read_documents(spark: SparkSession, path: str, parser: Parser = parse_text, glob: str = "*.txt") -> tuple[DataFrame, DataFrame]:
    """(documents, pages) of the files under path. A document's id is the start of its content's hash.

    Files that hold the same bytes are one document, that with the first path. A file is parsed in one piece; text
    files without bound are read_text_documents' work.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    hashed = files.withColumn("sha256", F.sha2("content", 256))
    kept = hashed.groupBy("sha256").agg(F.min("path").alias("path"))
    documents = kept.select(F.substring("sha256", 1, 12).alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("filename"), "path", "sha256")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(doc, title, i + 1, text) for doc, content in zip(frame["doc_id"], frame["content"], strict=True) for title, texts in [parser(content)] for i, text in enumerate(texts)]
            yield pd.DataFrame(rows, columns=["doc_id", "title", "page_no", "text"])

    once = hashed.join(kept.select("path"), "path", "left_semi").select(F.substring("sha256", 1, 12).alias("doc_id"), "content")
    pages = once.mapInPandas(run, "doc_id string, title string, page_no int, text string")
    return documents, with_printed_page(pages)


def with_printed_page(pages: DataFrame) -> DataFrame:
    return pages.withColumn("printed_page", printed_page(F.col("text")))


def page_lookup(cited: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows with (doc_id, page_no) and their page's text; null where there is no such page."""
    return cited.join(pages.select("doc_id", "page_no", "text", "printed_page"), ["doc_id", "page_no"], "left")
