"""Reader of large bibliography XML dumps: byte ranges read in parallel, records aligned at their opening tags."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from scholia.functions.text import tokens, year_of
from scholia.shared import cut

#: Record tags, and fields with the column they fill.
RECORDS = "article inproceedings proceedings book incollection phdthesis mastersthesis www".split()
FIELDS = {"title": "title", "author": "author", "year": "year", "journal": "journal", "booktitle": "journal", "volume": "volume", "month": "month", "cdrom": "cdrom", "ee": "ee", "url": "url"}
CHUNK = 32 << 20
#: Comments and CDATA sections whole (or their opening mark, where the end is not at hand), and record tags.
_TAG = re.compile(rb"<!--(?:.*?-->)?|<!\[CDATA\[(?:.*?\]\]>)?|<(/?)(" + "|".join(RECORDS).encode() + rb")(?=[\s/>])", re.S)
_MARK, _HEAD, _BACK = re.compile(rb"<!--|-->|<!\[CDATA\[|\]\]>"), re.compile(rb"[^>]*>"), 1 << 16
_ANY = re.compile(rb"<!--.*?-->|<!\[CDATA\[(.*?)\]\]>|<\?.*?\?>|<![^>]*>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>", re.S)
_XML = {b"&lt;": b"<", b"&gt;": b">", b"&quot;": b'"', b"&apos;": b"'", b"&amp;": b"&"}
RAW = "part int, ord long, title string, authors array<string>, journal string, year string, volume string, month string, cdrom string, ee string, url string"


def _value(raw: bytes) -> str:
    """Trimmed, the five named entities decoded once, broken UTF-8 dropped."""
    return re.sub(rb"&(?:lt|gt|quot|apos|amp);", lambda m: _XML[m[0]], raw.strip(b" \t\n\x0b\x0c\r")).decode("utf-8", "ignore")


def parse_record(body: bytes) -> dict:
    """Fields of what stands between a record's tags: the last value wins, authors gather."""
    out: dict = {c: "" for c in FIELDS.values()} | {"authors": []}
    del out["author"]
    active, text, at = None, b"", 0

    def flush() -> None:
        nonlocal active, text
        if active == "author":
            if value := _value(text):
                out["authors"].append(value)
        elif active:
            out[FIELDS[active]] = _value(text)
        active, text = None, b""

    for m in _ANY.finditer(body):
        if active:
            text += body[at : m.start()]
        at = m.end()
        if m[1] is not None:
            text += m[1] if active else b""
        elif m[3] is not None:
            tag = m[3].decode("ascii", "ignore").lower()
            if m[2]:
                if tag == active:
                    flush()
            elif tag in FIELDS:
                flush()
                active = tag
                if m[4].rstrip().endswith(b"/"):
                    flush()
    flush()
    return out


def _inside(read, start: int, size: int) -> int:
    """Where the comment or CDATA section ends that position `start` lies in; `start` itself, if in none.

    What opened last before it and is not closed before it holds it; blocks are read backwards until an
    opening or an end has been seen, so a range needs the bytes since the last of them, and no other range.
    """
    at, tail = start, read(start, min(size, start + 8))  # a mark may straddle the start
    while at > 0:
        a = max(0, at - _BACK)
        data = read(a, at) + tail
        marks = [(m.start(), m[0]) for m in _MARK.finditer(data) if a + m.start() < start]
        if marks:
            # an opening inside an open section is text: the first opening after the last end counts
            ends = [i for i, (_, x) in enumerate(marks) if x in (b"-->", b"]]>")]
            after = marks[ends[-1] + 1 :] if ends else marks
            if not after:
                return start
            if ends or a == 0:
                end = b"-->" if after[0][1] == b"<!--" else b"]]>"
                return _find(read, a + after[0][0] + len(after[0][1]), end, size)
        at, tail = a, data[:8] if not marks else data
    return start


def _find(read, at: int, mark: bytes, size: int) -> int:
    """The position after the next mark; the end of the file, if there is none."""
    data = b""
    while at < size:
        more = read(at, min(size, at + _BACK))
        found = (data + more).find(mark)
        if found >= 0:
            return at - len(data) + found + len(mark)
        at, data = at + len(more), more[-len(mark) :]
    return size


def records(read, start: int, stop: int, size: int) -> Iterator[dict]:
    """Records whose opening tag begins in [start, stop); read(a, b) gives bytes; one without its closing tag is dropped.

    Tags within comments and CDATA sections are none, wherever these begin.
    """
    base = _inside(read, start, size)
    # a tag may straddle the end of the range: look a little beyond it
    data, at = read(base, min(size, max(stop, base) + 64)), 0

    def more() -> bool:
        nonlocal data
        if base + len(data) >= size:
            return False
        data += read(base + len(data), min(size, base + len(data) + (1 << 20)))
        return True

    def token(at: int) -> re.Match | None:
        """The next comment, CDATA section or record tag, whole; None: there is no further one."""
        while True:
            m = _TAG.search(data, at)
            # what an opening mark begins may end beyond the bytes at hand
            if m and m[0] not in (b"<!--", b"<![CDATA["):
                return m
            if not m and base + len(data) >= stop + 64:
                return None
            if not more():
                return None

    while True:
        m = token(at)
        if not m or base + m.start() >= stop:
            return
        at = m.end()
        if m[2] is None or m[1]:
            continue
        name, first = m[2], m.end()
        while not (head := _HEAD.match(data, first)):
            if not more():
                return
        at = head.end()
        if head[0].endswith(b"/>"):
            continue
        # to the record's own closing tag
        while True:
            m = _TAG.search(data, at)
            if not m or m[0] in (b"<!--", b"<![CDATA[") or m.end() > len(data) - 2:
                if not more():
                    if not m or m[0] in (b"<!--", b"<![CDATA["):
                        return
                else:
                    continue
            if m[2] is not None and m[1] and m[2] == name:
                yield parse_record(data[head.end() : m.start()])
                close = data.find(b">", m.end())
                at = m.end() if close < 0 else close + 1
                break
            at = m.end()


class _Range(InputPartition):
    def __init__(self, part: int, path: str, start: int, stop: int, size: int):
        super().__init__(part)
        self.part, self.path, self.start, self.stop, self.size = part, path, start, stop, size


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.chunk = options["path"], int(options.get("chunkbytes", CHUNK))

    def partitions(self) -> list[_Range]:
        store, path = _open(self.path)
        info = store.get_file_info(path)
        files = [info] if info.type == fs.FileType.File else sorted((f for f in store.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)
        out = []
        for f in files:
            for a in range(0, f.size, self.chunk):
                out.append(_Range(len(out), f.path, a, min(f.size, a + self.chunk), f.size))
        return out or [_Range(0, path, 0, 0, 0)]

    def read(self, p: _Range) -> Iterator[tuple]:
        names = ("title", "authors", "journal", "year", "volume", "month", "cdrom", "ee", "url")
        if not p.size:
            return
        store, _ = _open(self.path)
        with store.open_input_file(p.path) as f:

            def read(a: int, b: int) -> bytes:
                f.seek(a)
                return f.read(b - a)

            for n, r in enumerate(records(read, p.start, p.stop, p.size)):
                yield (p.part, n, *(r[c] for c in names))


class BibliographySource(DataSource):
    """spark.read.format("bibliography").load(path); option chunkBytes sets the range of a partition."""

    @classmethod
    def name(cls) -> str:
        return "bibliography"

    def schema(self) -> str:
        return RAW

    def reader(self, schema) -> _Reader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def read_bibliography(spark: SparkSession, path: str, chunk_bytes: int = CHUNK) -> DataFrame:
    """Documents with dense ids in file order. Ids are each partition's ordinals plus the records before it."""
    spark.dataSource.register(BibliographySource)
    raw = spark.read.format("bibliography").option("chunkBytes", chunk_bytes).load(path)
    raw = cut(raw)  # the dump is parsed once
    counts = raw.groupBy("part").agg(F.count("*").alias("n"))
    # a row for each range of the dump; they are summed up in one task and joined
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    d = raw.join(before, "part").withColumn("doc_id", F.col("before") + F.col("ord")).withColumn("year", year_of(F.col("year")))
    return d.select("doc_id", "title", "authors", "journal", "year", F.size(tokens(F.col("title"))).alias("doc_length"), "volume", "month", "cdrom", "ee", "url")

