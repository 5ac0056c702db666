"""BAM and FASTQ files as formats of ``spark.read``.

Files are cut into spans by their sizes alone, so planning reads no content; where small spans were more than :data:`MOST_TASKS`, they grow. The task of a span finds the first record of its span and of the next one in the
bytes (:mod:`guess`) and reads what lies between. Fields that the schema does not name are not decoded, other files than
those asked for are not opened, and records of other references are left out before their fields are decoded.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SPAN = 32 << 20
#: Tasks of a load whose spans are smaller than :data:`SPAN`.
MOST_TASKS = 500
PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

BAM_SCHEMA = (
    "file string, ref_id int, pos int, read_name string, mapq int, flag int, l_seq int, spliced boolean, cb string, cr string, ub string, ur string, "
    "gx string, gn string, re string, rg string, mm_upper bigint, mm_lower bigint, nh bigint, xf string, error string"
)
FASTQ_SCHEMA = "file string, header string, seq string, plus string, qual string, tail boolean, error string"


@dataclass
class Span(InputPartition):
    """A stretch of a file."""

    path: str
    start: int
    stop: int


def _import_package() -> None:
    """Planning runs in a Python process of its own on the driver, which may not know the package."""
    try:
        import strandcheck.sources.bam  # noqa: F401
    except ImportError:
        sys.path.insert(0, PACKAGE_ROOT)


class _Reader(DataSourceReader):
    pattern = ""

    def __init__(self, options: dict, schema: T.StructType):
        self.paths = [p for p in options.get("path", "").split(",") if p]
        if not self.paths:
            raise ValueError("load() needs the path of a file or folder")
        self.span = int(options.get("span", SPAN))
        self.names = schema.fieldNames()
        self.schema = schema
        self.files: set[str] | None = None
        self.references: list[int] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("file",):
                self.files = values if self.files is None else self.files & values
            elif values is not None and f.attribute == ("ref_id",):
                self.references = sorted(values if self.references is None else values & set(self.references))
            yield f  # Spark looks at the rows again: rows with an error have no reference

    def partitions(self) -> list[Span]:
        _import_package()
        import re

        import pyarrow.fs as pafs

        from strandcheck.sources.storage import filesystem

        found = []
        for path in self.paths:
            store, inner = filesystem(path)
            prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
            info = store.get_file_info(inner)
            listed = [info] if info.is_file else store.get_file_info(pafs.FileSelector(inner, recursive=True))
            found += [(prefix + i.path, i.size) for i in listed if i.is_file and re.search(self.pattern, i.path)]
        found = [(path, size) for path, size in sorted(found) if self.files is None or path in self.files]
        span = max(self.span, min(SPAN, -(-sum(size for _, size in found) // MOST_TASKS)))
        return [Span(path, at, min(size, at + span)) for path, size in found for at in range(0, max(size, 1), span)]

    def read(self, partition: Span) -> Iterator:
        _import_package()
        from pyspark.sql.pandas.types import to_arrow_schema

        from strandcheck.sources.storage import as_batch

        arrow = to_arrow_schema(self.schema)
        for rows in self.rows(partition):
            if isinstance(rows, dict):
                rows = {"file": partition.path} | {k: v for k, v in rows.items() if k in self.names or k == "seq_in_point"}
            else:
                rows = [{k: v for k, v in r.items() if k in self.names} for r in rows]
            if (batch := as_batch(rows, arrow)) is not None:
                yield batch


class BamReader(_Reader):
    pattern = r"(?i)\.bam$"

    def rows(self, part: Span) -> Iterator:
        from strandcheck.functions.constants import WANTED_TAGS
        from strandcheck.sources import bam, bgzf, guess
        from strandcheck.sources.storage import open_range

        columns = {"MM": "mm_upper", "mm": "mm_lower"}
        tags = tuple(t for t in WANTED_TAGS if columns.get(t, t.lower()) in self.names)
        try:
            with open_range(part.path) as source:
                size = source.size()
                header = bam._read_header({"path": part.path})
                begins = header["first_record"]
                search = (len(header["refs"]), bam.LARGEST_RECORD)
                first = begins if part.start <= begins >> 16 < part.stop else guess.first_record(source, part.start, part.stop, size, *search)
                if first is None or first < begins:
                    return
                end = guess.first_record(source, part.stop, size, size, *search) if part.stop < size else None
        except (bam.BamError, bgzf.BgzfError, OSError) as problem:
            if part.start == 0:
                yield [{"file": part.path, "error": str(problem)}]
            return
        row = {"path": part.path, "file": part.path, "point_no": 0, "voffset": first, "end": end}
        yield from bam.records_of_range(row, 4 << 20, tags, bam.LARGEST_RECORD, self.references)


class FastqReader(_Reader):
    pattern = r"(?i)\.(fastq|fq)(\.gz)?$"

    def rows(self, part: Span) -> Iterator:
        from strandcheck.sources import bgzf, fastq
        from strandcheck.sources.storage import open_range

        try:
            with open_range(part.path) as source:
                head = source.read(12 + 65535)
                packed = head[:2] == b"\x1f\x8b"
                try:
                    blocked = packed and bgzf.block_size(head) > 0
                except bgzf.BgzfError:
                    blocked = False
                if packed and not blocked and part.start:
                    return  # one stream, read by the first span
                source.seek(0)
                row = {"gzip": packed, "bgzip": blocked, "start": part.start, "end": part.stop}
                for group in fastq.records_of(row, source):
                    yield fastq.columns_of(group)
        except (fastq.FastqError, OSError) as problem:
            yield [{"file": part.path, "error": str(problem)}]


class BamFormat(DataSource):
    """``spark.read.format("bam").load(path)``; of a given schema only the fields named are decoded, option ``span`` sets the least bytes of a task."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return BAM_SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return BamReader(self.options, schema)


class FastqFormat(DataSource):
    """``spark.read.format("fastq").load(path)``: raw records, plain, gzip or bgzip."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return FASTQ_SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return FastqReader(self.options, schema)


def register(spark: SparkSession) -> None:
    """Makes ``bam`` and ``fastq`` known to ``spark.read``."""
    from ..session import ship_package

    ship_package(spark)
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (BamFormat, FastqFormat):
        spark.dataSource.register(source)
