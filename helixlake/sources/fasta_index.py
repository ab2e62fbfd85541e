"""Sequences read in ranges by the index of their FASTA file (name, length, offset, bases and bytes of a line).

A partition is a range of chunks, so that a record of any length is read by many tasks and never is one row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from helixlake.sources.files import located

SCHEMA = "ord bigint, id string, length bigint, chunk_start bigint, chunk_size int, chunk string"
#: Bases that one task reads, in chunks.
TASK_BASES = 1 << 24


def read_index(path: str) -> list[tuple[str, int, int, int, int]]:
    """(name, length, offset, bases of a line, bytes of a line) of each record, in order of the file."""
    system, place = located(path)
    with system.open_input_stream(place) as stream:
        lines = stream.read().decode().splitlines()
    rows = [line.split("\t")[:5] for line in lines if line.strip()]
    found = []
    for name, *numbers in rows:
        length, offset, bases, width = (int(x) for x in numbers)
        if length and not 0 < bases <= width:
            raise ValueError(f"the index of {name} has lines of {bases} bases in {width} bytes")
        found.append((name, length, offset, bases, width))
    return found


class Range(InputPartition):
    """The chunks of a record that begin at ``first`` up to ``last``, exclusive."""

    def __init__(self, number: int, record: tuple, first: int, last: int):
        super().__init__((number, record, first, last))


class IndexedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.size, self.halo = int(options.get("chunk", 1 << 16)), int(options.get("halo", 0))
        self.size = max(self.size, self.halo, 1)
        self.index = options.get("index", self.path + ".fai")
        self.ids = set(json.loads(options["ids"])) if "ids" in options else None
        self.span = (int(options.get("first", 0)), int(options.get("last", 1 << 62)))

    def partitions(self) -> list[Range]:
        out = []
        step = max(1, TASK_BASES // self.size) * self.size
        for number, record in enumerate(read_index(self.index)):
            if self.ids is not None and record[0] not in self.ids:
                continue
            first, last = max(0, self.span[0]) // self.size * self.size, min(record[1], self.span[1])
            out += [Range(number, record, a, min(a + step, last)) for a in range(first, last, step)]
            if not record[1]:
                out.append(Range(number, record, 0, 0))
        return out or [Range(-1, ("", 0, 0, 1, 1), 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        number, (name, length, offset, bases, width), first, last = partition.value
        if not length:
            return  # as elsewhere, an empty record has no chunk
        system, place = located(self.path)
        at = lambda p: offset + p // bases * width + p % bases
        with system.open_input_file(place) as file:
            for start in range(first, last, self.size):
                size = min(self.size, length - start)
                end = min(length, start + size + self.halo)
                data = file.read_at(at(end - 1) + 1 - at(start), at(start))
                text = data.replace(b"\n", b"").replace(b"\r", b"").decode("latin-1")
                if len(text) != end - start:
                    raise ValueError(f"{self.path} doesn't fit its index at base {start} of {name}")
                yield number, name, length, start, size, text


class IndexedFasta(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta_index"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> IndexedReader:
        return IndexedReader(self.options)


def read_fasta_chunks(spark: SparkSession, path: str, halo: int = 0, chunk: int = 1 << 16, ids: list[str] | None = None, span: tuple[int, int] | None = None) -> DataFrame:
    """(ord, id, length, chunk_start, chunk_size, chunk) of a file with an index beside it (``.fai``): chunks of
    ``chunk`` bases and up to ``halo`` of those after, as ``windows.sequence_chunks`` cuts them.

    ``ids`` and ``span`` (bases, the end exclusive) plan only the ranges of some records, and the chunks that hold a base
    of the span; nothing else is read.
    """
    spark.dataSource.register(IndexedFasta)
    reader = spark.read.format("fasta_index").option("path", path).option("halo", halo).option("chunk", chunk)
    reader = reader if ids is None else reader.option("ids", json.dumps(ids))
    return (reader.option("first", span[0]).option("last", span[1]) if span else reader).load()
