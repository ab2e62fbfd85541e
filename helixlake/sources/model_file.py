"""Models as one binary file: a mark of eight bytes, the settings, then the matrices in order.

All numbers are little-endian: integers of four bytes, doubles of eight. A matrix is its rows, its columns and its
values; the four vectors of a layer's norms are values alone. The mark is the writing program's: files of another one
are read and written with its mark given.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from helixlake.plans.kernels import LABELS, Params, layout, position_codes
from helixlake.sources.config import Config
from helixlake.sources.files import located

SCHEMA = "ord int, name string, rows int, cols int, data array<double>"
MARK = "HELIXMD1"
#: Settings in the order of the file; there are no decoder layers.
SETTINGS = ("d_model", "num_encoder_layers", "decoder_layers", "num_heads", "d_ff", "num_labels", "num_scales")
#: Vectors that stand in the file without rows and columns.
BARE = ("g1", "e1", "g2", "e2")


def file_layout(d_model: int, layers: int, d_ff: int, scales: int, window: int) -> list[tuple[str, int, int]]:
    """(name, rows, columns) of what the file holds: the position codes stand behind the projection."""
    first, *rest = layout(d_model, layers, d_ff, scales)
    return [first, ("positions", window, d_model), *rest]


def _bare(name: str) -> bool:
    return name.rsplit(".", 1)[-1] in BARE


def header(config: Config, mark: str = MARK) -> bytes:
    if len(mark.encode()) != 8:
        raise ValueError("the mark has eight bytes")
    scales = config.cwt_scales
    numbers = (config.d_model, config.num_encoder_layers, 0, config.num_heads, config.d_ff, LABELS, len(scales))
    return mark.encode() + struct.pack("<7i", *numbers) + struct.pack(f"<{len(scales)}d", *scales)


def read_header(data: bytes, mark: str | None = None) -> tuple[dict[str, int], tuple[float, ...], int]:
    """Settings, scales, and where the matrices begin."""
    if len(data) < 36 or (mark is not None and data[:8] != mark.encode()):
        raise ValueError("this is no model file, or one with another mark")
    settings = dict(zip(SETTINGS, struct.unpack("<7i", data[8:36])))
    n = settings["num_scales"]
    if settings["decoder_layers"] or n < 0 or len(data) < 36 + 8 * n:
        raise ValueError("the model file's settings can't be read")
    return settings, struct.unpack(f"<{n}d", data[36 : 36 + 8 * n]), 36 + 8 * n


class Matrix(InputPartition):
    def __init__(self, number: int, name: str, rows: int, cols: int, at: int):
        super().__init__((number, name, rows, cols, at))


class ModelReader(DataSourceReader):
    """A partition a matrix: the header tells where each one stands, so that no task reads another's."""

    def __init__(self, options: dict[str, str]):
        self.path, self.mark = options["path"], options.get("mark")

    def partitions(self) -> list[Matrix]:
        system, place = located(self.path)
        out = []
        with system.open_input_file(place) as file:
            total = file.size()
            settings, _, at = read_header(file.read_at(min(total, 1 << 16), 0), self.mark)
            first = struct.unpack("<2i", file.read_at(8, at))
            window = struct.unpack("<2i", file.read_at(8, at + 8 + 8 * first[0] * first[1]))[0]
        d, layers, d_ff, scales = (settings[s] for s in ("d_model", "num_encoder_layers", "d_ff", "num_scales"))
        for number, (name, rows, cols) in enumerate(file_layout(d, layers, d_ff, scales, window)):
            out.append(Matrix(number, name, rows, cols, at))
            at += 8 * rows * cols + (0 if _bare(name) else 8)
        if at != total:
            raise ValueError(f"the model file has {total} bytes, its settings ask for {at}")
        return out

    def read(self, partition: Matrix) -> Iterator[tuple]:
        number, name, rows, cols, at = partition.value
        system, place = located(self.path)
        with system.open_input_file(place) as file:
            if not _bare(name):
                if struct.unpack("<2i", file.read_at(8, at)) != (rows, cols):
                    raise ValueError(f"{name} isn't {rows} x {cols} in the model file")
                at += 8
            data = file.read_at(8 * rows * cols, at)
        yield number, name, rows, cols, np.frombuffer(data, dtype="<f8").tolist()


class Written(WriterCommitMessage):
    def __init__(self, parts: list[tuple[int, str, int]]):
        self.parts = parts


class ModelWriter(DataSourceWriter):
    """Tasks write a part a matrix; the commit puts the parts of those that succeeded in order behind the header.

    Parts of attempts that were lost have other names and go with the folder.
    """

    def __init__(self, options: dict[str, str]):
        self.path, self.head = options["path"], bytes.fromhex(options["header"])
        self.parts, self.count = f"{self.path}.parts-{uuid.uuid4().hex}", int(options["matrices"])

    def write(self, iterator: Iterator) -> Written:
        system, folder = located(self.parts)
        system.create_dir(folder, recursive=True)
        out = []
        for row in iterator:
            if len(row["data"]) != row["rows"] * row["cols"]:
                raise ValueError(f"{row['name']} hasn't {row['rows']} x {row['cols']} values")
            shape = b"" if _bare(row["name"]) else struct.pack("<2i", row["rows"], row["cols"])
            place = f"{folder}/{row['ord']}-{uuid.uuid4().hex}"
            with system.open_output_stream(place) as stream:
                stream.write(shape + np.asarray(row["data"], dtype="<f8").tobytes())
            out.append((row["ord"], place, len(row["data"])))
        return Written(out)

    def commit(self, messages: list[Written | None]) -> None:
        system, place = located(self.path)
        parts = sorted(p for m in messages if m for p in m.parts)
        if [p[0] for p in parts] != list(range(self.count)):
            self.abort(messages)
            raise ValueError(f"{self.count} matrices in order are wanted, {[p[0] for p in parts]} were written")
        half = f"{place}.{uuid.uuid4().hex}"
        with system.open_output_stream(half) as out:
            out.write(self.head)
            for _, part, _ in parts:
                with system.open_input_stream(part) as source:
                    out.write(source.read())
        system.move(half, place)
        system.delete_dir(located(self.parts)[1])

    def abort(self, messages: list[Written | None]) -> None:
        system, folder = located(self.parts)
        if system.get_file_info(folder).type.name != "NotFound":
            system.delete_dir(folder)


class ModelFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "model_file"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ModelReader:
        return ModelReader(self.options)

    def writer(self, schema, overwrite: bool) -> ModelWriter:
        return ModelWriter(self.options)


def read_model_file(spark: SparkSession, path: str, mark: str | None = None) -> DataFrame:
    """(ord, name, rows, cols, data) of the matrices of a model file, the position codes among them."""
    spark.dataSource.register(ModelFile)
    reader = spark.read.format("model_file").option("path", path)
    return (reader.option("mark", mark) if mark else reader).load()


def write_model_file(spark: SparkSession, params: Params, config: Config, path: str, mark: str = MARK) -> None:
    """The weights and position codes of a model as one file."""
    held = file_layout(config.d_model, config.num_encoder_layers, config.d_ff, len(config.cwt_scales), config.window_size)
    values = params | {"positions": position_codes(config.window_size, config.d_model)}
    rows = [(k, name, n, m, values[name].ravel().tolist()) for k, (name, n, m) in enumerate(held)]
    spark.dataSource.register(ModelFile)
    frame = spark.createDataFrame(rows, SCHEMA)
    frame.write.format("model_file").option("path", path).option("header", header(config, mark).hex()).option("matrices", len(rows)).mode("append").save()


def load_model_file(spark: SparkSession, config: Config, path: str, mark: str | None = None) -> Params:
    """The weights of a model file, if its settings and shapes agree with the configuration."""
    system, place = located(path)
    with system.open_input_file(place) as file:
        settings, scales, _ = read_header(file.read_at(min(file.size(), 1 << 16), 0), mark)
    wanted, own_scales, _ = read_header(header(config))
    wrong = [name for name in SETTINGS if settings[name] != wanted[name]]
    if wrong:
        raise ValueError(f"the model at {path} doesn't fit the configuration: {', '.join(wrong)}")
    rows = {r["name"]: r for r in read_model_file(spark, path, mark).where(F.col("name") != "positions").collect()}
    return {name: np.array(rows[name]["data"]).reshape(n, m) for name, n, m in layout(config.d_model, config.num_encoder_layers, config.d_ff, len(config.cwt_scales))}
