"""Picture files to hashes in one step, and hashes drawn into files of their own.

Reading is Spark's image source, so inputs lie in any store that Spark reads.  Writing is a data
source of its own, ``picture-files``, as Spark's file sinks name files by task: a row (name,
data) becomes one file.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..codec import Codec
from ..operators import fit, images
from ..operators.effects import RenderStyle
from . import pictures

FORMATS = ("auto", "png", "svg")


def hashes(spark: SparkSession, path: str, codec: Codec, glob: str = "*.{png,jpg,jpeg}", seed: int = 0, options: fit.SearchOptions | None = None, keep_alpha: bool = False, first: int | None = None) -> DataFrame:
    """(origin, w, h, hash, error) of the pictures below ``path``, brought to a long edge of 100 (frequency hashes) or 48.

    Opacity is left out, so that a picture counts by its colours alone; frequency hashes
    have it with ``keep_alpha``, others then see the picture on white.  ``first`` takes that many
    pictures, by path.
    """
    edge = 100 if codec.shape == "dct" else 48
    found = pictures.read(spark, path, glob)
    if first is not None:
        found = found.orderBy("image.origin").limit(first)
    rows = pictures.planes(found, edge, keep_alpha)
    return images.encode(rows, codec, seed, options, "a" if keep_alpha else None).select("origin", "w", "h", "hash", "error")


def _files(batches: Iterator[pa.RecordBatch], n: int, schema: T.StructType) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        w, h = (batch.column(n + i).to_pylist() for i in range(2))
        data = []
        for i in range(len(batch)):
            planes = [batch.column(n + k)[i].values for k in (2, 3, 4)]
            data.append(None if planes[0] is None else pictures.png(w[i], h[i], np.stack([np.asarray(p) for p in planes], axis=-1).astype(np.uint8).tobytes()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(data, type=pa.binary()), batch.column(n + 5)], names=schema.names)


def drawn(df: DataFrame, codec: Codec | str, name: str = "name", hash_: str = "hash", fmt: str = "auto", base: int = 256, blur: float = 0.0, style: RenderStyle = RenderStyle()) -> DataFrame:
    """(name, data, error): each hash as the bytes of a file.

    With ``auto`` a name that ends in .svg is drawn as SVG, any other as PNG.  ``data`` is null, and
    ``error`` says why, where a hash can't be drawn.  ``blur`` is for SVG; ``style`` may blur pixels.
    """
    if fmt not in FORMATS:
        raise ValueError(f"the format must be one of {', '.join(FORMATS)}")
    column = codec if isinstance(codec, str) else None
    rows = df.select(F.col(f"`{name}`").alias("name"), F.col(f"`{hash_}`").alias("hash"), *([F.col(f"`{column}`").alias("codec")] if column else []))
    of = "codec" if column else codec
    vector = F.lit(fmt == "svg") if fmt != "auto" else F.coalesce(F.lower("name").endswith(".svg"), F.lit(False))
    out = []
    if fmt != "png":
        texts = images.to_svg(rows.where(vector), of, base=base, blur=blur, style=style)
        out.append(texts.select("name", F.encode("svg", "UTF-8").alias("data"), "error"))
    if fmt != "svg":
        pixels = images.decode(rows.where(~vector), of, base=base, style=style).select("name", "w", "h", "r", "g", "b", "error")
        schema = T.StructType([pixels.schema["name"], T.StructField("data", T.BinaryType()), T.StructField("error", T.StringType())])
        out.append(pixels.mapInArrow(lambda batches: _files(batches, 1, schema), schema))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


@dataclass
class Written(WriterCommitMessage):
    files: int
    skipped: int


def _inside(name: str | None) -> bool:
    """Whether a name stays below the folder, and isn't one that readers pass over."""
    parts = (name or "").split("/")
    return all(p and p[0] not in "._" and "\\" not in p for p in parts)


class PictureFiles(DataSource):
    """``df.write.format("picture-files").mode("append").save(folder)`` of (name string, data binary).

    A name may hold folders.  A file appears under its name only once it is whole, so a task that
    is run again, or twice at a time, does no harm; of rows with one name any may win.  Rows
    without data, or whose name is null, hidden or leads elsewhere, are left out.  ``_SUCCESS``
    is written when all tasks are done; files of a job that failed stay.
    """

    @classmethod
    def name(cls) -> str:
        return "picture-files"

    def schema(self) -> str:
        return "name string, data binary"

    def writer(self, schema: T.StructType, overwrite: bool) -> FileWriter:
        if overwrite:
            raise ValueError("picture-files can't overwrite a folder; write to a new one, or append")
        if "path" not in self.options:
            raise ValueError("picture-files needs a path")
        at = {f.name: i for i, f in enumerate(schema.fields)}
        if not {"name", "data"} <= set(at):
            raise ValueError("picture-files needs the columns name and data")
        return FileWriter(self.options["path"], at["name"], at["data"])


class FileWriter(DataSourceArrowWriter):
    def __init__(self, path: str, name: int, data: int):
        self.path, self.name, self.data = path.rstrip("/"), name, data

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = self._store()
        files = skipped = 0
        for batch in iterator:
            for name, data in zip(batch.column(self.name).to_pylist(), batch.column(self.data).to_pylist(), strict=True):
                if data is None or not _inside(name):
                    skipped += 1
                    continue
                folder, _, last = f"{root}/{name}".rpartition("/")
                store.create_dir(folder, recursive=True)
                part = f"{folder}/._{last}.{uuid.uuid4().hex}"
                try:
                    with store.open_output_stream(part) as out:
                        out.write(data)
                    store.move(part, f"{folder}/{last}")
                except BaseException:
                    if store.get_file_info(part).type != fs.FileType.NotFound:
                        store.delete_file(part)
                    raise
                files += 1
        return Written(files, skipped)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = self._store()
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Files that were written are whole and stay; the mark of success is missing."""


def register(spark: SparkSession) -> None:
    """Makes ``picture-files`` known to a session."""
    spark.dataSource.register(PictureFiles)
