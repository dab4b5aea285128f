"""Pictures from files to hashes, and hashes to files of their own."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from glimmer.codec import preset
from glimmer.operators import images
from glimmer.sources import files, pictures

NAMES = ["small_pixel", "small_circle", "dct"]


def write(folder, sizes):
    folder.mkdir()
    rng = np.random.default_rng(3)
    for i, (w, h) in enumerate(sizes):
        (folder / f"p{i}.png").write_bytes(pictures.png(w, h, rng.integers(0, 256, (h, w, 3), dtype=np.uint8).tobytes()))
    (folder / "broken.png").write_bytes(b"no picture")


@pytest.mark.parametrize("name", NAMES)
def test_files_to_hashes_to_files(spark, tmp_path, name):
    codec = preset(name)
    write(tmp_path / "in", [(60, 30), (20, 90), (120, 120)])
    found = files.hashes(spark, f"{tmp_path}/in", codec).orderBy("origin").collect()
    edge = 100 if codec.shape == "dct" else 48
    assert [r.origin[-6:] for r in found] == ["p0.png", "p1.png", "p2.png"] and all(r.hash and r.error is None for r in found)
    assert max(found[2].w, found[2].h) == edge and (found[0].w, found[0].h) == ((60, 30) if edge == 100 else (48, 24))

    assert files.hashes(spark, f"{tmp_path}/in", codec, first=2).orderBy("origin").collect() == found[:2]

    files.register(spark)
    rows = [("a.SVG", found[0].hash), ("deep/b.png", found[1].hash), ("c", found[2].hash), ("bad.png", "zz"), ("bad.svg", None), ("../out.png", found[0].hash), (None, found[0].hash)]
    df = spark.createDataFrame(rows, "name string, hash string")
    out = files.drawn(df, codec, base=32)
    vector = set() if codec.shape == "dct" else {"a.SVG"}  # frequency hashes have no SVG
    assert {r.name for r in out.where("data is null and error is not null").collect()} == {"bad.png", "bad.svg", "a.SVG"} - vector
    out.select("name", "data").write.format("picture-files").mode("append").save(f"{tmp_path}/out")
    there = {str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert there == vector | {"deep/b.png", "c", "_SUCCESS"} and not (tmp_path / "out.png").exists()
    if vector:
        assert (tmp_path / "out/a.SVG").read_text() == images.to_svg(df.where("name = 'a.SVG'"), codec, base=32).first().svg
    one = images.decode(df.where("name = 'c'"), codec, base=32).first()
    pixels = np.stack([one.r, one.g, one.b], axis=-1).astype(np.uint8)
    assert (tmp_path / "out/c").read_bytes() == pictures.png(one.w, one.h, pixels.tobytes())
    # what was written is a picture to Spark again
    again = pictures.planes(pictures.read(spark, f"{tmp_path}/out", "*.png")).collect()
    assert len(again) == 1 and (again[0].w, again[0].h) == tuple(images.decode(df.where("name = 'deep/b.png'"), codec, base=32).select("w", "h").first())


def test_forced_formats(spark):
    codec = preset(NAMES[0])
    text = "80" + "5a" * 400
    df = spark.createDataFrame([("x.svg", text), ("y.png", text)], "name string, hash string")
    assert all(bytes(r.data).startswith(b"\x89PNG") for r in files.drawn(df, codec, fmt="png", base=16).collect())
    assert all(bytes(r.data).startswith(b"<svg") for r in files.drawn(df, codec, fmt="svg", base=16).collect())
    with pytest.raises(ValueError):
        files.drawn(df, codec, fmt="webp")


def test_a_task_that_fails_and_runs_again(tmp_path):
    batch = pa.RecordBatch.from_arrays([pa.array(["a", "b/c"]), pa.array([b"1", b"2" * 100_000])], names=["name", "data"])
    writer = files.FileWriter(f"file://{tmp_path}/out", 0, 1)

    def lost():
        yield batch.slice(0, 1)
        raise OSError("the executor is gone")

    with pytest.raises(OSError):
        writer.write(lost())
    writer.abort([None])
    assert not (tmp_path / "out/_SUCCESS").exists()
    message = writer.write(iter([batch]))
    writer.write(iter([batch]))  # a second attempt of the same task
    writer.commit([message])
    assert (message.files, message.skipped) == (2, 0)
    there = {str(p.relative_to(tmp_path / "out")): p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert there == {"a": b"1", "b/c": b"2" * 100_000, "_SUCCESS": b""}


def test_folders_are_not_overwritten(spark, tmp_path):
    files.register(spark)
    df = spark.createDataFrame([("a", b"1")], "name string, data binary")
    with pytest.raises(Exception, match="overwrite"):
        df.write.format("picture-files").mode("overwrite").save(f"{tmp_path}/out")
