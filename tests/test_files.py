"""Indexed FASTA files and binary model files."""

from __future__ import annotations

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixlake.operators import windows
from helixlake.plans import annotate, kernels
from helixlake.sources import fasta_index, model_file
from helixlake.sources.config import Config
from helixlake.sources.fasta import read_fasta

SHIPPED = Config(d_model=64, num_encoder_layers=4, num_heads=4, d_ff=64, cwt_scales=(2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 128.0), window_size=500, window_overlap=100)
TEST = Config(d_model=32, num_encoder_layers=1, num_heads=2, d_ff=64, cwt_scales=(2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 128.0), window_size=200, window_overlap=40)


def indexed(folder, lines_end="\n", width=60):
    """A file of records of several lengths and its index."""
    rng = random.Random(1)
    records = [("chr1", 1000), ("empty", 0), ("chr2 a comment", 60), ("x", 61), ("chr3", 5003)]
    data, index, seqs = b"", [], []
    for name, n in records:
        seq = "".join(rng.choice("ACGTNacgt") for _ in range(n))
        data += f">{name}{lines_end}".encode()
        index.append(f"{name.split()[0]}\t{n}\t{len(data)}\t{width}\t{width + len(lines_end)}")
        for a in range(0, n, width):
            data += (seq[a : a + width] + lines_end).encode()
        seqs.append((name.split()[0], seq))
    path = folder / "x.fa"
    path.write_bytes(data)
    (folder / "x.fa.fai").write_text("\n".join(index) + "\n")
    return str(path), seqs


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_chunks_by_index(spark, tmp_path, end):
    path, seqs = indexed(tmp_path, end)
    for chunk, halo in ((64, 10), (100, 99), (10, 30), (1 << 16, 19)):
        rows = fasta_index.read_fasta_chunks(spark, path, halo, chunk).collect()
        size = max(chunk, halo)
        assert sorted((r.ord, r.id, r.length, r.chunk_start, r.chunk_size, r.chunk) for r in rows) == [
            (k, name, len(s), a, len(s[a : a + size]), s[a : a + size + halo]) for k, (name, s) in enumerate(seqs) for a in range(0, len(s), size)
        ]


def test_windows_by_index_equal_the_plain_scan(spark, tmp_path):
    path, _ = indexed(tmp_path)
    for mode in ("train", "predict"):
        plain = windows.sequence_windows(read_fasta(spark, path), 50, 12, mode, "-")
        by_index = windows.sequence_windows(fasta_index.read_fasta_chunks(spark, path, 49, 128), 50, 12, mode, "-")
        columns = ["ord", "id", "win_idx", "win_start", "win_end", "seq"]
        assert sorted(map(tuple, by_index.select(columns).collect())) == sorted(map(tuple, plain.select(columns).collect()))


def test_predictions_by_index(spark, tmp_path):
    path, seqs = indexed(tmp_path)
    config = Config(d_model=8, num_encoder_layers=1, num_heads=2, d_ff=8, cwt_scales=(2.0,), window_size=50, window_overlap=10)
    params = kernels.initial(8, 1, 8, 1, 3)
    plain = annotate.predictions(read_fasta(spark, path), params, config)
    found = annotate.predictions(fasta_index.read_fasta_chunks(spark, path, 49, 100), params, config)
    key = lambda df: sorted((r.seqid, r.pos, round(r.p0, 9), round(r.p2, 9), r.n) for r in df.collect())
    assert key(found) == key(plain) and len(key(found)) == sum(len(s) for _, s in seqs)


def test_parts_of_records(spark, tmp_path, monkeypatch):
    path, seqs = indexed(tmp_path)
    monkeypatch.setattr(fasta_index, "TASK_BASES", 200)
    reader = fasta_index.IndexedReader({"path": path, "chunk": "100", "ids": '["chr3"]', "first": "1020", "last": "1300"})
    assert [p.value[2:] for p in reader.partitions()] == [(1000, 1200), (1200, 1300)]
    rows = fasta_index.read_fasta_chunks(spark, path, 7, 100, ["chr3"], (1020, 1300)).orderBy("chunk_start").collect()
    assert [(r.chunk_start, r.chunk) for r in rows] == [(a, seqs[4][1][a : a + 107]) for a in (1000, 1100, 1200)]
    assert fasta_index.read_fasta_chunks(spark, path, ids=["none"]).collect() == []
    whole = fasta_index.read_fasta_chunks(spark, path, 0, 100)
    assert whole.where("chunk_start = 0").count() == 4 and whole.count() == 10 + 1 + 1 + 51


def test_an_index_that_does_not_fit(spark, tmp_path):
    path, _ = indexed(tmp_path)
    (tmp_path / "x.fa.fai").write_text("chr1\t1000\t6\t70\t71\n")
    with pytest.raises(Exception, match="doesn't fit its index"):
        fasta_index.read_fasta_chunks(spark, path).collect()


@pytest.mark.parametrize(("config", "size"), [(SHIPPED, 1_063_796), (TEST, 123_060)])
def test_model_files(spark, tmp_path, config, size):
    """Sizes, the bytes, the round trip, and the table of the matrices."""
    params = kernels.initial(config.d_model, config.num_encoder_layers, config.d_ff, 7, 9)
    path = str(tmp_path / "model.bin")
    model_file.write_model_file(spark, params, config, path, "OTHERMK1")
    data = (tmp_path / "model.bin").read_bytes()
    assert len(data) == size and sorted(p.name for p in tmp_path.iterdir()) == ["model.bin"]
    d = config.d_model
    assert data[:8] == b"OTHERMK1" and struct.unpack("<7i", data[8:36]) == (d, config.num_encoder_layers, 0, config.num_heads, config.d_ff, 3, 7)
    assert struct.unpack("<7d", data[36:92]) == config.cwt_scales and struct.unpack("<2i", data[92:100]) == (14, d)
    assert np.array_equal(np.frombuffer(data[100 : 100 + 14 * d * 8]), params["projection"].ravel())
    after = 100 + 14 * d * 8
    assert struct.unpack("<2i", data[after : after + 8]) == (config.window_size, d)
    assert np.array_equal(np.frombuffer(data[-3 * d * 8 :]), params["head"].ravel())
    loaded = model_file.load_model_file(spark, config, path, "OTHERMK1")
    assert list(loaded) == list(params) and all(np.array_equal(loaded[k], params[k]) for k in params)
    table = model_file.read_model_file(spark, path)
    assert table.where("name = 'positions'").select("rows", "cols").collect() == [(config.window_size, d)]
    trained = table.where("name <> 'positions'").agg(F.sum(F.col("rows") * F.col("cols"))).first()[0]
    assert trained == {64: 100_928, 32: 8_960}[d]
    model_file.write_model_file(spark, params, config, path)  # replaces the file
    assert (tmp_path / "model.bin").read_bytes()[:8] == model_file.MARK.encode()


def test_model_files_that_do_not_fit(spark, tmp_path):
    params = kernels.initial(32, 1, 64, 7, 1)
    path = str(tmp_path / "m")
    model_file.write_model_file(spark, params, TEST, path)
    with pytest.raises(ValueError, match="d_model"):
        model_file.load_model_file(spark, SHIPPED, path)
    with pytest.raises(ValueError, match="mark"):
        model_file.load_model_file(spark, TEST, path, "OTHERMK1")
    data = (tmp_path / "m").read_bytes()
    (tmp_path / "m").write_bytes(data[:-8])
    with pytest.raises(Exception, match="its settings ask for"):
        model_file.load_model_file(spark, TEST, path)
    with pytest.raises(Exception, match="hasn't"):
        model_file.write_model_file(spark, params | {"head": np.zeros((2, 2))}, TEST, path)
    assert (tmp_path / "m").read_bytes() == data[:-8]
