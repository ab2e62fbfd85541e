"""FASTA, GFF3, TOML and model files."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixlake.functions.attributes import attribute, parents
from helixlake.sources import gff, model
from helixlake.sources.config import Config, parse_config, require
from helixlake.sources.fasta import parse_fasta, read_fasta


def test_fasta_edges(spark):
    text = "before\n>a one\r\nACGT\r\nac gt \r\n>\nNN\n>empty\n>a\nA\n\nC>G\n>>odd\nT"
    rows = parse_fasta(spark.createDataFrame([(text,)], "value string")).orderBy("ord").collect()
    assert [(r.ord, r.id, r.seq, r.length) for r in rows] == [(0, "a", "ACGTac gt ", 10), (1, "", "NN", 2), (2, "empty", "", 0), (3, "a", "AC>G", 4), (4, ">odd", "T", 1)]
    stripped = parse_fasta(spark.createDataFrame([(text,)], "value string"), strip_whitespace=True).orderBy("ord").first()
    assert stripped.seq == "ACGTacgt"


def test_fasta_file(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">s1\nAC\nGT\n>s2\nTT")
    rows = read_fasta(spark, str(tmp_path / "x.fa")).orderBy("ord").collect()
    assert [(r.id, r.seq) for r in rows] == [("s1", "ACGT"), ("s2", "TT")]


def test_fasta_files_of_one_id(spark, tmp_path):
    """Records of several files keep apart; split files give the same records."""
    (tmp_path / "a.fa").write_text("junk\n>c\nACGT\n>d\n" + "ACGTT\n" * 3000 + ">c\nTT\n")
    (tmp_path / "b.fa").write_text(">c x\r\nGG\r\nA\r\n>>odd\nT")
    (tmp_path / "c.fa").write_text("no record\nat all")
    (tmp_path / "d.fa").write_text("\n>e\nA")
    expected = [(0, "c", 4), (1, "d", 15_000), (2, "c", 2), (3, "c", 3), (4, ">odd", 1), (5, "e", 1)]
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (kept, "1000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = read_fasta(spark, str(tmp_path / "*.fa")).orderBy("ord").collect()
            assert [(r.ord, r.id, r.length) for r in rows] == expected
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    whole = spark.read.text(str(tmp_path / "*.fa"), wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    assert [(r.ord, r.id, r.length) for r in parse_fasta(whole).orderBy("ord").collect()] == expected


def test_gff_edges(spark):
    lines = [
        "##gff-version 3",
        "",
        "c\tsrc\tCDS\t3\t9\t.\t+\t0\t ID=x; Parent=t \r",
        "c\tsrc\texon\tjunk\t-5x\t.\t-\t.",
        "c\tsrc\texon\t1\t2\t.\t?\t.\tID=y\textra",
        "too\tfew\tcolumns\t1\t2\t.\t+",
    ]
    rows = gff.parse_gff(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [tuple(r) for r in rows] == [
        ("c", "src", "CDS", 3, 9, "+", "ID=x; Parent=t"),
        ("c", "src", "exon", 0, -5, "-", ""),
        ("c", "src", "exon", 1, 2, "?", "ID=y"),
    ]


@pytest.mark.parametrize(
    ("text", "parent", "owners"),
    [
        ("ID=a;Parent=b", "b", ["b"]),
        ("ID=a", None, ["a"]),
        ("ID=a;Parent=", "", []),
        ('Parent="p q" ; ID=a', "p q", ["p q"]),
        ("XParent=no;ID= a ", None, ["a"]),
        ("Parent= a, b,,c%20 ;Parent=later", "a, b,,c%20", ["a", "b", "c%20"]),
        ("note=x", None, None),
    ],
)
def test_attributes(spark, text, parent, owners):
    row = spark.createDataFrame([(text,)], "a string").select(attribute(F.col("a"), "Parent").alias("p"), parents(F.col("a")).alias("o")).first()
    assert (row.p, row.o) == (parent, owners)


def test_config():
    found = parse_config(
        '[model]\nd_model = 8\nnum_heads = 2\nd_ff = "wrong"\n[training]\nadam_beta1 = 0.5\n[adam]\nbeta1 = 0.7\nlearning_rate = 1\n'
        '[cwt]\nscales = [3, "x", 2.5]\n[sliding_window]\nwindow_size = 50\n[paths]\nmodel_path = "m"\n'
    )
    assert (found.d_model, found.num_heads, found.d_ff, found.adam_beta1, found.adam_learning_rate) == (8, 2, 2048, 0.7, 1.0)
    assert found.cwt_scales == (3.0, 4.0, 2.5)
    assert (found.window_size, found.window_overlap, found.model_path) == (50, 1000, "m")
    assert parse_config("[cwt]\nscales = []").cwt_scales == Config().cwt_scales
    with pytest.raises(ValueError, match="divisor"):
        parse_config("[model]\nd_model = 9\nnum_heads = 2")
    with pytest.raises(ValueError, match="output_gff"):
        require(found, "predict")


def test_model_round_trip(spark, tmp_path):
    config = Config(d_model=8, num_encoder_layers=2, num_heads=2, d_ff=4, cwt_scales=(2.0, 4.0))
    params = model.new_model(config, 3)
    model.save_model(spark, params, config, str(tmp_path / "m"))
    again = model.load_model(spark, config, str(tmp_path / "m"))
    assert list(again) == list(params)
    assert all(np.array_equal(again[k], params[k]) for k in params)
    with pytest.raises(ValueError, match="d_ff"):
        model.load_model(spark, Config(d_model=8, num_encoder_layers=2, num_heads=2, d_ff=5, cwt_scales=(2.0, 4.0)), str(tmp_path / "m"))


@pytest.mark.parametrize(("settings", "count"), [((64, 4, 4, 64, 7), 100_928), ((32, 1, 2, 64, 7), 8_960), ((512, 6, 8, 2048, 5), 18_908_672)])
def test_parameter_count(settings, count):
    d, layers, heads, ff, scales = settings
    config = Config(d_model=d, num_encoder_layers=layers, num_heads=heads, d_ff=ff, cwt_scales=tuple(map(float, range(1, scales + 1))))
    assert sum(n * m for _, n, m in model.shapes(config)) == count


def test_gff_sink(spark, tmp_path):
    cut = spark.createDataFrame([("b", 1, 1, 4, 2), ("a", 0, 5, 9, 1), ("a", 0, 1, 4, 0)], "seqid string, ord int, start int, end int, label int")
    gff.write_gff(cut, str(tmp_path / "g"))
    text = [x.value for x in spark.read.text(str(tmp_path / "g")).collect()]
    assert text == ["##gff-version 3", "a\thelixlake\tintron\t5\t9\t.\t+\t.\tID=pred_0", "b\thelixlake\texon\t1\t4\t.\t+\t.\tID=pred_1"]


@pytest.mark.parametrize("p", [0.03125, 0.00015, 0.5, 0.0, 1.0, 0.99995, 0.12345, 1 / 3, 0.00005])
def test_bedgraph_rounds_as_c(spark, p):
    row = gff.bedgraph_lines(spark.createDataFrame([("s", 0, 7, p)], "seqid string, ord int, pos int, p2 double")).first()
    assert row.value == f"s\t7\t8\t{p:.4f}"
