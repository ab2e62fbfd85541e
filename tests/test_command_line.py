"""The command line, in the process, over a small made genome."""

from __future__ import annotations

import random

from helixlake.__main__ import main

CONFIG = """
[model]
d_model = 8
num_heads = 2
num_encoder_layers = 1
d_ff = 8
[training]
num_epochs = 1
batch_size = 50
dropout_rate = 0.0
[cwt]
scales = [2.0, 4.0]
[sliding_window]
window_size = 200
window_overlap = 40
[paths]
"""


def test_verbs(spark, tmp_path, capsys):
    rng = random.Random(2)
    (tmp_path / "g.fa").write_text(">chr\n" + "\n".join("".join(rng.choice("ACGT") for _ in range(60)) for _ in range(84)) + "\n")
    (tmp_path / "g.gff").write_text("##gff-version 3\nchr\tx\tCDS\t101\t900\t.\t+\t0\tParent=t\n")
    paths = {"train_fasta": "g.fa", "train_gff": "g.gff", "predict_fasta": "g.fa", "model_path": "m", "output_gff": "o.gff", "output_bedgraph": "o.bed"}
    config = tmp_path / "run.toml"
    config.write_text(CONFIG + "".join(f'{k} = "{tmp_path / v}"\n' for k, v in paths.items()))
    assert main(["train", "-c", str(config)]) == 0
    assert "epoch 1: loss" in capsys.readouterr().out
    assert main(["predict", "-c", str(config)]) == 0
    assert spark.read.text(str(tmp_path / "o.bed")).count() == 84 * 60
    assert spark.read.text(str(tmp_path / "o.gff")).where("value = '##gff-version 3'").count() == 1


def test_exit_codes(tmp_path, capsys):
    for args in ([], ["help"], ["--help"], ["train"]):
        assert main(args) == 0
        assert "usage" in capsys.readouterr().err
    (tmp_path / "odd.toml").write_text("[model]\nd_model = 9\nnum_heads = 2\n")
    (tmp_path / "bare.toml").write_text("[model]\nd_model = 8\nnum_heads = 2\n")
    for args in (["unknown"], ["train", "-c", str(tmp_path / "none.toml")], ["train", "-c", str(tmp_path / "odd.toml")], ["predict", "-c", str(tmp_path / "bare.toml")]):
        assert main(args) == 1
        assert "Error" in capsys.readouterr().err
