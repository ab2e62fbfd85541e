"""Files that arrive are predicted as they would be in one go."""

from __future__ import annotations

import random

from helixlake.operators.segments import segments
from helixlake.plans import annotate, kernels
from helixlake.sources.config import Config
from helixlake.sources.fasta import read_fasta
from helixlake.streaming.predict import predict_stream

SMALL = Config(d_model=8, num_encoder_layers=1, num_heads=2, d_ff=6, cwt_scales=(2.0, 3.0), window_size=30, window_overlap=6)


def test_stream_equals_batch(spark, tmp_path):
    rng, folder = random.Random(1), tmp_path / "in"
    folder.mkdir()
    params = kernels.initial(8, 1, 6, 2, 5)
    for k in range(3):
        (folder / f"{k}.fa").write_text("".join(f">s{k}{j}\n{''.join(rng.choice('ACGT') for _ in range(40 + 13 * j))}\n" for j in range(2)))
        if k != 1:
            predict_stream(spark, str(folder), params, SMALL, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    streamed = spark.read.parquet(str(tmp_path / "out"))
    whole = segments(annotate.predictions(read_fasta(spark, f"{folder}/*.fa"), params, SMALL))
    columns = [c for c in whole.columns if c != "ord"]  # records are numbered by batch
    assert sorted(map(tuple, streamed.select(columns).collect())) == sorted(map(tuple, whole.select(columns).collect()))
    assert streamed.select("batch", "ord").distinct().count() == 6
    assert len(list((tmp_path / "out").glob("batch=*"))) == 2
