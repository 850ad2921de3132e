"""Levels of sound and the gates behind them."""

import numpy as np

from recordlens.operators import acoustics

RATE = 16_000


def pcm(x):
    return np.asarray(x).round().astype("<i2").tobytes()


def test_levels_and_gates(spark):
    t = np.arange(6 * RATE) / RATE
    speech = np.where((t * 2).astype(int) % 2 == 0, 9000, 0) * np.sin(2 * np.pi * 220 * t)
    stereo = np.stack([speech, -speech], axis=1).reshape(-1)
    rows = [
        (1, pcm(0 * t), RATE, 1), (2, pcm(40 * np.sin(2 * np.pi * 60 * t)), RATE, 1), (3, pcm(speech), RATE, 1), (4, pcm(stereo), RATE, 2),
        (5, b"", RATE, 1), (6, None, RATE, 1), (7, pcm(9000 * np.ones(50)) + b"x", RATE, 1),
    ]
    got = acoustics.levels(spark.createDataFrame([tuple(bytearray(v) if isinstance(v, bytes) else v for v in r) for r in rows], "id int, pcm binary, rate int, channels int"))
    by_id = {r.id: (r.duration_seconds, r.rms_dbfs, r.peak_dbfs, r.speech_frame_ratio) for r in got.collect()}
    assert by_id[1] == (6.0, -120.0, -120.0, 0.0) and by_id[4] == by_id[1]
    assert by_id[2][1:] == (-61.27, -58.27, 0.0)
    assert by_id[3][0] == 6.0 and by_id[3][3] == 0.5 and -20 < by_id[3][1] < -10
    assert by_id[5] == by_id[6] == (0.0, -120.0, -120.0, 0.0) and by_id[7] == (0.003, -11.22, -11.22, 1.0)
    pieces = [(1, 0, "Thank you.", 0.1, -0.2), (3, 1, "go.", 0.1, -0.2), (3, 0, " Units ", 0.1, -0.2), (3, 2, "you", 0.5, -0.2), (3, 3, "hum", 0.9, -1.2), (7, 0, "...", 0.9, -2.0)]
    heard = acoustics.heard(acoustics.gated(got, -52.0, 0.03), spark.createDataFrame(pieces, "id int, ord int, text string, no_speech double, logprob double"), 0.6)
    assert {r.id: (r.kind, r.text, r.gate_reason) for r in heard.collect()} == {
        **{k: ("no_speech", "", "acoustic_silence") for k in (1, 2, 4, 5, 6)}, 3: ("speech", "Units go.", None), 7: ("no_speech", "", "vad_or_nonspeech_filtered"),
    }
    assert acoustics.levels(spark.createDataFrame([], "id int, pcm binary, rate int, channels int")).count() == 0
