"""Levels of recorded sound, and whether what was heard in it is speech."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What silence measures, in decibels of full scale.
FLOOR = -120.0

# What a recogniser writes down for hum and noise.
NOT_SAID = [
    "thank you.", "thank you", "thanks for watching.", "thanks for watching!", "thank you for watching.", "thank you for watching!",
    "subtitles by the amara.org community", "you", ".", "...",
]


def levels(chunks: DataFrame, frame_ms: int = 20, loud: float = -45.0) -> DataFrame:
    """(id, duration_seconds, rms_dbfs, peak_dbfs, speech_frame_ratio) of chunks (id, pcm, rate, channels): ``pcm`` are 16-bit samples, lowest byte first.

    Channels are averaged. The ratio is that of whole frames of ``frame_ms`` that are louder than ``loud``; a chunk shorter than a frame is judged as
    a whole. Null and empty chunks, and a byte too many, give the floor and no seconds. A chunk is decoded as one array.
    """

    def decibels(mean_square):
        return 20 * np.log10(np.sqrt(mean_square + 1e-12))

    def measured(raw: memoryview, rate: int, channels: int) -> tuple[float, float, float, float]:
        x = np.frombuffer(raw[: len(raw) // (2 * channels) * 2 * channels], "<i2").reshape(-1, channels).mean(axis=1) / 32768
        if not len(x):
            return 0.0, FLOOR, FLOOR, 0.0
        rms = max(FLOOR, float(decibels(np.mean(x * x))))
        size = max(1, rate * frame_ms // 1000)
        frames = x[: len(x) // size * size].reshape(-1, size)
        ratio = float(np.mean(decibels(np.mean(frames * frames, axis=1)) > loud)) if len(frames) else float(rms > loud)
        return round(len(x) / rate, 3), round(rms, 2), round(max(FLOOR, float(20 * np.log10(np.abs(x).max() + 1e-12))), 2), round(ratio, 4)

    def run(batches):
        for b in batches:
            rows = [measured(memoryview(p.as_buffer() or b"") if p.is_valid else memoryview(b""), rate or 1, channels or 1) for p, rate, channels in zip(b.column("pcm"), b.column("rate").to_pylist(), b.column("channels").to_pylist(), strict=True)]
            cols = [pa.array([r[k] for r in rows], pa.float64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([b.column("id"), *cols], ["id", "duration_seconds", "rms_dbfs", "peak_dbfs", "speech_frame_ratio"])

    kind = dict(chunks.dtypes)["id"]
    return chunks.select("id", "pcm", "rate", "channels").mapInArrow(run, f"id {kind}, duration_seconds double, rms_dbfs double, peak_dbfs double, speech_frame_ratio double")


def gated(measured: DataFrame, silence: float, least_ratio: float) -> DataFrame:
    """Adds gate_reason: ``acoustic_silence`` where the level is below ``silence`` or the ratio of loud frames below ``least_ratio``, else null."""
    return measured.withColumn("gate_reason", F.when((F.col("rms_dbfs") < silence) | (F.col("speech_frame_ratio") < least_ratio), "acoustic_silence"))


def heard(gated: DataFrame, pieces: DataFrame, most_no_speech: float) -> DataFrame:
    """(id, kind, text, gate_reason): what the recognised pieces (id, ord, text, no_speech, logprob) of each chunk come to.

    A piece is dropped if it is empty, if it is hardly speech (``most_no_speech`` or more, and a log-probability below -1.1), or if it is one
    of ``NOT_SAID`` and doubtful. A chunk that the gate has stopped, or of which nothing is left, is no speech.
    """
    said = F.trim("text")
    doubtful = (F.col("no_speech") > 0.45) | (F.col("logprob") < -1.0)
    dropped = (said == "") | ((F.col("no_speech") >= most_no_speech) & (F.col("logprob") < -1.1)) | (F.lower(said).isin(*NOT_SAID) & doubtful)
    kept = pieces.where(~dropped).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", said.alias("said")))), lambda x: x["said"]), " ").alias("text"))
    j = gated.select("id", "gate_reason").join(kept, "id", "left")
    reason = F.coalesce("gate_reason", F.when(F.col("text").isNull(), "vad_or_nonspeech_filtered"))
    return j.select("id", F.when(reason.isNull(), "speech").otherwise("no_speech").alias("kind"), F.when(reason.isNull(), F.col("text")).otherwise("").alias("text"), reason.alias("gate_reason"))
