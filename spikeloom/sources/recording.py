"""Recording metadata, raw int16 samples and compressed recordings.

Metadata files are small key=value or JSON texts, parsed on the driver. Raw samples are read
by byte range: a task opens the file it was given and reads only its spikes' snippets.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Probe types of the second generation, whose gain is 80, or 100 for the commercial variant.
GEN2_TYPES, GEN2_100_TYPES = ("21", "24", "2003", "2004", "2020", "2021"), ("2013", "2014")
OPEN_EPHYS_BIT_UV = 0.1949999928474426


def open_file(path: str):
    """A seekable binary file of a local path or of a URI that pyarrow knows (hdfs, s3, gs, file)."""
    if "://" not in path:
        return open(path, "rb")
    from pyarrow import fs

    where, inner = fs.FileSystem.from_uri(path)
    return where.open_input_file(inner)


def channels_of_file(size: int, n_channels: int, n_neural: int | None = None) -> int:
    """The channel count that a file of `size` bytes of int16 can have: the metadata's, else that without the auxiliary channels."""
    for n in (n_channels, n_neural):
        if n and size % (2 * n) == 0:
            return n
    raise ValueError(f"{size} bytes are no whole number of samples of {n_channels} channels")


def parse_meta(text: str) -> dict[str, str]:
    """key=value lines; a leading ~ of a key goes; lines without = are skipped."""
    pairs = (line.split("=", 1) for line in text.splitlines() if "=" in line)
    return {k.strip().lstrip("~"): v.strip() for k, v in pairs}


def parse_oebin(text: str) -> dict:
    """Sampling rate, channel count and bit volts of the AP stream (else the first); neural channels are named CH..."""
    streams = json.loads(text).get("continuous", [])
    if not streams:
        return {}
    ap = next((s for s in streams if "AP" in s.get("folder_name", "") + s.get("stream_name", "")), streams[0])
    channels = ap.get("channels", [])
    neural = [c for c in channels if c.get("channel_name", "").startswith("CH")] or channels
    return {"sample_rate": ap["sample_rate"], "n_channels": ap.get("num_channels", len(channels)), "n_neural": len(neural), "bit_uv": neural[0].get("bit_volts", OPEN_EPHYS_BIT_UV) if neural else OPEN_EPHYS_BIT_UV}


def sync_channels(meta: dict[str, str]) -> int:
    """The third number of snsApLfSy (or acqApLfSy)."""
    text = meta.get("snsApLfSy") or meta.get("acqApLfSy") or "0,0,0"
    return int(text.split(",")[2])


def microvolts_per_bit(meta: dict[str, str], channel: int = 0, newer_default: int = 2048) -> float:
    """range * 1e6 / steps / gain: first-generation probes have 512 steps and their table's gain, later ones more steps and 80 or 100."""
    kind = meta.get("imDatPrb_type", "0")
    newer = kind in GEN2_TYPES + GEN2_100_TYPES
    steps = float(meta.get("imMaxInt", newer_default if newer else 512))
    gain = 100.0 if kind in GEN2_100_TYPES else 80.0 if newer else float(meta.get("imChan0apGain") or channel_gains(meta).get(channel, (500.0, 250.0))[0])
    return float(meta["imAiRangeMax"]) * 1e6 / steps / gain


def channel_gains(meta: dict[str, str]) -> dict[int, tuple[float, float]]:
    """channel -> (AP gain, LF gain) from the imro table; types with one gain repeat it, type 1110 has its gains in the table's header."""
    kind, out = meta.get("imDatPrb_type", "0"), {}
    header, *entries = meta.get("imroTbl", "").strip("()").split(")(")
    if kind == "1110":
        shared = (float(meta["imChan0apGain"]), float(meta["imChan0lfGain"])) if "imChan0apGain" in meta else tuple(float(x) for x in header.split(",")[3:5])
    else:
        shared = None
    for entry in entries:
        parts = entry.split()
        if kind in GEN2_TYPES + GEN2_100_TYPES:
            g = 100.0 if kind in GEN2_100_TYPES else 80.0
            out[int(parts[0])] = (g, g)
        else:
            out[int(parts[0])] = shared or (float(parts[3]), float(parts[4]))
    return out


def gain_corrected(samples: np.ndarray, saved: list[int], meta: dict[str, str]) -> np.ndarray:
    """(samples, channels) in volts of the saved channels given by their place in the file; sync and digital channels stay as they are."""
    volts, kind = volts_per_bit(meta), meta["typeThis"]
    out = samples.astype(float)
    if kind == "nidq":
        analog = sum(channel_counts(meta)[:3])
        scale = [volts / ni_gain(meta, i) if i < analog else 1.0 for i in saved]
    elif kind == "obx":
        scale = [volts] * len(saved)
    else:
        ap, lf = (int(x) for x in meta.get("acqApLfSy", meta.get("snsApLfSy")).split(",")[:2])
        gains, acquired = channel_gains(meta), saved_channels(meta)
        place = [acquired[i] for i in saved]
        scale = [volts / gains[k][0] if k < ap else volts / gains[k - ap][1] if k < ap + lf else 1.0 for k in place]
    return out * np.array(scale)


def sample_rate(meta: dict[str, str]) -> float:
    """By the stream's type: imec, nidq or obx."""
    return float(meta[{"imec": "imSampRate", "nidq": "niSampRate", "obx": "obSampRate"}[meta["typeThis"]]])


def volts_per_bit(meta: dict[str, str]) -> float:
    kind = meta["typeThis"]
    if kind == "imec":
        return float(meta["imAiRangeMax"]) / float(meta.get("imMaxInt", 512))
    if kind == "nidq":
        return float(meta["niAiRangeMax"]) / float(meta.get("niMaxInt", 32768))
    return float(meta["obAiRangeMax"]) / float(meta["obMaxInt"])


def saved_channels(meta: dict[str, str]) -> list[int]:
    """Original ids of the saved channels: all, or the listed ids and a:b ranges."""
    text = meta.get("snsSaveChanSubset", "all")
    if text == "all":
        return list(range(int(meta["nSavedChans"])))
    out: list[int] = []
    for part in text.split(","):
        a, _, b = part.partition(":")
        out += range(int(a), int(b or a) + 1)
    return out


def channel_counts(meta: dict[str, str]) -> tuple[int, ...]:
    """AP, LF, SY of an imec stream; MN, MA, XA, DW of nidq; XA, DW, SY of obx."""
    key = {"imec": "snsApLfSy", "nidq": "snsMnMaXaDw", "obx": "snsXaDwSy"}[meta["typeThis"]]
    return tuple(int(x) for x in meta[key].split(","))


def ni_gain(meta: dict[str, str], index: int) -> float:
    """Gain of a saved nidq channel by its class: MN, MA, else 1."""
    mn, ma, *_ = channel_counts(meta)
    return float(meta.get("niMNGain", 1)) if index < mn else float(meta.get("niMAGain", 1)) if index < mn + ma else 1.0


def digital_lines(words: np.ndarray, lines: Iterable[int]) -> np.ndarray:
    """Rows of 0/1, one a line, of digital words."""
    w = words.astype(np.uint16)
    return np.stack([(w >> np.uint16(i)) & np.uint16(1) for i in lines]).astype(np.uint8)


def bank_times(meta: dict[str, str]) -> list[tuple[int, int, float, float]]:
    """(shank, bank, start, end) entries of a survey recording's table."""
    out = []
    for e in meta.get("svySBTT", "").strip("()").split(")("):
        if e.strip():
            a, b, c, d = e.replace(",", " ").split()[:4]
            out.append((int(a), int(b), float(c), float(d)))
    return out


def render_meta(meta: dict[str, str]) -> str:
    return "".join(f"{'~' if k in ('imroTbl', 'snsChanMap', 'snsShankMap', 'snsGeomMap', 'muxTbl') else ''}{k}={v}\n" for k, v in meta.items())


def parse_file_name(name: str) -> dict[str, str]:
    """run, gate, trigger and stream of run_g0_t0.imec0.ap.bin."""
    stem, *rest = os.path.basename(name).split(".")
    run, _, trigger = stem.rpartition("_t")
    run, _, gate = run.rpartition("_g")
    return {"run": run, "gate": gate, "trigger": trigger, "stream": ".".join(rest[:-1])}


def read_samples(path: str, n_channels: int, start: int, count: int) -> np.ndarray:
    """(samples, channels) of a row-major int16 file, read by byte range."""
    with open_file(path) as f:
        f.seek(2 * n_channels * start)
        raw = f.read(2 * n_channels * count)
    return np.frombuffer(raw, "<i2")[: len(raw) // 2 // n_channels * n_channels].reshape(-1, n_channels)


def usable(spikes: DataFrame, n_samples: int, width: int) -> DataFrame:
    """Spikes whose whole snippet lies within the recording: half < t < n - width + half."""
    half = width // 2
    return spikes.filter((F.col("t") > half) & (F.col("t") < n_samples - width + half))


def raw_snippets(spikes: DataFrame, path: str, n_channels: int, width: int, channels: list[int] | None = None) -> DataFrame:
    """(unit_id, spike_idx, channel, wf) snippets centred half a width into the window.

    spikes: at most a few hundred a unit (see sampled_spikes). Each batch reads its own byte
    ranges of a file that all executors can open; the recording is never loaded or exploded.
    """
    keep = list(range(n_channels)) if channels is None else channels
    half = width // 2

    def run(batches):
        for b in batches:
            units, idx, ch, wf = [], [], [], []
            for u, i, t in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                snippet = read_samples(path, n_channels, t - half, width)
                for c in keep:
                    units.append(u)
                    idx.append(i)
                    ch.append(c)
                    wf.append(snippet[:, c].astype(float).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(units, pa.int64()), pa.array(idx, pa.int64()), pa.array(ch, pa.int32()), pa.array(wf, pa.list_(pa.float64()))], ["unit_id", "spike_idx", "channel", "wf"])

    x = spikes.select(F.col("unit_id").cast("long"), F.col("spike_idx").cast("long"), F.col("t").cast("long"))
    return x.mapInArrow(run, "unit_id long, spike_idx long, channel int, wf array<double>")


def chunk_table(spark, header: dict) -> DataFrame:
    """(chunk, first_sample, last_sample, offset, size) of a compressed recording's JSON header."""
    b, o = header["chunk_bounds"], header["chunk_offsets"]
    return spark.createDataFrame([(i, b[i], b[i + 1], o[i], o[i + 1] - o[i]) for i in range(len(b) - 1)], "chunk int, first_sample long, last_sample long, offset long, size long")


def decode_chunk(raw: bytes, n_channels: int, time_delta: bool = True) -> np.ndarray:
    """(samples, channels): inflate, channel-major reshape, and the running sum over time per channel."""
    flat = np.frombuffer(zlib.decompress(raw), "<i2")
    x = flat.reshape(n_channels, -1).T
    return np.cumsum(x, axis=0, dtype=np.int64).astype(np.int16) if time_delta else x


def encode_chunk(x: np.ndarray, time_delta: bool = True) -> bytes:
    d = np.diff(x.astype(np.int16), axis=0, prepend=np.zeros((1, x.shape[1]), np.int16)) if time_delta else x
    return zlib.compress(np.ascontiguousarray(d.T.astype("<i2")).tobytes(), 1)


def decompressed(chunks: DataFrame, path: str, n_channels: int, channels: list[int] | None = None, start: int = 0, stop: int | None = None) -> DataFrame:
    """(chunk, channel, first_sample, samples): one task inflates one chunk after another.

    A subset of channels, such as sync alone, may be kept, and the samples from start to stop
    (exclusive): other chunks aren't read, and the outer ones are trimmed.
    """
    chunks = chunks.filter(F.col("last_sample") > start)
    chunks = chunks if stop is None else chunks.filter(F.col("first_sample") < stop)
    keep = list(range(n_channels)) if channels is None else channels

    def run(batches):
        for b in batches:
            for c, first, off, size in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                with open_file(path) as f:
                    f.seek(off)
                    x = decode_chunk(f.read(size), n_channels)
                skip = max(start - first, 0)
                x, first = x[skip : None if stop is None else stop - first], first + skip
                n = len(keep)
                yield pa.RecordBatch.from_arrays([pa.array([c] * n, pa.int32()), pa.array(keep, pa.int32()), pa.array([first] * n, pa.int64()), pa.array([x[:, k].tolist() for k in keep], pa.list_(pa.int16()))], ["chunk", "channel", "first_sample", "samples"])

    return chunks.select("chunk", "first_sample", "offset", "size").mapInArrow(run, "chunk int, channel int, first_sample long, samples array<smallint>")


def decompress_to_file(header: dict, path: str, target: str, n_channels: int) -> int:
    """Writes the whole recording as row-major int16 beside the compressed one, a chunk in memory at a time; the number of samples."""
    offsets, n = header["chunk_offsets"], 0
    with open_file(path) as source, open(target, "wb") as out:
        for a, b in zip(offsets, offsets[1:], strict=False):
            source.seek(a)
            x = decode_chunk(source.read(b - a), n_channels)
            out.write(np.ascontiguousarray(x, "<i2").tobytes())
            n += len(x)
    return n


def find_recording(names: Iterable[str]) -> str | None:
    """An already decompressed file, else a .bin that isn't .lf, else a .cbin."""
    names = sorted(names)
    for test in (lambda n: n.endswith("_bc_decompressed.bin"), lambda n: n.endswith(".bin") and ".lf." not in n, lambda n: n.endswith(".cbin")):
        if found := next(filter(test, names), None):
            return found
    return None


#: Sites of probe kinds: columns' x of each row in turn, row pitch, sites of a shank, shanks and their distance.
PROBES = {
    "np1": (((43.0, 11.0), (59.0, 27.0)), 20.0, 384, 1, 0.0),
    "np2": (((0.0, 32.0),), 15.0, 384, 1, 0.0),
    "np2_four_shank": (((0.0, 32.0),), 15.0, 96, 4, 250.0),
}


def probe_layout(spark, n: int = 384, columns: int = 2, pitch_x: float = 32.0, pitch_y: float = 15.0) -> DataFrame:
    """(channel, x_um, y_um, hw_channel) of a regular probe, by modular arithmetic."""
    i = F.col("id")
    return spark.range(n).select(i.cast("int").alias("channel"), ((i % columns) * pitch_x).alias("x_um"), (F.floor(i / columns) * pitch_y).cast("double").alias("y_um"), i.cast("int").alias("hw_channel"))


def named_probe(spark, kind: str) -> DataFrame:
    """(channel, shank, x_um, y_um, hw_channel) of a probe kind, row by row from the tip."""
    rows, pitch, per_shank, shanks, apart = PROBES[kind]
    i, columns = F.col("id"), len(rows[0])
    on = i % per_shank
    xs = F.array(*[F.lit(x) for row in rows for x in row])
    x = F.get(xs, (on % (columns * len(rows))).cast("int"))
    shank = F.floor(i / per_shank)
    return spark.range(per_shank * shanks).select(
        i.cast("int").alias("channel"), shank.cast("int").alias("shank"), (x + shank * apart).alias("x_um"), (F.floor(on / columns) * pitch).cast("double").alias("y_um"), i.cast("int").alias("hw_channel"))


def by_site(values: DataFrame, channels: DataFrame, column: str = "channel") -> DataFrame:
    """values keyed by the recording's hardware channel, keyed by the sorter's site instead; channels without a site are dropped."""
    sites = channels.select(F.col("hw_channel").alias("__hw"), F.col("channel").alias("__site"))
    x = values.join(sites, F.col(column) == F.col("__hw"))
    return x.select(*[F.col("__site").alias(column) if c == column else F.col(c) for c in values.columns])


def by_hardware(values: DataFrame, channels: DataFrame, column: str = "channel") -> DataFrame:
    """The inverse of `by_site`."""
    return by_site(values, channels.select(F.col("channel").alias("hw_channel"), F.col("hw_channel").alias("channel")), column)
