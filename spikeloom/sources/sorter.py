"""A Spark data source for a spike sorter's output folder of .npy arrays.

spark.dataSource.register(SorterSource); spark.read.format("sorter").option("table", "spikes").load(folder)
Tables: spikes, templates, channels, pc_features. A partition maps its own range of rows of
each file, so that no task reads more than its share.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMAS = {
    "spikes": "spike_idx long, unit_id long, template_id long, t long, amplitude double",
    "templates": "template_id int, channel int, wf array<double>",
    "channels": "channel int, x_um double, y_um double, hw_channel int",
    "pc_features": "spike_idx long, local_ch int, channel int, pcs array<double>",
    "whitening_inverse": "channel int, to_channel int, weight double",
}


class SorterSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sorter"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "spikes")]

    def reader(self, schema) -> SorterReader:
        return SorterReader(self.options)


class SorterReader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.table = options["path"], options.get("table", "spikes")
        self.rows = int(options.get("rows_per_partition", 1_000_000))

    def _load(self, *names: str):
        for n in names:
            if os.path.exists(p := os.path.join(self.folder, n)):
                return np.load(p, mmap_mode="r")
        return None

    def _length(self) -> int:
        first = {"spikes": "spike_templates.npy", "templates": "templates.npy", "channels": "channel_positions.npy", "pc_features": "pc_features.npy", "whitening_inverse": "whitening_mat_inv.npy"}[self.table]
        found = self._load(first)
        return 0 if found is None else len(found)

    def partitions(self):
        n = self._length()
        step = max(1, self.rows // (1000 if self.table == "templates" else 1))
        return [InputPartition((a, min(a + step, n))) for a in range(0, max(n, 1), step)]

    def read(self, partition):
        a, b = partition.value
        yield from getattr(self, f"_{self.table}")(a, b)

    def _spikes(self, a, b):
        """Corrected times if there are any; curated clusters, else the templates, are the units."""
        templates = np.asarray(self._load("spike_templates.npy")[a:b]).ravel().astype(np.int64)
        units = self._load("spike_clusters.npy")
        units = templates if units is None else np.asarray(units[a:b]).ravel().astype(np.int64)
        t = np.asarray(self._load("spike_times_corrected.npy", "spike_times.npy")[a:b]).ravel().astype(np.int64)
        amp = np.asarray(self._load("amplitudes.npy")[a:b]).ravel().astype(float)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + len(t))), pa.array(units), pa.array(templates), pa.array(t), pa.array(amp)], ["spike_idx", "unit_id", "template_id", "t", "amplitude"])

    def _templates(self, a, b):
        """Unwhitened: each template's (time, channel) matrix times the inverse whitening matrix."""
        w = np.asarray(self._load("templates.npy")[a:b], dtype=float)
        inv = self._load("whitening_mat_inv.npy")
        if inv is not None:
            w = w @ np.asarray(inv, dtype=float)
        for k, m in enumerate(w):
            n = m.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array([a + k] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(m.T.tolist(), pa.list_(pa.float64()))], ["template_id", "channel", "wf"])

    def _channels(self, a, b):
        pos = np.asarray(self._load("channel_positions.npy")[a:b], dtype=float)
        hw = self._load("channel_map.npy")
        hw = np.arange(a, a + len(pos)) if hw is None else np.asarray(hw).ravel()[a:b]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + len(pos), dtype=np.int32)), pa.array(pos[:, 0]), pa.array(pos[:, 1]), pa.array(hw.astype(np.int32))], ["channel", "x_um", "y_um", "hw_channel"])

    def _pc_features(self, a, b):
        feats = self._load("pc_features.npy")
        if feats is None:
            return
        f = np.asarray(feats[a:b], dtype=float)
        ind = np.asarray(self._load("pc_feature_ind.npy"))
        t = np.asarray(self._load("spike_templates.npy")[a:b]).ravel().astype(int)
        local = f.shape[2]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(a, a + len(f)), local)), pa.array(np.tile(np.arange(local, dtype=np.int32), len(f))), pa.array(ind[t].astype(np.int32).ravel()), pa.array(f.transpose(0, 2, 1).reshape(-1, f.shape[1]).tolist(), pa.list_(pa.float64()))],
            ["spike_idx", "local_ch", "channel", "pcs"])

    def _whitening_inverse(self, a, b):
        inv = self._load("whitening_mat_inv.npy")
        if inv is not None:
            m = np.asarray(inv[a:b], dtype=float)
            rows, cols = np.indices(m.shape)
            yield pa.RecordBatch.from_arrays([pa.array((rows + a).ravel().astype(np.int32)), pa.array(cols.ravel().astype(np.int32)), pa.array(m.ravel())], ["channel", "to_channel", "weight"])
