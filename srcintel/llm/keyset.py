"""Sets of 64-bit keys as sorted files in the shared folder, which workers map to filter rows without a shuffle."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcintel.llm.shared import fresh, ship, tasks
from srcintel.llm.text import U

#: Keys that a task holds, and a file has, about.
EACH = 1 << 20


def write(keys: DataFrame) -> str:
    """The folder of the files; keys: key long, a table or cheap to compute. As many files, by the keys' upper bits, as their number needs."""
    spark = keys.sparkSession
    ship(spark)
    to = fresh(spark, "keys")
    bits = min(30, max(0, (keys.count() // EACH).bit_length()))
    with open(f"{to}/bits", "w") as f:
        f.write(str(bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def save(part: int, held: list[np.ndarray]) -> None:
            name = f"{to}/{part}.{uuid.uuid4().hex}"
            with open(name, "wb") as f:
                np.save(f, np.unique(np.concatenate(held).view(U)))
            os.replace(name, f"{to}/{part}.npy")

        at, held = None, []
        for b in batches:
            parts, key = b.column("part").to_numpy(), b.column("key").to_numpy()
            cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo and parts[lo] != at:
                    if held:
                        save(at, held)
                    at, held = int(parts[lo]), []
                held.append(key[lo:hi])
        if held:
            save(at, held)
            yield pa.RecordBatch.from_pydict({"part": pa.array([at], pa.int32())})

    part = (F.shiftrightunsigned("key", 64 - bits).cast("int") if bits else F.lit(0)).alias("part")
    n = min(1 << bits, tasks(spark))
    keys.select(part, "key").distinct().repartition(n, "part").sortWithinPartitions("part").mapInArrow(run, "part int").count()
    return to


class KeySet:
    def __init__(self, folder: str):
        self.folder = folder
        with open(f"{folder}/bits") as f:
            self.bits = int(f.read())
        self.maps: dict[int, np.ndarray | None] = {}

    def _map(self, part: int) -> np.ndarray | None:
        if part not in self.maps:
            path = f"{self.folder}/{part}.npy"
            self.maps[part] = np.load(path, mmap_mode="r") if os.path.exists(path) else None
        return self.maps[part]

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """keys: unsigned, in any order."""
        out = np.zeros(len(keys), bool)
        order = np.argsort(keys)
        ascending = keys[order]
        part = ascending >> U(64 - self.bits) if self.bits else np.zeros(len(keys), U)
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a and (known := self._map(int(part[a]))) is not None:
                at = np.minimum(np.searchsorted(known, ascending[a:b]), len(known) - 1)
                out[order[a:b]] = known[at] == ascending[a:b]
        return out
