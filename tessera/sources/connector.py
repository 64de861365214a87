"""Connectors as Python data sources: ``spark.read.format(name)`` and ``df.write.format(name)``.

``tessera_generated`` makes benchmark tables from their published formulas, ``scale`` times the unit
size, each partition by itself; ``tessera_callback`` hands each partition's batches to a function.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

# workers need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Regions and nations (name, region) of the benchmark: fixed values.
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
NATIONS = (
    ("ALGERIA", 0), ("ARGENTINA", 1), ("BRAZIL", 1), ("CANADA", 1), ("EGYPT", 4), ("ETHIOPIA", 0), ("FRANCE", 3), ("GERMANY", 3), ("INDIA", 2), ("INDONESIA", 2), ("IRAN", 4), ("IRAQ", 4), ("JAPAN", 2),
    ("JORDAN", 4), ("KENYA", 0), ("MOROCCO", 0), ("MOZAMBIQUE", 0), ("PERU", 1), ("CHINA", 2), ("ROMANIA", 3), ("SAUDI ARABIA", 4), ("VIETNAM", 2), ("RUSSIA", 3), ("UNITED KINGDOM", 3), ("UNITED STATES", 1),
)


def _region(k: np.ndarray, scale: float) -> dict:
    return {"r_regionkey": k, "r_name": [REGIONS[i] for i in k.tolist()]}


def _nation(k: np.ndarray, scale: float) -> dict:
    return {"n_nationkey": k, "n_name": [NATIONS[i][0] for i in k.tolist()], "n_regionkey": np.array([NATIONS[i][1] for i in k.tolist()], np.int64)}


def _part(k: np.ndarray, scale: float) -> dict:
    k = k + 1
    return {"p_partkey": k, "p_retailprice": (90_000 + k // 10 % 20_001 + 100 * (k % 1_000)) / 100}


def _partsupp(k: np.ndarray, scale: float) -> dict:
    """Four suppliers of each part."""
    part, i, suppliers = k // 4 + 1, k % 4, int(10_000 * scale)
    return {"ps_partkey": part, "ps_suppkey": (part + i * (suppliers // 4 + (part - 1) // suppliers)) % suppliers + 1}


def _supplier(k: np.ndarray, scale: float) -> dict:
    k = k + 1
    return {"s_suppkey": k, "s_name": [f"Supplier#{i:09d}" for i in k.tolist()]}


def _customer(k: np.ndarray, scale: float) -> dict:
    k = k + 1
    return {"c_custkey": k, "c_name": [f"Customer#{i:09d}" for i in k.tolist()]}


def _orders(k: np.ndarray, scale: float) -> dict:
    """Keys use the first 8 of each 32."""
    return {"o_orderkey": k // 8 * 32 + k % 8 + 1}


#: table: (rows at scale 1, grows with the scale, columns, maker)
TABLES: dict[str, tuple[int, bool, str, Callable[[np.ndarray, float], dict]]] = {
    "region": (5, False, "r_regionkey long, r_name string", _region),
    "nation": (25, False, "n_nationkey long, n_name string, n_regionkey long", _nation),
    "part": (200_000, True, "p_partkey long, p_retailprice double", _part),
    "partsupp": (800_000, True, "ps_partkey long, ps_suppkey long", _partsupp),
    "supplier": (10_000, True, "s_suppkey long, s_name string", _supplier),
    "customer": (150_000, True, "c_custkey long, c_name string", _customer),
    "orders": (1_500_000, True, "o_orderkey long", _orders),
}


@dataclass
class Rows(InputPartition):
    first: int
    last: int


class GeneratedTables(DataSource):
    """Options: table, scale (1), rows of a partition (1,000,000)."""

    @classmethod
    def name(cls) -> str:
        return "tessera_generated"

    def schema(self) -> str:
        return TABLES[self.options["table"]][2]

    def reader(self, schema) -> DataSourceReader:
        return GeneratedReader(dict(self.options))


class GeneratedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.table, self.scale, self.rows = options["table"], float(options.get("scale", 1)), int(options.get("rows", 1_000_000))

    def partitions(self) -> list[Rows]:
        unit, grows, _, _ = TABLES[self.table]
        n = int(unit * self.scale) if grows else unit
        return [Rows(k, min(n, k + self.rows)) for k in range(0, n, self.rows)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        for k in range(partition.first, partition.last, 50_000):
            made = TABLES[self.table][3](np.arange(k, min(partition.last, k + 50_000), dtype=np.int64), self.scale)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in made.values()], list(made))


@dataclass
class Handed(WriterCommitMessage):
    rows: int


class CallbackSink(DataSource):
    """Option callback: module:function, called on the executors with each record batch; it may return nothing."""

    @classmethod
    def name(cls) -> str:
        return "tessera_callback"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return CallbackWriter(self.options["callback"])


class CallbackWriter(DataSourceArrowWriter):
    def __init__(self, callback: str) -> None:
        self.callback = callback

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Handed:
        import importlib

        module, _, name = self.callback.partition(":")
        function, rows = getattr(importlib.import_module(module), name), 0
        for batch in iterator:
            function(batch)
            rows += batch.num_rows
        return Handed(rows)


def register_connectors(spark: SparkSession) -> None:
    for source in (GeneratedTables, CallbackSink):
        spark.dataSource.register(source)
