"""Export, import and snapshots of a store as compressed JSON folders."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from engramlake.operators import scans

#: snapshot-<mode>-<yyyymmddThhmmss>, the name of a snapshot's folder.
_NAME = re.compile(r"^snapshot-(full|sync)-(\d{8}T\d{6})$")


def snapshot_name(mode: str, stamp: str) -> str:
    name = f"snapshot-{mode}-{stamp}"
    if not _NAME.match(name):
        raise ValueError(name)
    return name


def newest_snapshot(names: list[str], mode: str) -> str | None:
    """The newest snapshot of a mode among folder names; other names are passed over."""
    found = sorted((m[2], n) for n in names if (m := _NAME.match(n)) and m[1] == mode)
    return found[-1][1] if found else None


def write_snapshot(tables: dict[str, DataFrame], path: str, mode: str = "full") -> None:
    """Each table as JSON lines compressed, in a folder of its own; "sync" leaves out private memories and all but memories."""
    for name, df in tables.items():
        if mode == "sync":
            if name != "memories":
                continue
            df = scans.export_rows(df, only_syncable=True)
        df.write.mode("errorifexists").option("compression", "gzip").json(f"{path}/{name}")


def read_snapshot(spark: SparkSession, path: str, schemas: dict, reserved: str | None = None) -> dict[str, DataFrame]:
    """The tables of a snapshot with their schemas; rows of the reserved namespace are not taken in."""
    out = {}
    for name, schema in schemas.items():
        df = spark.read.schema(schema).json(f"{path}/{name}")
        out[name] = scans.importable(df, reserved) if reserved and name == "memories" else df
    return out
