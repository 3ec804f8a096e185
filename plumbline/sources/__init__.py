"""Record sets and settings. Datasets are Darwin Core archives (.zip) or data packages (.json).

Every value is a trimmed string; an empty cell is '', a cell that a short row lacks is NULL. That difference is lost in
Spark's CSV reader, so rows are read by Python data sources (see `archives`).
"""

from __future__ import annotations

import argparse
import json
import os
import tempfile
import urllib.request
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.model import PlumblineError
from plumbline.sources.archives import DarwinCoreSource, DataPackageSource, header_of, sent


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """record_ord (place of the row from 1), record_id (id, else occurrenceID, else row-N, by the columns that the row has) and the terms."""
    name = os.path.basename(str(path)).lower()
    if name.endswith(".zip"):
        source = DarwinCoreSource
    elif name.endswith(".json") or name.endswith("datapackage"):
        source = DataPackageSource
    else:
        raise PlumblineError(f"Unsupported dataset input: {path}")
    path = sent(spark, str(path))
    header_of(source.opener(path))  # told as it is, not as Spark's error
    spark.dataSource.register(source)
    rows = spark.read.format(source.name()).option("path", path).load()
    ids = [F.col(f"`{c}`") for c in ("id", "occurrenceID") if c in rows.columns]
    return rows.withColumn("record_id", F.coalesce(*ids, F.concat(F.lit("row-"), F.col("record_ord").cast("string")))).select("record_ord", "record_id", *(c for c in rows.columns if c != "record_ord"))


def read_settings(path: str) -> dict[str, dict]:
    """{test id: {useDefaults, parameters}}."""
    return json.loads(Path(path).read_text(encoding="utf-8"))


def write_settings(settings: Mapping[str, Mapping], path: str) -> None:
    Path(path).write_text(json.dumps(settings, indent=2, ensure_ascii=False), encoding="utf-8")


def cached(source: str, folder: str, timeout: float = 60) -> str:
    """The local path of a source: a file that exists, or a download that is kept and moved into place whole."""
    if not (source or "").strip():
        raise PlumblineError("the source is blank")
    if not source.startswith(("http://", "https://")):
        if not os.path.exists(source):
            raise PlumblineError(f"{source} doesn't exist")
        return source
    import hashlib
    import re

    stem, ext = os.path.splitext(source.rpartition("/")[2])
    slug = re.sub(r"[^a-z0-9]+", "-", stem.lower()).strip("-") or "resource"
    to = Path(folder) / f"{slug}-cached-{hashlib.sha256(source.encode()).hexdigest()[:12]}{ext}"
    if to.exists() and to.stat().st_size:
        return str(to)
    to.parent.mkdir(parents=True, exist_ok=True)
    with urllib.request.urlopen(source, timeout=timeout) as got:  # raises on other codes than 2xx
        data = got.read()
    with tempfile.NamedTemporaryFile(dir=to.parent, delete=False) as f:
        f.write(data)
    os.replace(f.name, to)
    return str(to)


def strict_bool(text: str) -> bool:
    if text.lower() not in ("true", "false"):
        raise argparse.ArgumentTypeError(f"true or false, not {text!r}")
    return text.lower() == "true"


def threads(text: str) -> int:
    if not text.isdigit() or int(text) < 1:
        raise argparse.ArgumentTypeError(f"a number of 1 or more, not {text!r}")
    return int(text)


def names(text: str) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()]


DEFAULTS = {"use_cases": "", "definitions": "", "packages": "plumbline.rules", "reports": "reports", "threads": "4", "dedup": "true"}


def config(overrides: Mapping[str, str | None], spark: SparkSession | None = None, defaults: Mapping[str, str] = DEFAULTS) -> dict[str, str]:
    """Settings by precedence: what is given, the session's plumbline.* keys, the defaults."""
    out = dict(defaults)
    for k in out:
        if spark is not None and (v := spark.conf.get(f"plumbline.{k}", None)) is not None:
            out[k] = v
    return out | {k: v for k, v in overrides.items() if v is not None}


def available_terms(records: DataFrame) -> Sequence[str]:
    return sorted(c for c in records.columns if c not in ("record_ord", "record_id"))
