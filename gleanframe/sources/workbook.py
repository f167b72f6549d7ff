"""Rate tables from workbooks and JSON, and typed settings."""

from __future__ import annotations

import os
import re
import zipfile
from collections.abc import Mapping
from io import BytesIO
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanframe.sources.logs import rates

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def sheet_rows(content: bytes, sheet: str = "xl/worksheets/sheet1.xml") -> list[list[str | None]]:
    """The cells of a workbook's first sheet as texts; a missing cell is ``None``."""
    with zipfile.ZipFile(BytesIO(content)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        out = []
        for row in ElementTree.fromstring(z.read(sheet)).iterfind(".//m:row", _NS):
            cells: dict[int, str | None] = {}
            for n, c in enumerate(row.findall("m:c", _NS)):
                letters = re.match("[A-Z]*", c.get("r") or "")[0]
                at = n
                if letters:
                    at = 0
                    for x in letters:
                        at = at * 26 + ord(x) - 64
                    at -= 1
                v = c.find("m:v", _NS)
                text = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t")) if c.get("t") == "inlineStr" else (v.text if v is not None else None)
                cells[at] = shared[int(text)] if c.get("t") == "s" and text is not None else text
            out.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
        return out


def _number(text: str | None) -> float:
    try:
        return float(text or 0)
    except ValueError:
        return 0.0


def workbook_rates(spark: SparkSession, path: str, name: str, fields: Mapping[str, str]) -> DataFrame:
    """Rows ``name``, ``field``, ``value`` of a workbook.

    Columns are found by a part of their head, case apart: ``name`` for the row's name, ``fields`` from
    field to part. What is no number is 0; of repeated names the last row holds; an unreadable file or
    one without the name's column has no rows.
    """
    out: dict[tuple[str, str], float] = {}
    try:
        content = spark.read.format("binaryFile").load(path).select("content").first()["content"]  # a settings file
        head, *rows = sheet_rows(bytes(content))
        find = lambda part: next((i for i, h in enumerate(head) if part.lower() in (h or "").lower()), None)
        at, cols = find(name), {f: find(part) for f, part in fields.items()}
        for row in rows if at is not None else []:
            cell = lambda i, row=row: row[i] if i is not None and i < len(row) else None
            if (cell(at) or "").strip():
                out |= {(cell(at).strip(), f): _number(cell(i)) for f, i in cols.items()}
    except (zipfile.BadZipFile, KeyError, ValueError, TypeError, ElementTree.ParseError):
        out = {}
    return spark.createDataFrame([(n, f, v) for (n, f), v in out.items()], "name string, field string, value double")


def rate_table(spark: SparkSession, path: str, name: str = "model", fields: Mapping[str, str] | None = None, override: str = "spark.gleanframe.rates") -> DataFrame:
    """Rates from a workbook or JSON file, by the file's suffix; the session's ``override`` names another file. Small: meant for a broadcast by its size."""
    path = spark.conf.get(override, None) or path
    if path.lower().endswith((".xlsx", ".xlsm")):
        return workbook_rates(spark, path, name, fields or {"in": "input", "out": "output"})
    return rates(spark, path)


def settings(spark: SparkSession, defaults: Mapping[str, object], prefix: str = "spark.gleanframe.", environment: Mapping[str, str] | None = None) -> dict[str, object]:
    """Typed settings: the session's ``prefix`` + name, else the environment's upper-case name, else the default.

    A text takes the type of the default (flags: 1, true or yes); one that cannot be read, or is blank, leaves the default.
    """
    env = os.environ if environment is None else environment
    out: dict[str, object] = {}
    for key, default in defaults.items():
        text = spark.conf.get(prefix + key, None) or env.get(key.upper())
        out[key] = default
        if text is None or not text.strip():
            continue
        try:
            if isinstance(default, bool):
                out[key] = text.strip().lower() in ("1", "true", "yes")
            elif isinstance(default, (int, float)):
                out[key] = type(default)(text)
            else:
                out[key] = text
        except ValueError:
            pass
    return out


def flat_rates(spark: SparkSession, df: DataFrame, fields: list[str]) -> DataFrame:
    """Rates as one row per name with a column per field; missing ones are 0."""
    by = df.groupBy("name").pivot("field", fields).agg(F.last("value"))
    return by.na.fill(0.0, fields)
