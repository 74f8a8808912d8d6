"""Text files of join dependencies, one a line: ``arity,{lhs|component,component,...},measure``."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits
from ..operators.measures import JD

_SET = r"\{[0-9, ]*\}"
_LINE = re.compile(rf"^\s*(\d+)\s*,\s*\{{\s*({_SET})\s*\|(.*)\}}\s*,\s*([-+0-9.eE]+|NaN|Infinity)\s*$")


def format_line(n: int, jd: JD) -> str:
    return f"{n},{{{bits.text(jd.lhs)}|{','.join(bits.text(c) for c in jd.components)}}},{jd.measure}"


def parse_line(line: str) -> tuple[int, JD]:
    """(arity, dependency); raises ValueError if the line isn't one."""
    m = _LINE.match(line)
    if not m:
        raise ValueError(f"not a dependency: {line!r}")
    return int(m[1]), JD(bits.parse(m[2]), tuple(sorted(map(bits.parse, re.findall(_SET, m[3])))), float(m[4]))


def write_sep(spark: SparkSession, path: str, n: int, jds: Iterable[JD]) -> None:
    """One text file a part; the dependencies of a run are few, so one part."""
    spark.createDataFrame([(format_line(n, j),) for j in jds], "value string").coalesce(1).write.mode("overwrite").text(path)


def parse_columns(lines: DataFrame) -> DataFrame:
    """(arity, lhs, components, measure) of a DataFrame of lines (value), in Spark functions; other lines go."""
    sets = F.regexp_extract_all("value", F.lit(rf"({_SET})"), 1)

    def mask(s):
        return bits.c_of(F.transform(F.filter(F.split(F.regexp_replace(s, r"[{} ]", ""), ","), lambda x: x != ""), lambda x: x.cast("int")))

    good = lines.where(F.col("value").rlike(_LINE.pattern))
    masks = F.transform(sets, mask)
    cells = good.select(F.regexp_extract("value", r"^\s*(\d+)", 1).cast("int").alias("arity"), masks.alias("m"), F.regexp_extract("value", r",\s*([^,]+?)\s*$", 1).cast("double").alias("measure"))
    return cells.select("arity", F.get("m", F.lit(0)).alias("lhs"), F.array_sort(F.slice("m", 2, F.greatest(F.size("m") - 1, F.lit(0)))).alias("components"), "measure")


def read_sep(spark: SparkSession, path: str) -> DataFrame:
    return parse_columns(spark.read.text(path))


def lhs_statistics(jds: DataFrame) -> DataFrame:
    """Number of dependencies, least, greatest and mean size of their left sides."""
    size = F.bit_count("lhs")
    return jds.agg(F.count(F.lit(1)).alias("jds"), F.min(size).cast("bigint").alias("min_lhs"), F.max(size).cast("bigint").alias("max_lhs"), (F.round(F.avg(size), 6) + 0.0).alias("avg_lhs"))


def sep_name(data: str, timeout: float, range_size: int, threshold: float) -> str:
    return f"{data}.TO.{timeout:g}.RANGE.{range_size}.THRESH.{threshold:g}.sep"


def threshold_of(name: str) -> float | None:
    m = re.search(r"\.THRESH\.(.*?)\.sep", name)
    return float(m[1]) if m else None
