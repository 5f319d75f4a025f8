"""The report as tables of ordered Markdown rows, numbered rows, and its sink.

Each part of the report brings its own keys to sort by: section, number, project, path, two more numbers and a
name.  Rows of vulnerabilities and findings are written once where there is a shared folder; the counts of
the summary, and which sections there are at all, come from those rows.

A report has a row for each occurrence of a dependency and each advisory that holds it, so its rows can grow with the
square of the input.  Of matched dependencies (:class:`Matched`), rows are made and placed by key; what is sorted, once, are occurrences
with the numbers of their rows, and rows and occurrences meet only in the last join, which nothing follows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.severity import FINDING_ORDER, VULN_ORDER, severity_rank
from ..functions.text import advisory_link, severity_html, smart_truncate
from ..operators.matching import TOLD_KEY, Matched
from ..session import materialised, materialised_together, releasing, shared_folder, work_folder

VULN_HEADER = ["Severity", "Package", "Version", "CVE", "Source", "Type", "Description",
               "Remediation"]
FINDING_HEADER = ["File", "Line", "Pattern", "Risk", "Description", "Recommendation"]
#: What one task of the join that makes the rows should have: bytes of different rows, and lines.
_TASK_BYTES, _TASK_LINES = 800_000, 2_000_000
RECOMMENDATIONS = ["Upgrade dependencies with known vulnerabilities",
                   "Look into the suspicious lines and fix them", "Scan again regularly",
                   "Agree on secure coding rules"]


def _row(cells: list[Column]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def _vulnerability_row() -> Column:
    return _row([severity_html(F.col("severity")), F.col("package"), F.col("version"), advisory_link(F.col("cve"), F.col("source")), F.col("source"),
                 F.col("type"), smart_truncate(F.col("description")), F.col("remediation")])


def vulnerability_rows(vulns: DataFrame | Matched) -> DataFrame:
    """One Markdown row per vulnerability with the columns it sorts by; of matched dependencies a row is made once for each key."""
    columns = ["severity_rank", "project", "path", "dep_seq", "rank", "cve", "row"]
    if isinstance(vulns, Matched):
        rows, places, key = dealt_by_key(rows_by_key(vulns), vulns.places())
        return rows.join(places, key).select(*columns)
    return vulns.withColumns({"severity_rank": severity_rank(F.col("severity"), VULN_ORDER), "row": _vulnerability_row()}).select(*columns)


def rows_by_key(matched: Matched) -> DataFrame:
    """The Markdown rows of each key, written once where there is a shared folder."""
    return materialised(matched.told().select(
        *TOLD_KEY, severity_rank(F.col("severity"), VULN_ORDER).alias("severity_rank"), "rank", "cve", _vulnerability_row().alias("row")))


def dealt_by_key(rows: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Rows by key and the places of the keys, dealt out for the join that makes a row for each place, and the columns to join by.

    A task gets about as many bytes of different rows as a file format keeps in one dictionary, so that what it writes are mostly
    numbers, whatever its rows stand for. The places of a key with more lines than a task should make are cut into slices, each of
    which gets the rows. Without a shared folder nothing is known of the sizes, and Spark deals by its own rules.
    """
    if shared_folder(rows.sparkSession) is None:
        return rows, places, TOLD_KEY
    sizes = rows.groupBy(*TOLD_KEY).agg(F.count("*").alias("lines"), F.sum(F.octet_length("row")).alias("bytes"))
    slices = F.ceil(F.col("lines") * F.col("times") / _TASK_LINES)
    load = places.groupBy(*TOLD_KEY).agg(F.count("*").alias("times")).join(sizes, TOLD_KEY).withColumn("slices", slices)
    with releasing(rows.sparkSession):
        size = load.agg(F.sum(F.col("bytes") * F.col("slices")) / _TASK_BYTES, F.sum(F.col("lines") * F.col("times")) / _TASK_LINES, F.max("slices")).first()
    tasks, key = int(max(size[0] or 0, size[1] or 0)) + 1, TOLD_KEY
    if (size[2] or 0) > 1:
        key = [*TOLD_KEY, "slice"]
        hot, n = materialised(load.where("slices > 1").select(*TOLD_KEY, "slices")), F.coalesce("slices", F.lit(1))
        places = places.join(hot, TOLD_KEY, "left").withColumn("slice", F.pmod(F.xxhash64("project", "path", "dep_seq"), n)).drop("slices")
        rows = rows.join(hot, TOLD_KEY, "left").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))).drop("slices")
    return rows.repartition(tasks, *key), places.repartition(tasks, *key), key


def finding_rows(findings: DataFrame) -> DataFrame:
    """One Markdown row per code finding with the columns it sorts by."""
    cells = [F.concat_ws("/", "project", "path"), F.col("line").cast("string"), F.col("issue"),
             severity_html(F.col("severity"), tuple(FINDING_ORDER)), F.col("message"),
             F.col("recommendation")]
    return findings.select(
        severity_rank(F.col("severity"), FINDING_ORDER).alias("severity_rank"), "project", "path",
        "line", "rule_id", _row(cells).alias("row"))


_KEYS = "section int, n0 bigint, project string, path string, n1 bigint, n2 bigint, name string"
_ORDER = [c.strip().split(" ")[0] for c in _KEYS.split(",")] + ["value"]
_PLACE = ["project", "path", "dep_seq"]
NOTHING_FOUND = "No vulnerabilities found in dependencies."


def report_header(date: str | None = None, place: str | None = None, sources: list[str] = ()) -> list[str]:
    """Header lines: when and what was scanned, and with which advisory sources."""
    given = [("Scan Date", date), ("Project Path", place), ("Sources", ", ".join(sources) or "None (basic scan only)")]
    return [f"**{label}:** {text}" for label, text in given if text]


def _part(df: DataFrame, section: int, order: dict[str, str], value: str, *more: str) -> DataFrame:
    """Rows of one section with the keys they sort by, and more columns; keys that a section doesn't have are equal."""
    keys = [F.coalesce(F.col(order[n]).cast(t), F.lit(0 if t != "string" else "").cast(t)).alias(n) if n in order else
            F.lit(section if n == "section" else 0 if t != "string" else "").cast(t).alias(n)
            for n, t in (c.strip().split(" ") for c in _KEYS.split(","))]
    return df.select(*keys, F.col(value).alias("value"), *more)


def _texts(df: DataFrame, section: int, lines: Column) -> DataFrame:
    """Lines, an array for each row of a table of one row, in their order."""
    return _part(df.select(F.posexplode(lines).alias("at", "line")), section, {"n0": "at"}, "line")


def _counts(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows, or the lines that they stand for, by severity."""
    rank, n = F.col("severity_rank"), F.col("lines") if "lines" in rows.columns else F.lit(1)
    sums = {"total": F.lit(True), **{level.lower(): rank == i for i, level in enumerate(order[:4])}, "unknown": rank > 3}
    return rows.agg(*[F.coalesce(F.sum(F.when(test, n)), F.lit(0)).cast("bigint").alias(c) for c, test in sums.items()])


def _count_lines(labels: dict[str, str]) -> Column:
    return F.array(*[F.concat(F.lit(f"- **{label}:** "), F.col(c).cast("string")) for c, label in labels.items()])


def _array(lines: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in lines])


def _table(name: str, columns: list[str]) -> list[str]:
    return ["", f"## {name}", "", f"| {' | '.join(columns)} |", "|" + "---|" * len(columns)]


_VULN_ORDER = {"n0": "severity_rank", "project": "project", "path": "path", "n1": "dep_seq", "n2": "rank", "name": "cve"}


def _lines(title: str, vulns: DataFrame | None, findings: DataFrame | None, header: list[str]) -> DataFrame:
    vrows = vulnerability_rows(vulns) if vulns is not None else None
    if vrows is not None and findings is not None:
        vrows, frows = materialised_together(vrows, finding_rows(findings))
        return _parts(title, vrows, _part(vrows, 4, _VULN_ORDER, "row"), None, header, frows)
    vrows = materialised(vrows) if vrows is not None else None
    return _parts(title, vrows, _part(vrows, 4, _VULN_ORDER, "row") if vrows is not None else None, findings, header)


def _parts(title: str, counted: DataFrame | None, vlines: DataFrame | None, findings: DataFrame | None, header: list[str],
           frows: DataFrame | None = None) -> DataFrame:
    """The lines of all sections; ``counted`` has what the summary counts of vulnerabilities, ``vlines`` their lines, if these are not numbered apart."""
    if counted is None and findings is None:
        raise ValueError("a report needs vulnerabilities or findings")
    frows = materialised(finding_rows(findings)) if findings is not None else frows
    one = (counted if counted is not None else frows).sparkSession.range(1)
    parts = [_texts(one, 0, _array([f"# Security Report - {title}", "", *header, *[""] * bool(header), "## Executive Summary", ""]))]
    levels = {"critical": "Critical", "high": "High", "medium": "Medium", "low": "Low"}
    if counted is not None:
        counts, some = _counts(counted, VULN_ORDER), F.col("total") > 0
        unknown = F.when(F.col("unknown") > 0, _count_lines({"unknown": "Unknown"})).otherwise(F.array().cast("array<string>"))
        parts += [_texts(counts, 1, F.concat(_count_lines({"total": "Total Vulnerabilities", **levels}), unknown)),
                  _texts(counts, 3, F.when(some, _array(_table("Vulnerabilities", VULN_HEADER))).otherwise(
                      _array(["", "## Vulnerabilities", "", NOTHING_FOUND])))]
        parts += [vlines] if vlines is not None else []
    if frows is not None:
        counts = _counts(frows, FINDING_ORDER).where("total > 0")
        parts += [_texts(counts, 2, _count_lines({"total": "Suspicious Code Patterns", **{k: f"{v} Risk Patterns" for k, v in levels.items()}})),
                  _texts(counts, 5, _array(_table("Suspicious Code Patterns", FINDING_HEADER))),
                  _part(frows, 6, {"n0": "severity_rank", "project": "project", "path": "path", "n1": "line", "name": "rule_id"}, "row")]
    parts.append(_texts(one, 7, _array(["", "## Recommendations", "", *[f"{i}. {t}" for i, t in enumerate(RECOMMENDATIONS, 1)]])))
    return reduce(DataFrame.unionByName, parts)


def report_lines(title: str, vulns: DataFrame | None, findings: DataFrame | None,
                 header: list[str] = ()) -> DataFrame:
    """The whole report, one row per line, sorted globally; write it as text.

    Findings have a section, and counts in the summary, only if there are any; without vulnerabilities a line says so.
    """
    return _lines(title, vulns, findings, list(header)).orderBy(*_ORDER).select("value")


def numbered_report(title: str, vulns: DataFrame | Matched | None, findings: DataFrame | None,
                    header: list[str] = ()) -> DataFrame:
    """``position`` (from 1) and ``text`` of every line of the report."""
    if isinstance(vulns, Matched):
        return _numbered_by_key(title, vulns, findings, list(header))
    return numbered(_lines(title, vulns, findings, list(header)), _ORDER).select("position", F.col("value").alias("text"))


def _numbered_by_key(title: str, matched: Matched, findings: DataFrame | None, header: list[str]) -> DataFrame:
    """The numbered report of matched dependencies: occurrences are sorted once, with how many lines of each severity they have.

    Lines of a place that several occurrences share (files of one path) may lie between each other and are ordered one by one.
    """
    rows, levels = rows_by_key(matched), range(len(VULN_ORDER) + 1)
    counts, starts = [f"_n{i}" for i in levels], [f"_at{i}" for i in levels]
    sizes = materialised(rows.groupBy(*TOLD_KEY).agg(*[F.count_if(F.col("severity_rank") == i).alias(c) for i, c in zip(levels, counts, strict=True)]))
    places = matched.places().withColumns({c: F.coalesce(c, F.lit(0 if c == "dep_seq" else "")) for c in _PLACE})
    placed, totals, several = _running_counts(places.join(sizes, TOLD_KEY), _PLACE, counts, starts)
    counted = rows.sparkSession.createDataFrame([(i, n) for i, n in zip(levels, totals, strict=True) if n], "severity_rank int, lines bigint")
    other = numbered(_parts(title, counted, None, findings, header), _ORDER)
    first, found = other.where("section < 4").count(), sum(totals)
    lines = other.select((F.col("position") + F.when(F.col("section") > 4, found).otherwise(0)).alias("position"), F.col("value").alias("text"))
    before = F.array(*[F.col(c) + F.lit(first + sum(totals[:i])) for i, c in zip(levels, starts, strict=True)])
    start = F.element_at("_before", F.col("severity_rank") + 1)
    dealt, own, key = dealt_by_key(rows, placed.where("_sharing = 1"))
    inside = Window.partitionBy(*key, "severity_rank").orderBy("rank", "cve")
    own = own.select(*key, before.alias("_before")).join(dealt.select(*key, "severity_rank", "row", F.row_number().over(inside).alias("_place")), key)
    lines = lines.unionByName(own.select((start + F.col("_place")).alias("position"), F.col("row").alias("text")))
    if not several:
        return lines
    level = Window.partitionBy(*_PLACE, "severity_rank")
    place = F.min(start).over(level) + F.row_number().over(level.orderBy("rank", "cve", "row"))
    common = placed.where("_sharing > 1").withColumn("_before", before).join(rows, TOLD_KEY)
    return lines.unionByName(common.select(place.alias("position"), F.col("row").alias("text")))


def _running_counts(df: DataFrame, order: list[str], counts: list[str], starts: list[str]) -> tuple[DataFrame, list[int], int]:
    """``df`` with the sums of ``counts`` over all rows before each in an order, as ``starts``, and ``_sharing``, the number of rows
    that are equal in it; the sums over all rows; how many rows are not alone. Rows are dealt out by ranges, sorted and written once.
    """
    spark = df.sparkSession
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = placed.withColumn("_sharing", F.count("*").over(Window.partitionBy(*order))).withColumn("_part", F.spark_partition_id())
    schema = StructType([*placed.drop(*counts).schema, *[StructField(c, LongType()) for c in starts], *[StructField(c, LongType()) for c in counts]])

    def run(batches):
        before = [0] * len(counts)
        for batch in batches:
            own, sums = batch.select([n for n in schema.names if n not in starts and n not in counts]), []
            for i, c in enumerate(counts):
                each = batch.column(c).to_numpy(zero_copy_only=False)
                upto = np.cumsum(each) + before[i]
                sums.append(pa.array(upto - each))
                before[i] = int(upto[-1]) if len(upto) else before[i]
            yield pa.RecordBatch.from_arrays([*own.columns, *sums, *[batch.column(c) for c in counts]], names=schema.names)

    path = work_folder(spark)
    with releasing(spark):
        placed.mapInArrow(run, schema).write.parquet(path)
    placed = spark.read.schema(schema).parquet(path)
    earlier, offsets, several = [0] * len(counts), [], 0
    for part, shared, *sums in sorted(placed.groupBy("_part").agg(F.count_if(F.col("_sharing") > 1), *[F.sum(c) for c in counts]).collect()):
        offsets.append((part, *earlier))
        several += shared
        earlier = [a + b for a, b in zip(earlier, sums, strict=True)]
    fields = [f"_e{i}" for i in range(len(counts))]
    parts = F.broadcast(spark.createDataFrame(offsets, ", ".join(["_part int", *[f"{f} long" for f in fields]])))
    placed = placed.drop(*counts).join(parts, "_part").withColumns({s: F.col(s) + F.col(f) for s, f in zip(starts, fields, strict=True)})
    return placed.drop("_part", *fields), earlier, several


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``position``, the place from 1 of each row in an order, without bringing rows to one task.

    Rows are dealt out by ranges of the order, sorted and written; a partition's places follow on the rows
    of those before it, of which only the counts are collected, one for each partition.
    """
    spark = df.sparkSession
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    path, schema = work_folder(spark), placed.schema
    with releasing(spark):
        placed.write.parquet(path)
    placed = spark.read.schema(schema).parquet(path).withColumn("_part", F.shiftright("_place", 33))
    before, offsets = 0, []
    for part, n in sorted(placed.groupBy("_part").agg(F.count("*")).collect()):
        offsets.append((part, before))
        before += n
    starts = F.broadcast(spark.createDataFrame(offsets, "_part long, _before long"))
    inside = F.col("_place").bitwiseAND((1 << 33) - 1)
    return placed.join(starts, "_part").withColumn("position", F.col("_before") + inside + 1).drop("_part", "_place", "_before")


def write_report(lines: DataFrame, path: str) -> None:
    """Write report lines; the part files hold the report in order."""
    lines.write.mode("overwrite").text(path)
