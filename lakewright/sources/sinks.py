"""Writers: flat CSV, RIS, SRT, manifests and atomic snapshots. Spark's commit protocol makes each write all or nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns in a fixed order as text: null is empty, lists are joined with semicolons."""
    kinds = {f.name: f.dataType for f in df.schema}
    out = []
    for c in columns:
        value = F.array_join(F.col(c).cast("array<string>"), ";") if isinstance(kinds[c], T.ArrayType) else F.col(c).cast("string")
        out.append(F.coalesce(value, F.lit("")).alias(c))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    flat(df, columns).write.mode("overwrite").csv(path, header=True, emptyValue="")


def ris_record(kind: Column, title: Column, authors: Column, year: Column, doi: Column, keywords: Column, most: int = 20) -> Column:
    """A RIS record in fixed tag order with at most `most` keywords."""
    line = lambda tag, v: F.when(v.isNotNull() & (v != ""), F.concat(F.lit(f"{tag}  - "), v))
    many = lambda tag, v: F.transform(F.coalesce(v, F.array().cast("array<string>")), lambda x: F.concat(F.lit(f"{tag}  - "), x))
    head = F.array(line("TY", kind), line("TI", title))
    tail = F.array(line("PY", year.cast("string")), line("DO", doi))
    all_ = F.concat(head, many("AU", authors), tail, many("KW", F.slice(F.coalesce(keywords, F.array().cast("array<string>")), 1, most)), F.array(F.lit("ER  - ")))
    return F.array_join(F.array_compact(all_), "\n")


def srt_time(seconds: Column) -> Column:
    ms = F.round(seconds * 1000).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000), F.floor(ms % 3600000 / 60000), F.floor(ms % 60000 / 1000), ms % 1000)


def srt_block(at: Column, start: Column, stop: Column, text: Column) -> Column:
    return F.concat(at.cast("string"), F.lit("\n"), srt_time(start), F.lit(" --> "), srt_time(stop), F.lit("\n"), F.trim(text), F.lit("\n"))


def manifest(spark, path: str) -> DataFrame:
    """(path, bytes, sha256) of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def replace_snapshot(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def append_journal(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def markdown_row(cells: list[Column]) -> Column:
    """A row of a Markdown pipe table: bars are escaped, line ends become spaces, null is empty."""
    plain = lambda c: F.replace(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "\\s*\\n\\s*", " "), F.lit("|"), F.lit("\\|"))
    return F.concat(F.lit("| "), F.concat_ws(" | ", *map(plain, cells)), F.lit(" |"))


def gantt_lines(rows: DataFrame, id_: str, title: str, section: str, start: str, stop: str) -> DataFrame:
    """(section, at, id, line) of a Mermaid chart: a head for each section (at 0), then its rows by id.

    A row without an end, or that ends when it starts, is a milestone; one with an end only starts there. Rows without dates are left out.
    """
    clean = lambda c: F.replace(F.replace(c.cast("string"), F.lit(":"), F.lit(" - ")), F.lit("\n"), F.lit(" "))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    part = F.coalesce(F.col(section).cast("string"), F.lit("Unassigned"))
    picked = rows.select(part.alias("section"), F.col(id_).alias("id"), clean(F.col(title)).alias("t"), F.regexp_replace(F.col(id_).cast("string"), "[^A-Za-z0-9_]", "_").alias("k"), day(F.coalesce(start, stop)).alias("a"), day(F.col(stop)).alias("b")).where("a is not null")
    span = F.concat(F.lit("    "), F.coalesce("t", F.lit("")), F.lit(" :"), F.when(F.coalesce(F.col("a") == F.col("b"), F.lit(True)), F.concat(F.lit("milestone, "), "k", F.lit(", "), "a", F.lit(", 0d"))).otherwise(F.concat("k", F.lit(", "), "a", F.lit(", "), "b")))
    body = picked.select("section", F.lit(1).alias("at"), "id", span.alias("line"))
    heads = picked.select("section").distinct().select("section", F.lit(0).alias("at"), F.lit(None).cast(rows.schema[id_].dataType).alias("id"), F.concat(F.lit("    section "), F.replace("section", F.lit(":"), F.lit(" - "))).alias("line"))
    return heads.unionByName(body)


def write_lines(df: DataFrame, path: str, by: list[str], line: str = "line") -> None:
    """Lines in order: files in the order of their names, each sorted."""
    df.repartitionByRange(*by).sortWithinPartitions(*by).select(line).write.mode("overwrite").text(path)


#: Columns of a schedule's CSV (fixed values).
GANTT_COLUMNS = ("control_id", "title", "section", "start_date", "end_date", "duration_days", "date_basis", "scheduled", "working_status", "owner", "teams", "workstreams", "depends_on", "source_evidence_ids")


def gantt_rows(controls: DataFrame, status: DataFrame) -> DataFrame:
    """A row for each control with GANTT_COLUMNS: dates of the source before forecasts, the owner of the status before the source's.

    controls: control_id, title, start_date, end_date, date, duration_days, owner, teams, workstreams, depends_on, source_evidence_ids.
    status: control_id, forecast_start_date, forecast_end_date, forecast_date, working_status, current_owner.
    """
    s = status.select(*[F.col(c).alias(f"s_{c}") for c in status.columns])
    rows = controls.join(s, F.col("control_id") == F.col("s_control_id"), "left")
    first, last = F.col("start_date"), F.coalesce("end_date", "date")
    planned, due = F.col("s_forecast_start_date"), F.coalesce("s_forecast_end_date", "s_forecast_date")
    stop = F.coalesce(last, due)
    start = F.coalesce(first, planned, stop)
    known = lambda a, b: F.coalesce(a, b).isNotNull()
    basis = F.when(known(first, last), "source").when(known(planned, due), "human_forecast").otherwise("unscheduled")
    section = F.coalesce(F.get("workstreams", F.lit(0)), F.get("teams", F.lit(0)), F.lit("Unassigned"))
    made = {"section": section, "start_date": start, "end_date": stop, "date_basis": basis, "scheduled": F.when(start.isNotNull(), "yes").otherwise("no"), "working_status": F.coalesce("s_working_status", F.lit("unknown")), "owner": F.coalesce("s_current_owner", "owner")}
    return rows.select(*[made.get(c, F.col(c)).alias(c) for c in GANTT_COLUMNS])


def html_escaped(c: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def gantt_page(rows: DataFrame, title: str = "Project Gantt") -> DataFrame:
    """(at, id, line): a page that shows the schedule as a table; one line of JSON for each row, by id, between a head and a foot."""
    kinds = {f.name: f.dataType for f in rows.schema}
    plain = lambda c: F.transform(F.col(c).cast("array<string>"), html_escaped) if isinstance(kinds[c], T.ArrayType) else html_escaped(F.col(c).cast("string"))
    data = F.replace(F.to_json(F.struct(*[plain(c).alias(c) for c in rows.columns])), F.lit("</"), F.lit("<\\/"))
    body = rows.select(F.lit(1).alias("at"), F.col("control_id").alias("id"), F.concat(data, F.lit(",")).alias("line"))
    shown = ("control_id", "title", "section", "start_date", "end_date", "working_status", "owner")
    cells = "+".join(f"'<td>'+(x.{c}??'')+'</td>'" for c in shown)
    head = f'<!doctype html><meta charset="utf-8"><title>{title}</title><h1>{title}</h1><table id="t"><tr>' + "".join(f"<th>{c}</th>" for c in shown) + "</tr></table><script>const data=["
    foot = f"];document.getElementById('t').innerHTML+=data.map(x=>'<tr>'+{cells}+'</tr>').join('');</script>"
    none = F.lit(None).cast(kinds["control_id"])
    ends = rows.sparkSession.range(2).select((F.col("id") * 2).cast("int").alias("at"), none.alias("_id"), F.when(F.col("id") == 0, head).otherwise(foot).alias("line"))
    return ends.withColumnRenamed("_id", "id").union(body)
