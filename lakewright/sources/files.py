"""Scans of delimited files, line-delimited JSON, folders, notes, citations and transcripts as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import clock_seconds

#: Kinds of files by extension (fixed values).
CATEGORIES = {
    "document": ("pdf", "doc", "docx", "odt", "rtf", "txt", "md"),
    "spreadsheet": ("csv", "tsv", "xls", "xlsx", "ods"),
    "image": ("png", "jpg", "jpeg", "gif", "webp", "svg", "heic"),
    "audio": ("mp3", "wav", "m4a", "flac", "ogg"),
    "video": ("mp4", "mov", "mkv", "webm", "avi"),
    "archive": ("zip", "tar", "gz", "7z", "rar"),
    "code": ("py", "js", "ts", "java", "go", "rs", "c", "cpp", "sh", "sql", "json", "yaml", "yml"),
}


def delimited(spark: SparkSession, path: str, columns: list[str], separator: str = ",") -> DataFrame:
    """Text columns as they stand, short rows padded with null; the first line is the header. No typing.

    Columns are named by the caller, so that no driver-side pass reads the file.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).csv(path, header=True, sep=separator, mode="PERMISSIVE", enforceSchema=True, multiLine=False)


def check_headers(names: list[str]) -> None:
    """Headers must be non-blank and unique."""
    blank = [i for i, n in enumerate(names) if not (n or "").strip()]
    twice = sorted({n for n in names if names.count(n) > 1})
    if blank or twice:
        raise ValueError(f"blank headers at {blank}, repeated headers {twice}")


def json_lines(spark: SparkSession, path: str, schema: str, policy: str = "skip") -> DataFrame:
    """Lines of JSON. Malformed lines: "skip" drops them, "fail" raises, "tail" drops one only if it ends its file."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    if policy == "tail":
        # a torn last line has no line end, so it is the last row of its file
        lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("_at", "value"), F.input_file_name().alias("_file"), F.size(F.split("value", "\n")).alias("_n"))
        lines = lines.where(F.trim("value") != "")
    kind = T._parse_datatype_string(schema)
    full = T.StructType([*kind.fields, T.StructField("_bad", T.StringType())])
    parsed = lines.withColumn("r", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    if policy == "skip":
        parsed = parsed.where(~bad)
    else:
        fatal = bad if policy == "fail" else bad & (F.col("_at") < F.col("_n") - 1)
        parsed = parsed.withColumn("r", F.when(fatal, F.raise_error(F.concat(F.lit("malformed line: "), F.col("value"))).cast(full)).otherwise(F.col("r"))).where(~bad | fatal)
    return parsed.select("r.*").drop("_bad")


def category(extension: Column) -> Column:
    out = F.lit("other")
    for name, known in CATEGORIES.items():
        out = F.when(extension.isin(*known), name).otherwise(out)
    return out


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file below a folder, hidden ones left out; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    name = F.element_at(F.split("path", "/"), -1)
    extension = F.lower(F.regexp_extract(name, "\\.([A-Za-z0-9]+)$", 1))
    rows = files.select("path", name.alias("name"), extension.alias("extension"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), category(extension).alias("category"))
    return rows.where(~F.col("path").rlike("/\\.[^/]+"))


def notes(spark: SparkSession, path: str) -> DataFrame:
    """Markdown notes: (path, metadata map, body). Lists stay as text; a note without front matter has an empty map."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", "^﻿|\\r", "").alias("v"))
    head = F.regexp_extract("v", "(?s)^---\\n(.*?)\\n---\\n?", 1)
    lines = F.filter(F.split(head, "\n"), lambda x: x.rlike("^[A-Za-z_][A-Za-z0-9_ -]*:"))
    pair = lambda x: F.struct(F.trim(F.regexp_extract(x, "^([^:]+):", 1)).alias("key"), F.trim(F.regexp_replace(F.regexp_extract(x, "^[^:]+:(.*)$", 1), "^\\s*[\"']|[\"']\\s*$", "")).alias("value"))
    meta = F.map_from_entries(F.transform(lines, pair))
    return raw.select("path", meta.alias("metadata"), F.regexp_replace("v", "(?s)^---\\n.*?\\n---\\n?", "").alias("body"))


def flow_list(c: Column) -> Column:
    """Items of [a, "b", c]."""
    inner = F.regexp_extract(c, "^\\s*\\[(.*)\\]\\s*$", 1)
    return F.filter(F.transform(F.split(inner, ","), lambda x: F.trim(F.regexp_replace(F.trim(x), "^[\"']|[\"']$", ""))), lambda x: x != "")


def pipe_table(text: Column) -> Column:
    """Rows of cells of a Markdown pipe table, without its rule line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("^\\s*\\|.*\\|\\s*$") & ~x.rlike("^\\s*\\|[\\s:|-]+\\|\\s*$"))
    cells = lambda x: F.transform(F.split(F.regexp_replace(F.trim(x), "^\\||\\|$", ""), "(?<!\\\\)\\|"), lambda c: F.trim(F.replace(c, F.lit("\\|"), F.lit("|"))))
    return F.transform(lines, cells)


def citations(spark: SparkSession, path: str) -> DataFrame:
    """RIS records: (path, at, tags map of lists). A line without a tag continues the one before; a missing ER ends with the next TY."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace(F.regexp_replace("value", "^﻿", ""), "\\r\\n?", "\n").alias("v"))
    joined = F.regexp_replace("v", "\\n(?![A-Z][A-Z0-9]  ?-|\\n|$)\\s*", " ")
    records = F.filter(F.split(joined, "(?m)(?=^TY  ?-)"), lambda r: r.rlike("^TY  ?-"))
    rows = raw.select("path", F.posexplode(records).alias("at", "r"))
    fields = F.transform(F.regexp_extract_all("r", F.lit("(?m)^[A-Z][A-Z0-9]  ?-.*$"), F.lit(0)), lambda x: F.struct(F.substring(x, 1, 2).alias("tag"), F.trim(F.regexp_replace(x, "^[A-Z0-9]{2}  ?-\\s?", "")).alias("value")))
    fields = F.filter(fields, lambda x: (x["tag"] != "ER") & (x["value"] != ""))
    tags = F.array_distinct(F.transform(fields, lambda x: x["tag"]))
    values = F.transform(tags, lambda t: F.transform(F.filter(fields, lambda x: x["tag"] == t), lambda x: x["value"]))
    return rows.select("path", "at", F.map_from_arrays(tags, values).alias("tags"))


def bibtex(spark: SparkSession, path: str) -> DataFrame:
    raise NotImplementedError("BibTeX is not read; convert it to RIS")


SESSION_ENTRY = "type string, id string, parentId string, timestamp string, role string, content string, model string, toolName string, isError boolean"


def session_log(spark: SparkSession, path: str) -> DataFrame:
    """Entries of agent session logs, malformed lines skipped, with their file and parsed time."""
    lines = spark.read.text(path).select(F.col("value"), F.input_file_name().alias("file"))
    rows = lines.select("file", F.from_json("value", SESSION_ENTRY).alias("r")).where("r.type is not null")
    return rows.select("file", "r.*").withColumn("at", F.try_to_timestamp("timestamp"))


def transcript(text: Column) -> Column:
    """Blocks of **Speaker** / *H:MM:SS* / text: array<struct<speaker,seconds,text>>."""
    blocks = F.regexp_extract_all(text, F.lit("(?ms)^\\*\\*[^*\\n]+\\*\\*\\s*\\n\\*[0-9:]+\\*\\s*\\n.*?(?=^\\*\\*[^*\\n]+\\*\\*\\s*$|\\z)"), F.lit(0))
    return F.transform(
        blocks,
        lambda b: F.struct(F.regexp_extract(b, "^\\*\\*([^*]+)\\*\\*", 1).alias("speaker"), clock_seconds(F.regexp_extract(b, "(?m)^\\*([0-9:]+)\\*", 1)).alias("seconds"), F.trim(F.regexp_replace(b, "(?s)^\\*\\*[^*]+\\*\\*\\s*\\n\\*[0-9:]+\\*\\s*\\n|\\s+$", "")).alias("text")),
    )


def meeting_turns(spark: SparkSession, path: str) -> DataFrame:
    """(path, date, at, speaker, text) of meeting transcripts, a JSON array of {speaker, text} for each file; a blank speaker or text fails."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.from_json("value", "array<struct<speaker:string,text:string>>").alias("turns"))
    whole = F.when(F.coalesce(F.size("turns"), F.lit(0)) > 0, F.col("turns")).otherwise(F.raise_error(F.concat(F.lit("no transcript array: "), "path")))
    rows = raw.select("path", F.posexplode(whole).alias("at", "r"))
    said = lambda k: F.when(F.trim(F.coalesce(F.col(f"r.{k}"), F.lit(""))) != "", F.trim(F.col(f"r.{k}"))).otherwise(F.raise_error(F.concat(F.lit(f"{k} is blank: "), "path")))
    name = F.url_decode(F.replace(F.element_at(F.split("path", "/"), -1), F.lit("+"), F.lit("%2B")))  # Spark gives paths as URLs
    date = F.try_to_date(F.regexp_extract(name, "\\b([0-9]{4}-[0-9]{2}-[0-9]{2})\\b", 1), "yyyy-MM-dd")
    return rows.select("path", date.alias("date"), "at", said("speaker").alias("speaker"), said("text").alias("text"))


MAIL = "path string, message_id string, reply_to array<string>, sender string, recipients string, subject string, sent string, body string, attachments array<struct<name:string,type:string,bytes:long,sha256:string>>"


def mail(spark: SparkSession, path: str) -> DataFrame:
    """A row for each .eml file: headers, body (plain text first, else HTML without its tags) and what is attached.

    sent is ISO 8601 in the message's own zone, null if it cannot be read. reply_to: In-Reply-To, then References.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.eml").load(path).select("path", "content")

    def parse(frames):
        import email
        import email.policy
        import hashlib
        import html
        import re
        from email.utils import parsedate_to_datetime

        import pandas as pd

        def one(where, content):
            m = email.message_from_bytes(bytes(content), policy=email.policy.default)
            ids = lambda k: re.findall("<([^<>]+)>", str(m.get(k) or ""))
            part = m.get_body(("plain", "html"))
            body = part.get_content() if part is not None else ""
            if part is not None and part.get_content_type() == "text/html":
                body = html.unescape(re.sub("<[^>]*>", "", re.sub("(?i)<br[^>]*>|</(?:p|div|h[1-6]|li|tr)>", "\n", re.sub("(?is)<(script|style).*?</\\1>", "", body))))
            held = []
            for a in m.iter_attachments():
                data = a.get_payload(decode=True)
                data = data if data is not None else a.as_bytes()
                held.append({"name": a.get_filename(), "type": a.get_content_type(), "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()})
            try:
                sent = parsedate_to_datetime(str(m["date"])).isoformat()
            except (TypeError, ValueError):
                sent = None
            text = lambda k: None if m[k] is None else str(m[k])
            return (where, (ids("message-id") or [None])[0], list(dict.fromkeys(ids("in-reply-to") + ids("references"))), text("from"), text("to"), text("subject"), sent, body.strip(), held)

        names = [f.split(" ")[0] for f in re.split(r", (?=[a-z_]+ )", MAIL)]
        for f in frames:
            yield pd.DataFrame([one(p, c) for p, c in zip(f["path"], f["content"])], columns=names)

    return files.mapInPandas(parse, MAIL)


def segments(result: DataFrame, column: str) -> DataFrame:
    """Rows of a transcription reply {segments: [{start, end, text}], text}; empty texts dropped, one 0-0 segment if there is none."""
    kind = "segments array<struct<start: double, end: double, text: string>>, text string"
    r = F.from_json(column, kind)
    some = F.filter(r["segments"], lambda s: F.trim(s["text"]) != "")
    whole = F.array(F.struct(F.lit(0.0).alias("start"), F.lit(0.0).alias("end"), r["text"].alias("text")))
    picked = F.when(F.coalesce(F.size(some), F.lit(0)) > 0, some).when(F.trim(r["text"]) != "", whole)
    return result.select("*", F.posexplode(picked).alias("at", "s")).select(*result.columns, "at", "s.*")


def numbered(df: DataFrame, by: list[str]) -> DataFrame:
    """Adds row: a stable ordinal by explicit columns, as partition order means nothing."""
    return df.withColumn("row", F.row_number().over(Window.orderBy(*by)))
