"""Files of other shapes, with explicit schemas: JSON documents and lines, manifests, summaries, presets;
and sinks for reports, logs and published folders."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RUN = "video string, output_dir string, status string, inference_sec double, duration_sec double, num_chunks int, rtf double, num_responses int, error string"
QUESTION = "question_time string, answer_time string, question_text string, answer_text string, question_type string, is_interrupted string"


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document per file; a broken file gives a row with _corrupt_record."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """A JSON object per line; blank lines are passed over, a broken line is an error if ``strict``."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Items of a manifest: lines of objects, a list, or an object with a field ``items``."""
    lines = path.endswith((".jsonl", ".ndjson"))
    text = spark.read.text(path, wholetext=not lines).filter("trim(value) <> ''")
    listed = F.from_json("value", f"array<struct<{schema}>>")
    boxed = F.from_json("value", f"struct<items:array<struct<{schema}>>>")["items"]
    single = F.array(F.from_json("value", f"struct<{schema}>"))
    start = F.substring(F.ltrim("value"), 1, 1)
    items = F.when(start == "[", listed).when(boxed.isNotNull(), boxed).when(F.lit(lines), single).otherwise(F.raise_error(F.lit("neither lines, a list nor an object with items")))
    return text.select(F.posexplode(items).alias("position", "i")).select("position", "i.*")


def batch_summary(spark: SparkSession, path: str, keep_all: bool = False) -> DataFrame:
    """Runs of batch summaries; those that are ok, a missing status counting as such, or all."""
    runs = json_document(spark, path, f"total int, success int, results array<struct<{RUN}>>").select(F.explode("results").alias("r")).select("r.*")
    return runs if keep_all else runs.filter("coalesce(status, 'ok') = 'ok'")


def named_files(spark: SparkSession, folder: str, pattern: str, schema: str) -> DataFrame:
    """Documents of all files of a pattern, in any depth, with the file's name, by name."""
    return spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).json(folder).withColumn("file_name", F.col("_metadata.file_name")).orderBy("file_name")


def questions(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Annotated questions with both times; ``keys`` tell whose they are and are kept. Order by keys, q and a where
    an order is needed."""
    from cadenza.functions.scalars import clean_label, parse_time, to_bool

    out = rows.select(*keys, parse_time("question_time").alias("q"), parse_time("answer_time").alias("a"), F.coalesce("question_text", F.lit("")).alias("question_text"), F.coalesce("answer_text", F.lit("")).alias("answer_text"), clean_label("question_type", "unknown").alias("question_type"), to_bool("is_interrupted").alias("is_interrupted"))
    return out.filter("q IS NOT NULL AND a IS NOT NULL")


def conversation_answers(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Task annotations (conversations or answers) to one row per answer: ``keys``, question, answer time and text.

    The first user message is the question; knowledge that was inferred is put before it, in the
    conversation form alone; ``position`` is an answer's place in its document.
    """
    from cadenza.functions.scalars import parse_time, to_bool

    spoken = F.filter("conversations", lambda m: m["from"] == "assistant")
    asked = F.get(F.filter("conversations", lambda m: m["from"] == "user"), F.lit(0))
    talk = F.size(F.coalesce("conversations", F.array())) > 0
    knowledge = F.nullif(F.trim(F.coalesce("inferred_knowledge", F.lit(""))), F.lit(""))
    question = F.when(talk, F.concat_ws("\n\n", knowledge, asked["value"])).otherwise(F.col("question_text"))
    answers = F.when(talk, F.transform(spoken, lambda m: F.struct(m["timestamp"].alias("at"), m["value"].alias("text"), m["interrupted"].alias("cut")))).otherwise(F.transform("answers", lambda m: F.struct(m["answer_time"].alias("at"), m["answer_text"].alias("text"), F.coalesce(m["interrupted"], m["is_interrupted"]).alias("cut"))))
    time = F.coalesce(parse_time(F.when(talk, asked["timestamp"]).otherwise(F.col("question_time"))), F.lit(0.0))
    out = rows.select(*keys, time.alias("q"), question.alias("question_text"), F.posexplode(answers).alias("position", "x"))
    return out.select(*keys, "q", "question_text", "position", parse_time("x.at").alias("a"), F.col("x.text").alias("answer_text"), to_bool("x.cut").alias("is_interrupted")).filter("a IS NOT NULL")


def presets(spark: SparkSession, folder: str) -> DataFrame:
    """Presets of a folder of YAML files in their order, 999 where none is given; a small, local listing. Files that
    are no mapping are passed over."""
    import yaml

    rows = []
    for p in sorted(Path(folder).glob("*.y*ml")):
        fields = yaml.safe_load(p.read_text())
        if isinstance(fields, dict):
            rows.append((p.stem, str(fields.get("name") or p.stem), int(fields.get("order", 999))))
    return spark.createDataFrame(rows, "preset_id string, name string, `order` int").orderBy("order", "preset_id")


def listing(spark: SparkSession, folder: str, pattern: str = "*.mp4") -> DataFrame:
    """Paths, sizes and times of all files of a pattern, in any depth; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path", "length", "modificationTime")


def folder_sizes(files: DataFrame) -> DataFrame:
    return files.groupBy(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder")).agg(F.sum("length").alias("bytes"), F.min("modificationTime").alias("oldest"))


def write_report(df: DataFrame, path: str, columns: list[str]) -> None:
    """CSV of exactly these columns, whatever else the rows hold."""
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def append_log(df: DataFrame, path: str) -> None:
    """Progress rows added to a log of JSON lines."""
    df.write.mode("append").json(path)


def publish(df: DataFrame, path: str, marker: str = ".done") -> None:
    """Parquet that becomes visible as a whole: written beside its place and moved there once committed, what was
    there before moved aside first and removed last. An empty ``marker`` file inside says that it is complete."""
    spark = df.sparkSession
    place = path.rstrip("/")
    jvm = spark.sparkContext._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    files = at(place).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    staged, old = f"{place}.tmp", f"{place}.old"
    df.write.mode("overwrite").parquet(staged)
    files.create(at(f"{staged}/{marker}")).close()
    files.delete(at(old), True)
    if files.exists(at(place)) and not files.rename(at(place), at(old)):
        raise OSError(f"{place} could not be moved aside")
    if not files.rename(at(staged), at(place)):
        files.rename(at(old), at(place))
        raise OSError(f"{staged} could not be moved to {place}")
    files.delete(at(old), True)


def write_document(document: dict, path: str) -> None:
    """One JSON document, indented, in UTF-8, its folder made where there is none: for reports, which are small."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(json.dumps(document, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")


def append_rolling(lines: list[str], path: str, most_bytes: int = 5_000_000) -> None:
    """Lines added to a debug log of a bounded size: what would grow beyond ``most_bytes`` is put aside first, one
    older file being kept."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    text = "".join(f"{line}\n" for line in lines)
    if target.exists() and target.stat().st_size + len(text.encode()) > most_bytes:
        target.replace(target.with_name(target.name + ".1"))
    with target.open("a", encoding="utf-8") as f:
        f.write(text)


def markdown_report(title: str, *sections: tuple[str, DataFrame, list[str], list[str]]) -> str:
    """A report of tables, each with a heading, columns and order: for summaries, whose rows are few."""
    out = [f"# {title}", ""]
    for heading, df, columns, order in sections:
        out += [f"## {heading}", "", *(r["line"] for r in markdown_lines(df, columns, order).orderBy("position").toLocalIterator()), ""]
    return "\n".join(out)


def cached_verdicts(spark: SparkSession, path: str, keys: list[str], asked: DataFrame, judge: Callable[[DataFrame], DataFrame], refresh: bool = False) -> DataFrame:
    """``asked`` with a verdict from the cache at ``path`` (keys, verdict), or from ``judge`` where it has none. What the
    judge said is added to the cache, which is published as a whole; with ``refresh`` all is asked again. Rows the
    judge gives no verdict stay without one and are asked again the next time."""
    from cadenza.session import cut_lineage

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.select(*keys).schema) + ", verdict double"
    try:
        known = cut_lineage(spark.read.schema(kind).parquet(path))
    except AnalysisException:
        known = spark.createDataFrame([], kind)
    misses = asked.select(*keys).distinct() if refresh else asked.select(*keys).distinct().join(known, keys, "left_anti")
    said = cut_lineage(judge(misses).select(*keys, "verdict").filter("verdict IS NOT NULL"))
    every = cut_lineage(said.unionByName(known.join(said, keys, "left_anti")))
    publish(every, path)
    return asked.join(every, keys, "left")


def redacted(payload: Column) -> Column:
    """A payload's length in place of the payload."""
    return F.concat(F.lit("<"), F.length(payload).cast("string"), F.lit(" b64 chars>"))


def markdown_lines(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """A Markdown table as rows (position, line); reports are small."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))
    body = df.select((F.row_number().over(Window.partitionBy().orderBy(*order)) + 1).alias("position"), line.alias("line"))
    head = df.sparkSession.createDataFrame([(0, "| " + " | ".join(columns) + " |"), (1, "|" + "---|" * len(columns))], "position int, line string")
    return head.unionByName(body)
