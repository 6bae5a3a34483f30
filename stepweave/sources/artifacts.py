"""Reading and writing of tasks, tool specs, prompts, model checkpoints, clusters, progress and task sets.

Files of a run's size (configs, prompts, specs) are read on the driver; tables are read and written by Spark. Writes
are whole-folder overwrites or appends, so a repeated attempt leaves the same files.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import lengths

TOOL_SPEC = "map<string,struct<type:string,actor:string,description:string,parameters:map<string,struct<type:string,description:string>>>>"


def tasks_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON array of tasks, as a whole file; bad records give nulls."""
    reader = spark.read.option("multiLine", True).option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).json(path)


def write_tasks_json(tasks: DataFrame, folder: str) -> None:
    """Tasks as JSON arrays, one whole array per file: each task writes its own, record by record."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = "["
        for b in batches:
            rows = b.column(0).to_pylist()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([before + rows[0], *("," + r for r in rows[1:])])], ["value"])
                before = ","
        yield pa.RecordBatch.from_arrays([pa.array(["]" if before == "," else "[]"])], ["value"])

    tasks.select(F.to_json(F.struct(*tasks.columns)).alias("value")).mapInArrow(lines, "value string").write.mode("overwrite").text(folder)


def text(spark: SparkSession, path: str) -> DataFrame:
    """(value): each file's whole text."""
    return spark.read.text(path, wholetext=True)


def tool_specs(spark: SparkSession, path: str) -> DataFrame:
    """(name, type, actor, description, params): type GENERIC and no parameters where they are absent; pos keeps the
    order of the file."""
    parsed = text(spark, path).select(F.from_json("value", TOOL_SPEC).alias("m"))
    rows = parsed.select(F.posexplode("m").alias("pos", "name", "s"))
    none = F.create_map().cast("map<string,struct<type:string,description:string>>")
    return rows.select("pos", "name", F.coalesce("s.type", F.lit("GENERIC")).alias("type"), "s.actor", "s.description", F.coalesce("s.parameters", none).alias("params"))


def domain_config(folder: str) -> dict:
    """domain.json of a domain's folder, empty if it has none; the folder must exist."""
    at = Path(folder)
    if not at.is_dir():
        raise FileNotFoundError(folder)
    f = at / "domain.json"
    return json.loads(f.read_text()) if f.exists() else {}


def domain_configs(spark: SparkSession, root: str) -> DataFrame:
    """(domain, config): the domain.json of each folder of root that has one, as text; on any file system."""
    files = spark.read.text(f"{root}/*/domain.json", wholetext=True)
    return files.select(F.regexp_extract(F.input_file_name(), r"/([^/]+)/domain\.json", 1).alias("domain"), F.col("value").alias("config"))


def prompt_sections(spark: SparkSession, path: str) -> DataFrame:
    """(file, section, body) of text files whose sections are each headed by a line ===NAME===; what stands before the first
    one is left out, bodies are trimmed. On any file system."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", r"(?m)^===(?=\w+===\s*$)").alias("parts"))
    each = files.select("file", F.explode(F.slice("parts", 2, F.greatest(F.size("parts"), F.lit(1)))).alias("p"))
    return each.select("file", F.regexp_extract("p", r"^(\w+)===", 1).alias("section"), F.regexp_replace(F.regexp_replace("p", r"^\w+===\s*", ""), r"\s+$", "").alias("body"))


def domains(root: str) -> list[str]:
    """The names of the folders that have a domain.json."""
    return sorted(p.parent.name for p in Path(root).glob("*/domain.json"))


def sections(path: str, required: list[str] = ()) -> dict[str, str]:
    """The sections of a text file, each headed by a line ===NAME===."""
    parts = re.split(r"(?m)^===(\w+)===\s*$", Path(path).read_text())
    out = {k: v.strip() for k, v in zip(parts[1::2], parts[2::2])}
    if gone := [r for r in required if r not in out]:
        raise ValueError(f"missing sections: {', '.join(gone)}")
    return out


class Prompts:
    """Texts by name: those of an override folder come before those of the base; files that aren't there are skipped."""

    def __init__(self, base: str, override: str | None = None):
        self.texts = {p.stem: p.read_text() for folder in (base, override) if folder for p in sorted(Path(folder).glob("*.txt"))}

    def get(self, name: str) -> str:
        return self.texts[name]


def find_tasks(where: str, root: str = ".") -> Path:
    """A tasks file by its path, its folder, or the name of a task set."""
    for p in (Path(where), Path(where) / "tasks.json", Path(root) / "task_sets" / where / "tasks.json"):
        if p.is_file():
            return p
    raise FileNotFoundError(where)


def write_counts(counts: DataFrame, ledger: DataFrame, folder: str, t: int) -> None:
    """A checkpoint of a model, as tables in the folder t=<t>."""
    counts.write.mode("overwrite").parquet(f"{folder}/counts/t={t}")
    ledger.write.mode("overwrite").parquet(f"{folder}/ledger/t={t}")


def read_counts(spark: SparkSession, folder: str, t: int) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/counts/t={t}"), spark.read.parquet(f"{folder}/ledger/t={t}")


def checkpoint_name(domain: str, n: int, t: int | None = None) -> str:
    return f"ngram_{domain}_n{n}_{'final' if t is None else f't{t}'}.json"


def checkpoint_json(spark: SparkSession, path: str, domain: str) -> DataFrame:
    """(domain, sign, ctx, token, w) of a JSON checkpoint, whose keys are JSON lists of a context and a token."""
    raw = text(spark, path).select(F.try_parse_json("value").alias("v"))
    parts = []
    for sign in ("pos", "neg"):
        entries = raw.select(F.explode(F.try_variant_get("v", f"$.model.counts.{sign}_ngram", "map<string,double>")).alias("k", "w"))
        key = F.try_parse_json("k")
        nested = F.try_variant_get(key, "$[0]", "array<string>")
        flat = F.try_variant_get(key, "$", "array<string>")
        ctx = F.when(F.schema_of_variant(F.try_variant_get(key, "$[0]", "variant")).startswith("ARRAY"), nested).otherwise(F.slice(flat, F.lit(1), F.size(flat) - 1))
        token = F.when(F.schema_of_variant(F.try_variant_get(key, "$[0]", "variant")).startswith("ARRAY"), F.try_variant_get(key, "$[1]", "string")).otherwise(F.element_at(flat, -1))
        parts.append(entries.select(F.lit(domain).alias("domain"), F.lit(sign).alias("sign"), ctx.alias("ctx"), token.alias("token"), "w"))
    return parts[0].unionByName(parts[1])


def write_checkpoint_json(counts: DataFrame, path: str, settings: dict) -> None:
    """The JSON checkpoint of one domain's counts, a folder that holds one file: the format wants a single document. One
    task writes it entry by entry in the order of signs, so that nothing is gathered in memory or on the driver."""
    entry = F.concat(F.to_json(F.struct(F.to_json(F.array_append("ctx", F.col("token"))).alias("k"))), F.lit("\t"), F.to_json(F.struct(F.col("w").alias("w")))).alias("e")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, first = None, True
        line = lambda *t: pa.RecordBatch.from_arrays([pa.array(t, pa.string())], ["value"])
        yield line('{"model": {"config": ' + json.dumps(settings) + ', "counts": {')
        for b in batches:
            out = []
            for sign, e in zip(b.column("sign").to_pylist(), b.column("e").to_pylist()):
                if sign != open_:
                    out.append(("" if open_ is None else "}, ") + f'"{sign}_ngram": {{')
                    open_, first = sign, True
                k, w = e.split("\t", 1)
                out.append(("" if first else ", ") + k[len('{"k":') : -1] + ": " + w[len('{"w":') : -1])
                first = False
            yield line(*out)
        yield line(("" if open_ is None else "}") + "}}}")

    counts.select("sign", entry).coalesce(1).sortWithinPartitions("sign").mapInArrow(write, "value string").write.mode("overwrite").text(path)


def write_clusters(clusters: DataFrame, folder: str) -> None:
    clusters.write.mode("overwrite").parquet(folder)


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append_progress(rows: DataFrame, folder: str) -> None:
    rows.write.mode("append").json(folder)


def read_progress(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Progress rows; lines that don't parse are dropped, and a missing folder has none."""
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(folder)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def completed(progress: DataFrame, key: str = "cluster_idx") -> DataFrame:
    return progress.where(F.col("success") & F.col(key).isNotNull()).select(key).distinct()


def write_task_set(tasks: DataFrame, folder: str, metadata: DataFrame) -> None:
    """Tasks without their ticket column, and the set's metadata."""
    tasks.drop("ticket").write.mode("overwrite").json(f"{folder}/tasks")
    metadata.write.mode("overwrite").json(f"{folder}/metadata")


def read_task_set(spark: SparkSession, folder: str, schema: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(tasks, metadata) of a set."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(f"{folder}/tasks"), spark.read.json(f"{folder}/metadata")


def generation_metadata(sequences: DataFrame, *by: str) -> DataFrame:
    """(by..., n_tasks, n_empty, median, std, low, high, p10, p90, histogram): what a run made, from sequences (by...,
    tokens); the histogram is a map from lengths to counts."""
    sized = sequences.select(*by, F.size("tokens").alias("length")).where("length >= 0")
    made = sized.groupBy(*by).agg(F.count(F.lit(1)).alias("n_tasks"), F.count_if(F.col("length") == 0).alias("n_empty"))
    stats = lengths.fit(sized, *by).drop("n")
    return made.join(stats, list(by)).join(lengths.histogram(sized, *by).withColumnRenamed("lengths", "histogram"), list(by))


def evolved_output(tasks: DataFrame, results: DataFrame, key: str = "task_id", position: str = "pos") -> DataFrame:
    """The tasks that results (key, evolved) has, in their order of input."""
    return tasks.join(results, key).orderBy(position)


def append_errors(errors: DataFrame, folder: str) -> None:
    """Error rows by step; nothing is ever wiped."""
    errors.write.mode("append").partitionBy("step").json(folder)


def failures(rows: DataFrame, step: str, key: str, message, **detail) -> DataFrame:
    """Rows of the failure log of a step: step, id (the key, with `_` for what a file name can't hold), message, and detail
    columns as JSON. Logs of assertions and of alignments are those of their steps."""
    body = F.to_json(F.struct(*(c.alias(n) for n, c in detail.items()))) if detail else F.lit("{}")
    return rows.select(F.lit(step).alias("step"), F.regexp_replace(F.col(key).cast("string"), "[^A-Za-z0-9_.-]", "_").alias("id"), message.alias("message"), body.alias("detail"))


def prompt_log(rows: DataFrame, run: str, order: str, prompt: str) -> DataFrame:
    """Rows of the prompt log, (step, run, n, prompt): the prompts of a run in its order, numbered from 1. Nothing is wiped:
    append_errors() adds them under the step `prompt`."""
    n = F.row_number().over(Window.partitionBy(run).orderBy(order))
    return rows.select(F.lit("prompt").alias("step"), F.col(run).alias("run"), n.alias("n"), F.col(prompt).alias("prompt"))
