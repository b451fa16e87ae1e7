"""Documents from files, folders, JSON and JSON lines; tables from exported JSON; exports."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.vectors import decode_float32, encode_float32

SUFFIXES = ("md", "txt", "html", "json", "jsonl")


def _from_gbk(content: Column) -> Column:
    """Bytes that aren't UTF-8, as GBK; what isn't that either is marked as U+FFFD, so that no file is lost."""

    def decode(some):
        return some.map(lambda b: None if b is None else bytes(b).decode("gbk", "replace"))

    return F.pandas_udf(decode, "string", F.PandasUDFType.SCALAR)(content)


def folder(spark: SparkSession, path: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(file_path, text) of all files below a folder with one of the suffixes, one text for a file, in UTF-8 or else GBK; blank ones are dropped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").load(path)
    other = _from_gbk(F.when(~F.expr("is_valid_utf8(content)"), F.col("content")))
    text = F.when(F.expr("is_valid_utf8(content)"), F.col("content").cast("string")).otherwise(other)
    return files.select(F.col("path").alias("file_path"), F.coalesce(text, F.lit("")).alias("text")).where(F.trim("text") != "")


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, text): a document for each line that parses as JSON."""
    rows = spark.read.text(path).select(F.input_file_name().alias("file_path"), F.col("value").alias("text"))
    return rows.where((F.trim("text") != "") & F.try_parse_json("text").isNotNull())


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, text): one document for each file; blank ones are dropped."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file_path"), F.col("value").alias("text")).where(F.trim("text") != "")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """By kind of path: .jsonl by lines, other files as one, folders recursively."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(fs_path):
        raise FileNotFoundError(path)
    if fs.getFileStatus(fs_path).isDirectory():
        return folder(spark, path)
    return json_lines(spark, path) if os.path.splitext(path)[1] == ".jsonl" else whole_files(spark, path)


def chunk_map(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of a JSON file that maps ids to them."""
    kind = "map<string,struct<chunk_id:string,content:string,tokens:bigint,chunk_order_index:bigint,full_doc_id:string,file_path:string>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("id", "c"))
    return rows.select(F.coalesce("c.chunk_id", "id").alias("chunk_id"), "c.content", "c.tokens", "c.chunk_order_index", "c.full_doc_id", "c.file_path")


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON file that lists them, or of a folder of JSON lines."""
    return spark.read.schema(schema).json(path, multiLine=not _in_lines(spark, path))


_CHUNK = "chunk_id:string,content:string,tokens:bigint,chunk_order_index:bigint,full_doc_id:string,file_path:string"
RESULTS = {
    "entities": "entity_id string, entity_name string, dim1 string, dim2 string, description string, source_id string, file_path string, embedding string",
    "relations": "src_id string, tgt_id string, keywords string, description string, weight double, source_id string, file_path string",
}


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _in_lines(spark: SparkSession, path: str) -> bool:
    """Whether a path is a folder of lines, as exports are, and not one file."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def _decoded(entities: DataFrame) -> DataFrame:
    """Entities with their base64 vectors as arrays."""
    return entities.withColumn("embedding", decode_float32("embedding"))


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of a JSON file that lists them or maps ids to them; one in a list without an id has its place as id."""
    rows = spark.read.text(path, wholetext=not _in_lines(spark, path)).withColumn("listed", F.from_json("value", f"array<struct<{_CHUNK}>>"))
    listed = rows.where(F.col("value").rlike(r"^\s*\[")).select(F.posexplode("listed").alias("id", "c"))
    mapped = rows.where(F.col("value").rlike(r"^\s*\{")).select(F.explode(F.from_json("value", f"map<string,struct<{_CHUNK}>>")).alias("id", "c"))
    both = listed.withColumn("id", F.col("id").cast("string")).union(mapped)
    return both.select(F.coalesce("c.chunk_id", "id").alias("chunk_id"), "c.content", "c.tokens", "c.chunk_order_index", "c.full_doc_id", "c.file_path")


def load_results(spark: SparkSession, entities: str, relations: str | None = None, chunks: str | None = None) -> dict[str, DataFrame]:
    """entities, relations and chunks of an extraction's JSON files. The entities' file must exist; relations are empty without
    theirs; chunks default to chunks.json beside the entities."""
    if not _exists(spark, entities):
        raise FileNotFoundError(entities)
    beside = chunks or f"{os.path.dirname(entities)}/chunks.json"
    return {
        "entities": _decoded(json_array(spark, entities, RESULTS["entities"])),
        "relations": json_array(spark, relations, RESULTS["relations"]) if relations and _exists(spark, relations) else spark.createDataFrame([], RESULTS["relations"]),
        "chunks": _chunks(spark, beside) if _exists(spark, beside) else spark.createDataFrame([], _CHUNK.replace(":", " ")),
    }


def load_merged(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a folder of merged data; a file that isn't there counts as empty, rows that don't parse are left out."""
    rows = {}
    for name, key in (("entities", "entity_id"), ("relations", "src_id")):
        file = f"{path}/processed_{name}.json"
        rows[name] = json_array(spark, file, RESULTS[name]).where(F.col(key).isNotNull()) if _exists(spark, file) else spark.createDataFrame([], RESULTS[name])
    backup = f"{path}/chunks_backup.json"
    chunks = _chunks(spark, backup) if _exists(spark, backup) else spark.createDataFrame([], _CHUNK.replace(":", " "))
    return {"entities": _decoded(rows["entities"]), "relations": rows["relations"], "chunks": chunks}


def write_merged(tables: dict[str, DataFrame], path: str) -> None:
    """Entities (vectors as base64), relations and chunks as folders of JSON lines, under the names that load_merged() reads."""
    encoded = tables["entities"].withColumn("embedding", encode_float32("embedding"))
    for name, df in (("processed_entities", encoded), ("processed_relations", tables["relations"]), ("chunks_backup", tables["chunks"].select(F.to_json(F.map_from_arrays(F.array("chunk_id"), F.array(F.struct(*tables["chunks"].columns)))).alias("value")))):
        writer = df.write.mode("overwrite")
        writer.text(f"{path}/{name}.json") if name == "chunks_backup" else writer.json(f"{path}/{name}.json")


def new_files(spark: SparkSession, path: str, known: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(file_path, length, modified) of files right in a folder, with one of the suffixes, that known(file_path) lacks."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").load(path)
    return files.select(F.col("path").alias("file_path"), "length", F.col("modificationTime").alias("modified")).join(known.select("file_path"), "file_path", "left_anti")


def evaluation_cases(spark: SparkSession, path: str) -> DataFrame:
    """(number, question, ground_truth, project) of a JSON file's test_cases, in their order."""
    cases = F.from_json(F.get_json_object("value", "$.test_cases"), "array<struct<question:string,ground_truth:string,project:string>>")
    return spark.read.text(path, wholetext=True).select(F.posexplode(cases).alias("number", "c")).select((F.col("number") + 1).cast("bigint").alias("number"), "c.*")


def export(df: DataFrame, path: str, kind: str) -> None:
    """csv, json, parquet, md (a table row a line) or txt (tab-separated); every part file of a folder."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]
    match kind:
        case "csv":
            df.write.mode("overwrite").csv(path, header=True, escape='"')
        case "json":
            df.write.mode("overwrite").json(path)
        case "parquet":
            df.write.mode("overwrite").parquet(path)
        case "md":
            df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.replace(c, F.lit("|"), F.lit("\\|")) for c in cells]), F.lit(" |")).alias("value")).write.mode("overwrite").text(path)
        case "txt":
            df.select(F.concat_ws("\t", *cells).alias("value")).write.mode("overwrite").text(path)
        case _:
            raise ValueError(kind)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """nodes and edges as Parquet, by the type of node and by keyword."""
    nodes.write.mode("overwrite").partitionBy("dim1").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("keywords").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
