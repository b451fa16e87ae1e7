"""From documents to chunks, and from extraction responses to entities and relations."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import hashed_id, is_float, mend_delimiters, normalized_name, sanitized_fields, split_markers, suffixed_id, without_complete
from graphloom.schema import COMPLETE, FIELD, NAME_LIMIT, SEP, UNKNOWN


def token_windows(docs: DataFrame, size: int, overlap: int, doc_id: str = "doc_id", text: str = "text", tokens: Column | None = None) -> DataFrame:
    """(doc_id, chunk_order_index, chunk_id, tokens, content): windows of size tokens that start every size - overlap,
    the last ones shorter. tokens: an array column; by default parts between single spaces. One pass, no shuffle."""
    words = F.split(F.trim(F.col(text)), " ") if tokens is None else tokens
    step = size - overlap
    each = docs.select(F.col(doc_id).alias("doc_id"), words.alias("words")).where(F.size("words") > 0)
    starts = each.select("doc_id", "words", F.posexplode(F.sequence(F.lit(0), F.size("words") - 1, F.lit(step))).alias("chunk_order_index", "start"))
    cut = F.slice("words", F.col("start") + 1, size)
    made = starts.select("doc_id", F.col("chunk_order_index").cast("bigint").alias("chunk_order_index"), F.size(cut).cast("bigint").alias("tokens"), F.trim(F.array_join(cut, " ")).alias("content"))
    return made.withColumn("chunk_id", hashed_id("chunk-", F.col("content")))


def windows_at(docs: DataFrame, mark: str, size: int, overlap: int, only: bool = False, doc_id: str = "doc_id", text: str = "text", tokenize: Callable[[Column], Column] | None = None, glue: str = " ") -> DataFrame:
    """Like token_windows(), but texts are cut at each mark first; parts of more than size tokens are cut into windows, unless only is
    set, and parts without tokens stay as empty chunks. tokenize makes arrays of tokens, which glue joins again, of an array
    of texts; by default parts between single spaces. Null texts have no chunks."""
    words = lambda p: F.when(F.trim(p) == "", F.array().cast("array<string>")).otherwise(F.split(F.trim(p), " "))
    chunk = lambda n, content: F.struct(n.cast("bigint").alias("tokens"), F.trim(content).alias("content"))

    def cut(part: Column) -> Column:
        whole = F.array(chunk(F.size(part["w"]), part["p"]))
        if only:
            return whole
        starts = F.sequence(F.lit(0), F.size(part["w"]) - 1, F.lit(size - overlap))
        return F.when(F.size(part["w"]) > size, F.transform(starts, lambda s: chunk(F.least(F.lit(size), F.size(part["w"]) - s), F.array_join(F.slice(part["w"], s + 1, size), glue)))).otherwise(whole)

    pieces = F.split(F.col(text), "\\Q" + mark + "\\E", -1)
    parts = F.zip_with(pieces, F.transform(pieces, words) if tokenize is None else tokenize(pieces), lambda p, w: F.struct(p.alias("p"), w.alias("w")))
    # an exploded array keeps the tokens from being made for each use
    each = docs.select(F.col(doc_id).alias("doc_id"), F.explode(F.array(parts)).alias("parts")).where("parts is not null")
    rows = each.select("doc_id", F.posexplode(F.flatten(F.transform("parts", cut))).alias("chunk_order_index", "c"))
    return rows.select("doc_id", F.col("chunk_order_index").cast("bigint").alias("chunk_order_index"), "c.tokens", "c.content", hashed_id("chunk-", F.col("c.content")).alias("chunk_id"))


def tokens_by(encode: Callable[[str], list[str]]) -> Callable[[Column], Column]:
    """A tokenizer on Python's side as a function of columns of text arrays; encode makes the pieces of a text."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda a: None if a is None else [list(encode(t)) for t in a])

    return F.pandas_udf(run, "array<array<string>>")


def flatten_json(text: Column) -> Column:
    """The top-level scalars of a JSON object joined by blanks, in order; text that isn't an object stays."""
    fields = F.from_json(text, "map<string,string>")
    scalars = F.filter(F.map_values(fields), lambda v: v.isNotNull() & ~v.rlike(r"^[\[{]"))
    return F.when(text.rlike(r"^\s*\{") & fields.isNotNull(), F.array_join(scalars, " ")).otherwise(text)


def _bodies(response: Column, kind: str) -> Column:
    """Bodies of the records of a kind: up to the next record on a new line, or the end (or the line end that ends the text)."""
    mark = FIELD.replace("|", r"\|")
    ends = ("\n", "\r", "\x85", "\u2028", "\u2029")
    ended = reduce(or_, [response.endswith(e) for e in ends])
    text = F.when(ended, F.regexp_replace(response, r"(?:\r\n|[\n\r\x{85}\x{2028}\x{2029}])\z", "")).otherwise(response)
    # by lines: a look-ahead at each character takes three times as long
    return F.regexp_extract_all(text, F.lit(rf"{kind}{mark}([^\n]*(?:\n(?!(?:entity|relation){mark})[^\n]*)*+)"), F.lit(1))


def _records(rows: DataFrame, kind: str, fields: int) -> DataFrame:
    """Bodies of at least so many fields. No array of fields is made: an expression over one would be computed for each use."""
    each = rows.select("doc_id", "pos", "file_path", "chunk_id", F.posexplode(_bodies(F.col("response"), kind)).alias("ord", "body"))
    return each.where(F.substring_index("body", FIELD, fields - 1) != F.col("body"))


def _field(n: int) -> Column:
    """The n-th field of a body, from 1; empty where there is none."""
    return F.trim(F.split_part("body", F.lit(FIELD), F.lit(n)))


def entities(rows: DataFrame) -> DataFrame:
    """Entities of responses(doc_id, pos, file_path, chunk_id, response); records of fewer than four fields are dropped."""
    return _records(rows, "entity", 4).select("doc_id", "pos", "ord", "file_path", "chunk_id", _field(1).alias("name"), _field(2).alias("dim1"), _field(3).alias("dim2"), without_complete(_field(4)).alias("description"))


def relations(rows: DataFrame) -> DataFrame:
    """Relations of responses; records of fewer than three fields are dropped."""
    return _records(rows, "relation", 3).select(
        "doc_id", "pos", "ord", "file_path", "chunk_id", _field(1).alias("src_name"), _field(2).alias("tgt_name"), _field(3).alias("keywords"),
        without_complete(_field(4)).alias("description"), F.lit(1.0).alias("weight"),
    )


def library_records(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of responses(doc_id, pos, file_path, chunk_id, response) in the general form: a line
    is a record, one that a marker glues to another counts as its own, damaged markers are mended, fields are cleaned. Entities have
    four fields, a name, a type without quotes, brackets, bars and slashes (kept in lower case without blanks) and a
    description; relations five, two ends that differ, and a weight where the last field is a number, else 1. Other
    records are dropped. Names are cut at NAME_LIMIT characters. Null and empty responses have none."""
    mark = "\\Q" + FIELD + "\\E"
    apart = F.regexp_replace(F.regexp_replace("response", f"{mark}entity{mark}", f"\nentity{FIELD}"), f"{mark}relation(?:ship)?{mark}", f"\nrelation{FIELD}")
    lines = split_markers(apart, "\n", COMPLETE, COMPLETE.lower())
    each = rows.select("doc_id", "pos", "file_path", "chunk_id", F.posexplode(lines).alias("ord", "line")).where(F.col("line").rlike("^(?:entity|relation)"))
    # exploded arrays of one keep what filters look at from being made for each look
    cut_up = each.select("doc_id", "pos", "ord", "file_path", "chunk_id", F.explode(F.array(split_markers(mend_delimiters(F.col("line")), FIELD))).alias("raw"))
    fields = cut_up.where("size(raw) in (4, 5)").withColumn("f", sanitized_fields(F.col("raw")))
    f = F.col("f")
    keep = ["doc_id", "pos", "ord", "file_path", "chunk_id"]
    name = lambda k: normalized_name(f[k], inner_quotes=True)
    made = lambda *columns: F.explode(F.array(F.struct(*columns))).alias("made")
    entities = fields.where(F.col("raw")[0].contains("entity") & (F.size("raw") == 4)).select(*keep, made(name(1).alias("name"), name(2).alias("kind"), normalized_name(f[3]).alias("description"))).select(*keep, "made.*")
    good = entities.where("name <> '' and trim(kind) <> '' and description <> ''").where(~F.col("kind").rlike(r"['()<>|/\\]"))
    number = F.translate(F.col("raw")[4], "\"'", "")
    relations = fields.where(F.col("raw")[0].contains("relation") & (F.size("raw") == 5)).select(
        *keep,
        made(
            name(1).alias("src_name"), name(2).alias("tgt_name"), F.replace(name(3), F.lit("，"), F.lit(",")).alias("keywords"), normalized_name(f[4]).alias("description"),
            F.when(is_float(number), number.cast("double")).otherwise(F.lit(1.0)).alias("weight"),
        ),
    ).select(*keep, "made.*")
    cut = lambda c: F.substring(c, 1, NAME_LIMIT).alias(c)
    linked = relations.where("src_name <> '' and tgt_name <> '' and src_name <> tgt_name")
    return good.select(*keep, cut("name"), F.lower(F.replace("kind", F.lit(" "), F.lit(""))).alias("kind"), "description"), linked.select(*keep, cut("src_name"), cut("tgt_name"), "keywords", "description", "weight")


def ordered(column: str, *by: str) -> Column:
    """The values of a column within a group in the order of by."""
    return F.transform(F.sort_array(F.collect_list(F.struct(*by, column))), lambda s: s[column])


def union_of_lists(lists: Column) -> Column:
    """The parts of all comma lists, each once, sorted, joined again."""
    parts = F.flatten(F.transform(lists, lambda x: F.transform(F.split(F.coalesce(x, F.lit("")), ","), lambda x: F.trim(x))))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(parts, lambda p: p != ""))), ",")


def append_unless_contained(descriptions: Column) -> Column:
    """Descriptions joined by the separator; one that what is there already contains as a substring is left out."""
    return F.aggregate(F.array_distinct(descriptions), F.lit(""), lambda s, d: F.when((d == "") | s.contains(d), s).when(s == "", d).otherwise(F.concat(s, F.lit(SEP), d)))


def merge_same_names(rows: DataFrame, *scope: str) -> DataFrame:
    """Entities of one name within a scope (chunk_id, or file_path) as one: types as a union, descriptions appended in order, sources each once."""
    named = rows.where("name is not null and name <> ''")
    # one list of whole rows: a list for each column is sorted and sent along once more
    lists = named.withColumn("\x01chunk", F.col("chunk_id")).groupBy(*scope, "name").agg(F.collect_list(F.struct("pos", "ord", "description", F.col("\x01chunk").alias("chunk"), "dim1", "dim2")).alias("rows"))
    of = lambda c: F.transform("rows", lambda r: r[c])
    in_order = lambda c: F.transform(F.sort_array(F.transform("rows", lambda r: F.struct(r["pos"].alias("pos"), r["ord"].alias("ord"), r[c].alias("v")))), lambda r: r["v"])
    return lists.select(*scope, "name", union_of_lists(of("dim1")).alias("dim1"), union_of_lists(of("dim2")).alias("dim2"), append_unless_contained(in_order("description")).alias("description"), F.array_join(F.array_distinct(in_order("chunk")), SEP).alias("source_id"))


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, in a stated order."""
    first = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("\x01n", F.row_number().over(first)).where("`\x01n` = 1").drop("\x01n")


def resolve_relations(rels: DataFrame, ents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) with ids: ends that a document's entities lack become entities of unknown type, described by the
    first relation that names them; relations without an end's name, or of documents without any entity, go; of
    relations between one pair the first stays."""
    known = ents.select("file_path", "name").distinct()
    some = known.select("file_path").distinct()
    named = rels.where("src_name <> '' and tgt_name <> ''")
    ends = named.select("file_path", "pos", "ord", "chunk_id", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("src_name").alias("name")), F.struct(F.lit(1).alias("side"), F.col("tgt_name").alias("name")))).alias("e"))
    # once for each name before they meet the known ones, which then go by the same keys
    once = ends.select("file_path", "pos", "ord", "chunk_id", "e.side", "e.name").groupBy("file_path", "name").agg(F.min_by("chunk_id", F.struct("pos", "ord", "side")).alias("source_id"))
    inferred = once.join(known, ["file_path", "name"], "left_anti").join(some, "file_path", "left_semi")
    made = inferred.select("file_path", "name", F.lit(UNKNOWN).alias("dim1"), F.lit(UNKNOWN).alias("dim2"), F.lit("").alias("description"), "source_id", F.lit("inferred").alias("data_source"))
    everything = ents.select("file_path", "name", "dim1", "dim2", "description", "source_id", F.lit("extracted").alias("data_source")).union(made)
    with_ids = everything.withColumn("entity_id", suffixed_id(F.col("name"), F.col("file_path")))
    # the id is a function of file and name, so that no join is needed to rewrite the ends
    linked = named.join(some, "file_path", "left_semi").select("file_path", "pos", "ord", "chunk_id", suffixed_id(F.col("src_name"), F.col("file_path")).alias("src_id"), suffixed_id(F.col("tgt_name"), F.col("file_path")).alias("tgt_id"), "keywords", "description")
    return with_ids, keep_first(linked, ["src_id", "tgt_id"], ["pos", "ord"])
