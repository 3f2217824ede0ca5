"""Chunking as DataFrame operators: built-in expressions where a format allows it, parsers in Arrow batches where not.

Output columns: path, ord, content, start_line, end_line, context, cues, category.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = "path string, ord int, content string, start_line int, end_line int, context string, cues array<string>, category string"
TYPES = {"py": "Python", "rs": "Rust", "ts": "TypeScript", "tsx": "TypeScript", "js": "JavaScript", "jsx": "JavaScript", "go": "Go", "html": "Html", "htm": "Html", "css": "Css", "php": "Php", "java": "Java", "md": "Markdown", "csv": "Csv", "json": "Json", "yaml": "Yaml", "yml": "Yaml", "xml": "Xml", "pdf": "Pdf", "docx": "Office", "xlsx": "Office", "pptx": "Office", "txt": "Text", "log": "Text"}
CATEGORIES = {**dict.fromkeys(["py", "rs", "ts", "tsx", "js", "jsx", "go", "css", "php", "java", "html", "htm"], "Code"), **dict.fromkeys(["csv", "json", "yaml", "yml", "xml", "xlsx"], "Structured")}


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./]+)$", 1)


def _choose(value: Column, table: dict[str, str]) -> Column:
    expr = None
    for k, v in table.items():
        expr = F.when(value == k, F.lit(v)) if expr is None else expr.when(value == k, F.lit(v))
    return expr


def detect_type(path: Column) -> Column:
    """Exports by name first, then the extension (as it is written); null where unknown."""
    low = F.lower(path)
    social = low.rlike("whatsapp|instagram|youtube") | (low.contains("chrome") & low.contains("history"))
    return F.when(social, F.lit("SocialExport")).otherwise(_choose(extension(path), TYPES))


def category(path: Column) -> Column:
    low = F.lower(path)
    return F.when(low.rlike("swagger|openapi"), F.lit("ApiSpec")).when(low.rlike("whatsapp|instagram|youtube"), F.lit("Conversation")).otherwise(F.coalesce(_choose(extension(path), CATEGORIES), F.lit("Prose")))


def _array(values: tuple, kind: pa.DataType) -> pa.Array:
    """Half characters, which escapes of JSON and YAML can make and UTF-8 can't hold, become U+FFFD."""
    whole = lambda v: v.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if isinstance(v, str) else [whole(x) for x in v] if isinstance(v, list) else v
    try:
        return pa.array(values, kind)
    except UnicodeEncodeError:
        return pa.array([whole(v) for v in values], kind)


def batched(rows: Iterable[tuple], schema: pa.Schema, most_rows: int = 2000, most_chars: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """``rows`` in Arrow batches of bounded rows and characters, so that a worker never holds what a whole input batch gives."""
    have, size = [], 0
    for r in rows:
        have.append(r)
        size += sum(len(v) if isinstance(v, str) else sum(map(len, v)) if isinstance(v, list) else 0 for v in r)
        if len(have) >= most_rows or size >= most_chars:
            yield pa.RecordBatch.from_arrays([_array(c, f.type) for c, f in zip(zip(*have), schema)], schema=schema)
            have, size = [], 0
    if have:
        yield pa.RecordBatch.from_arrays([_array(c, f.type) for c, f in zip(zip(*have), schema)], schema=schema)


def input_rows(batches: Iterable[pa.RecordBatch], step: int = 64) -> Iterator[tuple]:
    """Rows of Arrow batches as Python values, a few at a time."""
    for b in batches:
        for i in range(0, b.num_rows, step):
            yield from zip(*(c.to_pylist() for c in b.slice(i, step).columns))


def chunk_files(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """Chunks of files (path, content as text or bytes) by their type; a null path or content has none."""

    def run(batches):
        from recallgrid.sources.parsers import chunk

        types = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.string()]
        schema = pa.schema(list(zip([f.split()[0] for f in SCHEMA.split(", ")], types)))
        yield from batched(((p, i, *c) for p, x in input_rows(batches) if p is not None and x is not None for i, c in enumerate(chunk(p, x))), schema)

    return files.select(F.col(path_col), F.col(content_col)).mapInArrow(run, SCHEMA)


def read_files(spark, path: str, glob: str = "*", ignore: str | None = None, gitignore: list[str] | None = None) -> DataFrame:
    """(path, content) of a directory tree; hidden files, paths that match ``ignore`` and those that the lines of
    ``gitignore`` (relative to the tree) leave out are not read."""
    from recallgrid.sources.ignore import ignored

    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    f = f.where(~F.col("path").rlike(r"/\.[^/]+"))
    f = f.where(~F.col("path").rlike(ignore)) if ignore else f
    if gitignore:
        root = path.rstrip("/").split(":", 1)[-1].lstrip("/")
        f = f.where(~ignored(F.regexp_replace("path", "^[^:]+:/*" + "".join(f"\\{c}" if not c.isalnum() and c not in "/_" else c for c in root) + "/", ""), gitignore))
    return f.select("path", "content")


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"[^.!?\n]+(?:[.!?]+|\n|$)"), 0), lambda s: F.trim(s)), lambda s: s != "")


def text_windows(df: DataFrame, id_col: str, text_col: str, size: int = 3, step: int = 2, least: int = 50, most: int = 2000) -> DataFrame:
    """(id, win, content): windows of sentences; short texts are one window."""
    s = df.select(id_col, F.trim(text_col).alias("t"), sentences(F.col(text_col)).alias("s"))
    whole = (F.size("s") <= size) | (F.octet_length("t") < least)
    wins = F.transform(F.sequence(F.lit(0), F.size("s") - 1, F.lit(step)), lambda i: F.array_join(F.slice("s", i + 1, F.least(F.lit(size), F.size("s") - i)), " "))
    w = s.select(id_col, F.posexplode(F.when(whole, F.array("t")).otherwise(wins)).alias("win", "content"), whole.alias("whole"))
    return w.where((F.col("whole") & (F.col("content") != "")) | (~F.col("whole") & (F.octet_length("content") >= least))).select(id_col, "win", F.left("content", F.lit(most)).alias("content"))


def pack_sentences(df: DataFrame, id_col: str, text_col: str, least: int = 80, most: int = 500, count: int = 3) -> DataFrame:
    """(id, ord, content): sentences packed greedily, as a fold over the array."""
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"), F.lit(0).alias("n"))

    def step(acc, s):
        full = (acc["n"] > 0) & ((F.octet_length(acc["cur"]) + F.octet_length(s) + 2 > most) | (acc["n"] >= count))
        out = F.when(full & (F.octet_length(acc["cur"]) >= least), F.array_append(acc["out"], acc["cur"])).otherwise(acc["out"])
        cur = F.when(full | (acc["n"] == 0), s).otherwise(F.concat(acc["cur"], F.lit(" "), s))
        return F.struct(out.alias("out"), cur.alias("cur"), F.when(full, F.lit(1)).otherwise(acc["n"] + 1).alias("n"))

    def last(acc):
        return F.when((acc["n"] > 0) & (F.octet_length(acc["cur"]) >= least), F.array_append(acc["out"], acc["cur"])).otherwise(acc["out"])

    return df.select(id_col, F.posexplode(F.aggregate(sentences(F.col(text_col)), zero, step, last)).alias("ord", "content"))


def markdown_sections(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, section, header, start_line, end_line, content) by a running count of header lines."""
    line = df.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    w = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    s = line.withColumn("section", F.sum(F.when(F.col("line").startswith("#"), 1).otherwise(0)).over(w))
    g = s.groupBy(id_col, "section").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    body = F.trim(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit(" \n\t\r"))
    first = F.col("l")[0]["line"]
    head = F.when(first.startswith("#"), F.trim(F.regexp_replace(first, "^#+|#+$", ""))).otherwise(F.lit("root"))
    return g.select(id_col, F.col("section").cast("int").alias("section"), head.alias("header"), (F.col("l")[0]["pos"] + 1).alias("start_line"), (F.element_at("l", -1)["pos"] + 1).alias("end_line"), body.alias("content")).where("content <> ''")


def useful_cell(v: Column) -> Column:
    t = F.trim(v)
    digits = F.length(F.regexp_replace(t, "[^0-9]", ""))
    return (F.octet_length(t) > 3) & ~(t.contains("@") & t.contains(".")) & ~t.rlike(r"^[\d.,+\-\s]+$") & ~t.rlike("^[0-9a-fA-F-]{8,}$") & (digits <= 0.5 * F.length(t))


def table_rows(df: DataFrame, columns: list[str], id_col: str, name: str = "data") -> DataFrame:
    """(id, content, cues): rows of a read CSV (or any table) as chunks of their useful cells."""
    cells = F.filter(F.array(*[F.struct(F.lit(c).alias("name"), F.trim(F.col(c).cast("string")).alias("value")) for c in columns]), lambda c: useful_cell(c["value"]))
    t = df.select(id_col, cells.alias("c")).where(F.size("c") > 0)
    return t.select(id_col, F.array_join(F.transform("c", lambda c: c["value"]), " | ").alias("content"), F.concat(F.array(F.lit("type:csv_row"), F.lit(f"file:{name}")), F.transform("c", lambda c: F.concat(F.lit("column:"), c["name"]))).alias("cues"))


def json_entries(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, key, content): one row per key of a JSON object."""
    k = df.select(id_col, F.col(json_col).alias("j"), F.explode(F.json_object_keys(json_col)).alias("key"))
    return k.select(id_col, "key", F.concat(F.lit('"'), "key", F.lit('": '), F.coalesce(F.variant_get(F.try_parse_json("j"), F.lit("$"), "map<string,string>")[F.col("key")], F.lit("null"))).alias("content"))


def whatsapp_messages(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, ord, sender, day, content) of one-line messages."""
    p = r"^\[((?:\d\d?/){2}\d{2,4}),\s+\d\d?(?::\d\d){1,2}(?:\s*[AP]M)?\]\s+([^:]+):\s+(.*)$"
    line = df.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("ord", "line")).where(F.col("line").rlike(p))
    m = line.select(id_col, "ord", F.lower(F.replace(F.trim(F.regexp_extract("line", p, 2)), F.lit(" "), F.lit("_"))).alias("sender"), F.replace(F.regexp_extract("line", p, 1), F.lit("/"), F.lit("-")).alias("day"), F.trim(F.regexp_extract("line", p, 3)).alias("content"))
    return m.where((F.length("content") >= 3) & ~F.lower("content").contains("omitted"))
