"""Readers: text files, OBO, brat, Knowtator XML, WebAnno, JSON questions and N-Triples, all through Spark's sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from conceptflow.functions.text import curie


def discover(spark: SparkSession, root: str, suffixes: tuple[str, ...] = ("pdf", "txt", "text", "md")) -> DataFrame:
    """(path, content) of files with one of the suffixes, in any case, below ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.where(F.lower("path").rlike(rf"\.(?:{'|'.join(suffixes)})$")).select("path", "content")


def plain_text(files: DataFrame) -> DataFrame:
    """(path, text) from (path, content)."""
    return files.select("path", F.decode("content", "UTF-8").alias("text"))


def paragraphs(texts: DataFrame, key: str) -> DataFrame:
    """(key, ordinal, start, stop, text): parts between blank lines, trimmed, with their places in the text."""
    parts = F.split("text", r"\n[ \t]*\n")
    gaps = F.regexp_extract_all("text", F.lit(r"(\n[ \t]*\n)"), 1)
    state = F.aggregate(
        F.arrays_zip(parts.alias("part"), gaps.alias("gap")),
        F.expr("named_struct('at', 0, 'out', cast(array() as array<struct<start: int, part: string>>))"),
        lambda s, x: F.struct(
            (s["at"] + F.length(x["part"]) + F.coalesce(F.length(x["gap"]), F.lit(0))).alias("at"),
            F.concat(s["out"], F.array(F.struct(s["at"].alias("start"), x["part"].alias("part")))).alias("out"),
        ),
        lambda s: s["out"],
    )
    rows = texts.select(key, F.posexplode(state).alias("ordinal", "x"))
    lead = F.length(F.regexp_extract(F.col("x.part"), r"^(\s*)", 1))
    body = F.regexp_replace(F.col("x.part"), r"^\s+|\s+$", "")
    found = rows.select(key, "ordinal", (F.col("x.start") + lead).alias("start"), body.alias("text")).where("text <> ''")
    return found.withColumn("stop", F.col("start") + F.length("text"))


def obo(spark: SparkSession, path: str) -> DataFrame:
    """(iri, label, gloss, alt_labels) of terms that aren't obsolete."""
    stanzas = spark.read.text(path, lineSep="\n[").where("value like 'Term]%' and value not like '%\nis_obsolete: true%'")
    line = lambda tag: F.nullif(F.regexp_extract("value", rf"(?m)^{tag}: (.*)$", 1), F.lit(""))
    quoted = F.nullif(F.regexp_extract("value", r'(?m)^def: "((?:[^"\\]|\\.)*)"', 1), F.lit(""))
    return stanzas.select(line("id").alias("iri"), line("name").alias("label"), quoted.alias("gloss"), F.regexp_extract_all("value", F.lit(r'(?m)^synonym: "((?:[^"\\]|\\.)*)"'), 1).alias("alt_labels")).where("iri is not null and label is not null")


def brat(spark: SparkSession, path: str) -> DataFrame:
    """(id, iri, start, stop, text) of text-bound lines; discontinuous spans are left out."""
    parts = spark.read.text(path).where("value like 'T%'").select(F.split("value", "\t").alias("c"))
    place = F.split(F.col("c")[1], " ")
    found = parts.where(~F.col("c")[1].contains(";")).select(F.col("c")[0].alias("id"), place[0].alias("iri"), place[1].cast("int").alias("start"), place[2].cast("int").alias("stop"), F.col("c")[2].alias("text"))
    return found


def knowtator(spark: SparkSession, path: str) -> DataFrame:
    """(id, iri, start, stop, text): annotations joined to their class mentions by id; one span each."""
    notes = spark.read.format("xml").option("rowTag", "annotation").schema("mention struct<_id: string>, span array<struct<_start: int, _end: int>>, spannedText string").load(path)
    classes = spark.read.format("xml").option("rowTag", "classMention").schema("_id string, mentionClass struct<_id: string, _VALUE: string>").load(path)
    notes = notes.where(F.size("span") == 1).select(F.col("mention._id").alias("id"), F.col("span")[0]["_start"].alias("start"), F.col("span")[0]["_end"].alias("stop"), F.col("spannedText").alias("text"))
    return notes.join(classes.select(F.col("_id").alias("id"), F.col("mentionClass._id").alias("iri")), "id").select("id", "iri", "start", "stop", "text")


def webanno(spark: SparkSession, path: str) -> DataFrame:
    """(file, iri, start, stop): token rows of one annotation group merged to a span."""
    rows = spark.read.text(path).select(F.input_file_name().alias("file"), F.split("value", "\t").alias("c")).where(F.size("c") >= 4)
    place = F.split(F.col("c")[1], "-")
    tagged = rows.where(F.col("c")[3] != "_").select("file", F.col("c")[0].alias("token"), place[0].cast("int").alias("start"), place[1].cast("int").alias("stop"), F.explode(F.split(F.col("c")[3], r"\|")).alias("tag"))
    group = F.coalesce(F.nullif(F.regexp_extract("tag", r"\[(\d+)\]$", 1), F.lit("")), F.col("token"))
    named = tagged.select("file", group.alias("g"), F.regexp_replace("tag", r"\[\d+\]$", "").alias("iri"), "start", "stop")
    return named.groupBy("file", "g", "iri").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("g")


def knowtator_skipped(spark: SparkSession, path: str) -> int:
    """How many annotations are left out because their spans are discontinuous or missing."""
    notes = spark.read.format("xml").option("rowTag", "annotation").schema("mention struct<_id: string>, span array<struct<_start: int, _end: int>>").load(path)
    return notes.where(F.coalesce(F.size("span"), F.lit(0)) != 1).count()


def webanno_text(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): documents rebuilt from their tokens' places; gaps are blanks, and a gap before a new sentence is a line end or two."""
    rows = spark.read.text(path).select(F.input_file_name().alias("file"), F.split("value", "\t").alias("c")).where(F.size("c") >= 3)
    place = F.split(F.col("c")[1], "-")
    tokens = rows.select("file", F.split(F.col("c")[0], "-")[0].cast("int").alias("sentence"), place[0].cast("int").alias("start"), place[1].cast("int").alias("stop"), F.col("c")[2].alias("token")).where("start is not null")
    order = Window.partitionBy("file").orderBy("start")
    before = F.coalesce(F.lag("stop").over(order), F.lit(0))
    gap = F.greatest(F.col("start") - before, F.lit(0))
    ends = F.when(F.lag("sentence").over(order) != F.col("sentence"), F.least(gap, F.lit(2))).otherwise(0)
    size = F.col("stop") - F.col("start")
    piece = F.concat(F.repeat(F.lit(" "), (gap - ends).cast("int")), F.repeat(F.lit("\n"), ends.cast("int")), F.rpad("token", size, " "))
    pieces = tokens.select("file", "start", piece.alias("piece"))
    return pieces.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "piece"))), lambda x: x["piece"]), "").alias("text"))


def curies(inventory: DataFrame) -> DataFrame:
    """``inventory`` with iris as CURIEs where their last part reads PREFIX_digits."""
    return inventory.withColumn("iri", curie(F.col("iri")))


#: Readers of annotations by format.
READERS = {"knowtator": knowtator, "brat": brat, "webanno": webanno}
RETENTION = "doc_id string, markdown_hash string, mentions array<struct<id: string, page: int, span: array<int>, text: string, gold_class: string, in_inventory: boolean, entity_id: string>>, relations array<struct<subject: string, predicate: string, object: string, evidence_page: int>>"
QUESTIONS = "id string, question string, type string, language string, origin string, sparql string"


def retention(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RETENTION).json(path)


def questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUESTIONS).option("multiLine", True).json(path)


def ntriples(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o) of N-Triples lines, terms as written."""
    line = r"^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(.*?)\s*\.\s*$"
    rows = spark.read.text(path).where(F.col("value").rlike(line))
    return rows.select(*[F.regexp_extract("value", line, k).alias(c) for k, c in ((1, "s"), (2, "p"), (3, "o"))])


def first_definition(parts: list[DataFrame]) -> DataFrame:
    """Union of inventories (iri, ...): the first that defines an iri wins."""
    ranked = None
    for k, part in enumerate(parts):
        own = part.withColumn("_k", F.lit(k))
        ranked = own if ranked is None else ranked.unionByName(own, allowMissingColumns=True)
    best = ranked.groupBy("iri").agg(F.min("_k").alias("_k"))
    return ranked.join(best, ["iri", "_k"]).dropDuplicates(["iri"]).drop("_k")
