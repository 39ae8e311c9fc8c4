"""Readers of lexica, word lists, triple files, inventories and saved query results.

All of them are read with built-in sources and expressions. Defined cases: blank lines are passed
over; values that are no numbers become null; of repeated lexicon words the last line counts.
"""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuswerk.operators.wordclass import dense_ids
from corpuswerk.plans.storage import materialized


def emotion_words(spark: SparkSession, path: str) -> DataFrame:
    """(word, kind): one file an emotion, named after it; its words in lower case."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/.]+)[^/]*$", 1).alias("kind"), "value")
    return files.select(F.explode(F.filter(F.split(F.lower("value"), r"\s+"), lambda w: w != "")).alias("word"), "kind").distinct()


def polarity_words(lines: DataFrame, kind: str, containing: list[str] | None = None) -> DataFrame:
    """(word, kind, value) of lines (line_no, value) `lemma|TAG number form,form`: the lemma and each form with the number."""
    cells = F.split(F.lower(F.trim("value")), r"\s+")
    each = lines.select("line_no", cells.alias("c")).filter("c[0] <> ''").withColumn("lemma", F.split(F.col("c")[0], r"\|")[0])
    if containing:
        each = each.filter(F.greatest(*[F.contains(F.col("c")[0], F.lit(x)).cast("int") for x in containing], F.lit(0)) == 1)
    forms = F.concat(F.array("lemma"), F.filter(F.split(F.coalesce(F.get("c", F.lit(2)), F.lit("")), ","), lambda w: w != ""))
    rows = each.select("line_no", F.explode(forms).alias("word"), F.get("c", F.lit(1)).try_cast("double").alias("value"))
    return rows.groupBy("word").agg(F.max_by("value", "line_no").alias("value")).select("word", F.lit(kind).alias("kind"), "value")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of one small file, in order."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "value"))


def amended(lexicon: DataFrame, added: dict[str, float], removed: list[str], kind: str) -> DataFrame:
    """A lexicon with words put in, replacing those there, and others taken out."""
    spark = lexicon.sparkSession
    extra = spark.createDataFrame([(w, kind, float(v)) for w, v in added.items()], "word string, kind string, value double")
    rest = lexicon.filter(~F.col("word").isin([*added, *removed]))
    return rest.unionByName(extra.filter(~F.col("word").isin(removed)) if removed else extra)


def stop_words(spark: SparkSession, own: list[str] = (), path: str | None = None, language: str = "german") -> DataFrame:
    """(word): given words, those of a JSON list in a file, and the language's default words, in lower case."""
    words = spark.createDataFrame([(w.lower(),) for w in [*own, *StopWordsRemover.loadDefaultStopWords(language)]], "word string")
    if path:
        listed = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("word"))
        words = words.unionByName(listed.select(F.lower("word").alias("word")))
    return words.distinct()


def triples(lines: DataFrame) -> DataFrame:
    """(verb, subj, obj) and the other columns of lines (value) `verb;['a', 'b'];['c']`; what is no list is a list of one."""
    parts = F.split("value", ";")
    bare = lambda c: F.split(F.replace(F.regexp_replace(c, r"^\[|\]$", ""), F.lit("'"), F.lit("")), ",")
    listed = lambda c: F.filter(F.transform(bare(c), lambda w: F.trim(w)), lambda w: w != "")
    others = [c for c in lines.columns if c != "value"]
    return lines.filter(F.size(parts) >= 3).select(*others, parts[0].alias("verb"), listed(parts[1]).alias("subj"), listed(parts[2]).alias("obj"))


def read_triples(spark: SparkSession, folder: str, sources: list[str]) -> DataFrame:
    """(source, verb, subj, obj) of the files svo_triplets_<source> of a folder."""
    lines = spark.read.text([f"{folder}/svo_triplets_{s}" for s in sources])
    return triples(lines.select(F.regexp_extract(F.input_file_name(), r"svo_triplets_([^/]+)$", 1).alias("source"), "value"))


def path_parts(files: DataFrame, path: str = "path", prefix: str = "", pattern: str = r"^([^/]+)/([^_/]+)_(\d{8})") -> DataFrame:
    """Adds main, source, date and year of a path without its prefix; parts that aren't there are null."""
    rest = F.regexp_replace(path, f"^{prefix}", "") if prefix else F.col(path)
    part = lambda n: F.nullif(F.regexp_extract(rest, pattern, n), F.lit(""))
    date = F.try_to_date(part(3), "yyyyMMdd")
    return files.withColumns({"main": part(1), "source": part(2), "date": date, "year": F.year(date)})


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, mtime) of all files below a folder, without reading them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def slices(files: DataFrame, size: int, order: list[str]) -> DataFrame:
    """Adds batch: files numbered in order, size of them a batch."""
    numbered = dense_ids(files, order, "place")
    return numbered.withColumn("batch", F.floor(F.col("place") / size))


def bindings(spark: SparkSession, path: str) -> DataFrame:
    """One row of strings a binding of saved query results {"results": {"bindings": [{var: {"value": ..}}]}}."""
    rows = spark.read.json(path, multiLine=True).select(F.explode("results.bindings").alias("b"))
    names = [f.name for f in rows.schema["b"].dataType.fields]
    return rows.select(*[F.col(f"b.{n}.value").alias(n) for n in names])


def page_views(spark: SparkSession, path: str) -> DataFrame:
    """(views): the list of monthly views of saved replies {"items": [{"views": n}]}."""
    return spark.read.json(path, multiLine=True).select(F.transform("items", lambda x: x["views"].cast("bigint")).alias("views"))


def value_sets(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """(key, columns): the distinct values of each column of a key, sorted."""
    return rows.groupBy(key).agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in columns])


def joined_values(rows: DataFrame, key: str, column: str, sep: str = ";") -> DataFrame:
    """(key, column, n): the distinct values as one string, and how many there are."""
    return rows.groupBy(key).agg(F.array_join(F.sort_array(F.collect_set(column)), sep).alias(column), F.count_distinct(column).alias("n"))


def subclasses(statements: DataFrame, roots: list[str], relation: str = "P279") -> DataFrame:
    """(class): the classes below the roots, of any depth, over (s, p, o) statements; cycles end.

    Rounds of a join and an anti-join, each a written table; a recursive query would keep repeated rows.
    """
    up = statements.filter(F.col("p") == relation).select(F.col("s").alias("child"), F.col("o").alias("class"))
    found = frontier = materialized(statements.sparkSession.createDataFrame([(r,) for r in roots], "class string").distinct(), "classes")
    while True:
        step = up.join(frontier, "class").select(F.col("child").alias("class")).distinct().join(found, "class", "left_anti")
        frontier = materialized(step, "classes")
        if frontier.isEmpty():
            return found
        found = found.unionByName(frontier)


def typed_entities(statements: DataFrame, types: dict[str, list[str]], instance: str = "P31", relation: str = "P279") -> DataFrame:
    """(s, type): entities that are instances of a class below the roots of a type; an entity may have several."""
    out = None
    for name, roots in types.items():
        below = subclasses(statements, roots, relation).withColumnRenamed("class", "o")
        own = statements.filter(F.col("p") == instance).join(below, "o", "left_semi").select("s", F.lit(name).alias("type")).distinct()
        out = own if out is None else out.unionByName(own)
    return out


def entity_records(statements: DataFrame, label: str, properties: dict[str, str]) -> DataFrame:
    """(s, label, one sorted list a property): entities with a label; a property that isn't there is an empty list."""
    sets = [F.sort_array(F.collect_set(F.when(F.col("p") == p, F.col("o")))).alias(name) for name, p in properties.items()]
    named = F.max(F.when(F.col("p") == label, F.col("o"))).alias("label")
    return statements.groupBy("s").agg(named, *sets).filter("label is not null")


def total_views(views: str | Column) -> Column:
    """Sum of a list of views; null counts for nothing."""
    views = F.col(views) if isinstance(views, str) else views
    return F.aggregate(F.coalesce(views, F.array().cast("array<bigint>")), F.lit(0).cast("bigint"), lambda s, x: s + F.coalesce(x, F.lit(0)))
