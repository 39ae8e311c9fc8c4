"""Rows of delimited files that fail to parse, and the valid ones with types.

Columns, rules and types are parameters, by default those of vertical files. Cells are exploded into (line, column, value), joined to a rule table and the failures are
aggregated; the valid rows are what an anti-join with the failures leaves.

Defined cases: a null or blank line is neither valid nor failing; markup fails only on an odd
number of quotes and is never a typed row; repeated line ids are judged line by line (the key
is the pair of id and text); other columns of the input are ignored; an empty table gives two
empty results; a line of any length is cut into cells without recursion.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The columns of a token row, in file order.
COLUMNS = ["word", "lc", "ix", "posUDS", "posTT", "ner", "iob", "ixNP", "dep", "ixDEP", "neg", "lemma", "pos", "posTI", "lempos", "lemmasource"]


@dataclass(frozen=True)
class Rule:
    """What a column's value must match; with fits_int a whole number that also fits an int."""

    column: str
    reason: str
    pattern: str
    fits_int: bool = False


# Rules in the order in which the first that fails is reported, and the columns with a type.
RULES = [Rule("ixDEP", "ixdep", r"\A0*[0-9]{1,10}\z", True), Rule("ixNP", "ixnp", r"\A([0-9]+([.][0-9]+)?)?\z"), Rule("ner", "ner", r"\A(PER|LOC|ORG|MISC)?\z")]
TYPES = {"ix": "int", "ixDEP": "int", "ixNP": "double"}
INT_MAX = 2147483647
CELL = r'\t("[^"]*+(?:""[^"]*+)*+"(?=\t|\z)|[^\t]*+)'
QUOTED = r'(?s)\A".*"\z'


@dataclass(frozen=True)
class Checked:
    failing: DataFrame
    valid: DataFrame


def _cells(line: Column) -> Column:
    # A TAB in front: then no match is empty, and an empty first cell isn't skipped over.
    return F.regexp_extract_all(F.concat(F.lit("\t"), line), F.lit(CELL), F.lit(1))


def _well_quoted(cell: Column) -> Column:
    """Quoted as a whole with inner quotes doubled, or without any quote."""
    inner = F.replace(F.substring(cell, 2, F.length(cell) - F.lit(2)), F.lit('""'), F.lit(""))
    whole = (F.length(cell) >= 2) & cell.rlike(QUOTED) & ~F.contains(inner, F.lit('"'))
    return whole | ~F.contains(cell, F.lit('"'))


def _value(cell: Column) -> Column:
    quoted = (F.length(cell) >= 2) & F.startswith(cell, F.lit('"'))
    return F.when(quoted, F.replace(F.substring(cell, 2, F.length(cell) - F.lit(2)), F.lit('""'), F.lit('"'))).otherwise(cell)


def check_rows(lines: DataFrame, id_col: str = "line_id", line_col: str = "raw_line", columns: list[str] = COLUMNS, rules: list[Rule] = RULES, types: dict[str, str] = TYPES) -> Checked:
    """failing (line_id, reason) and valid (line_id, columns); quoting is judged first, then the number of columns, then the rules in their order."""
    spark = lines.sparkSession
    line = F.col("line")
    base = lines.select(F.col(id_col).alias("line_id"), F.col(line_col).alias("line")).filter(line.isNotNull() & line.rlike(r"\S"))
    markup = F.startswith(line, F.lit("<")) & F.endswith(line, F.lit(">"))
    base = base.withColumn("markup", markup).withColumn("key", F.xxhash64("line"))
    odd = (F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))) % 2 == 1
    bad_markup = base.filter("markup").filter(odd).select("line_id", "key", F.lit("quoting").alias("reason"), F.lit(0).alias("rank"))

    rows = base.filter("not markup").select("line_id", "key", _cells(line).alias("cells"))
    rows = rows.withColumn("n", F.size("cells"))
    # Rule table: one row per check of a column.
    table = spark.createDataFrame([(columns.index(r.column), 2 + k) for k, r in enumerate(rules)], "col int, rank int")
    cells = rows.select("line_id", "key", "n", F.posexplode("cells").alias("col", "cell"))
    judged = cells.join(F.broadcast(table), "col", "left")  # a row a rule
    value = _value(F.col("cell"))
    # The patterns stay literals, so that each is compiled once and not once a cell.
    meets = F.lit(True)
    for k, r in enumerate(rules):
        own = value.rlike(r.pattern)
        if r.fits_int:
            own = own & F.coalesce(value.try_cast("bigint") <= INT_MAX, F.lit(True))
        meets = F.when(F.col("rank") == 2 + k, own).otherwise(meets)
    rank = F.when(~_well_quoted(F.col("cell")), 0).when(F.col("n") != len(columns), 1).when(F.col("rank").isNotNull() & ~meets, F.col("rank"))
    errors = judged.select("line_id", "key", rank.alias("rank")).filter("rank is not null").groupBy("line_id", "key").agg(F.min("rank").alias("rank"))
    names = F.element_at(F.array(*[F.lit(x) for x in ["quoting", "columns", *[r.reason for r in rules]]]), F.col("rank") + 1)
    errors = errors.select("line_id", "key", names.alias("reason"))
    failing = errors.unionByName(bad_markup.select("line_id", "key", "reason"))

    clean = rows.join(errors, ["line_id", "key"], "left_anti")
    fields = []
    for k, name in enumerate(columns):
        v = _value(F.col("cells")[k])
        fields.append((v.try_cast(types[name]) if name in types else v).alias(name))
    return Checked(failing.select("line_id", "reason"), clean.select("line_id", *fields))
