"""Modules, the question bank and attempts: scans, views, guards and changes.

A change never edits in place: it returns the table's next state, to be
written to a new path or merged into a transactional table.  Keys are matched
with hash joins; the history is the right side of anti joins and is not
broadcast unless Spark has measured it to be small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def newest_first(modules: DataFrame) -> DataFrame:
    return modules.orderBy(F.col("updated_at").desc(), "id")


def lookup(modules: DataFrame, key: str) -> DataFrame:
    return modules.where(F.col("id") == key).limit(1)


def of_module(questions: DataFrame, key: str) -> DataFrame:
    return questions.where(F.col("module_id") == key).orderBy("created_at", "id")


def module_payload(raw: DataFrame) -> DataFrame:
    """Names trimmed, blanks null, missing ids from the content; rows without name or text are marked."""
    name, text = T.blank_to_null(F.col("name")), T.blank_to_null(F.col("source_text"))
    return raw.withColumns(
        {
            "id": F.coalesce(T.blank_to_null(F.col("id")), F.sha2(F.concat_ws("\n", name, text), 256)),
            "name": name,
            "source_text": text,
            "missing": F.when(name.isNull(), "name").when(text.isNull(), "source_text"),
        }
    )


def module_view(modules: DataFrame) -> DataFrame:
    return modules.select("id", F.concat("name", F.lit(" · Study notes")).alias("subtitle"), F.col("original_filename").alias("fileName"), F.col("source_text").alias("source"), F.lit("shared").alias("scope"))


def question_rows(questions: DataFrame, revision: Column) -> DataFrame:
    """Bank rows from questions: snake-case names, the source's revision and the stem's key."""
    return questions.select("module_id", "stem", F.col("correctIndex").cast("int").alias("correct_index"), F.col("concept"), F.coalesce(F.col("primarySectionId"), F.lit("")).alias("primary_section_id"), revision.alias("source_revision"), T.stem_key(F.col("stem")).alias("normalized_stem"))


def source_revision(*parts: Column) -> Column:
    """A digest of the parts that fix a source's content, in a fixed order."""
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def keep_first(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def fresh(candidates: DataFrame, bank: DataFrame, order: list[Column]) -> DataFrame:
    """Candidates whose stem key is new to their module's bank; of equal ones the first, none with a blank key."""
    keys = ["module_id", "normalized_stem"]
    return keep_first(candidates.where("normalized_stem <> ''"), keys, order).join(bank.select(*keys), keys, "left_anti")


def merge_counts(candidates: DataFrame, inserted: DataFrame, bank: DataFrame) -> DataFrame:
    """One row for each module: generated, inserted, duplicates and the bank's new size."""
    def n(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("module_id").agg(F.count("*").alias(name))

    out = n(candidates, "generated").join(n(inserted, "inserted"), "module_id", "left").join(n(bank, "before"), "module_id", "left").fillna(0, ["inserted", "before"])
    return out.select("module_id", "generated", "inserted", (F.col("generated") - F.col("inserted")).alias("duplicates"), (F.col("before") + F.col("inserted")).alias("total"))


def updated(table: DataFrame, changes: DataFrame, key: str = "id", stamp: Column | None = None) -> DataFrame:
    """The table with changed rows in place of those with the same key; changes for unknown keys are left out.

    A stamp becomes the changed rows' updated_at.
    """
    if stamp is not None:
        changes = changes.withColumn("updated_at", stamp)
    known = changes.join(table.select(key), key, "left_semi")
    return table.join(known.select(key), key, "left_anti").unionByName(known)


def deleted(modules: DataFrame, questions: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the modules in gone(id); their questions go too."""
    return modules.join(gone, "id", "left_anti"), questions.join(gone.withColumnRenamed("id", "module_id"), "module_id", "left_anti")


def if_empty(server: DataFrame, legacy: DataFrame) -> DataFrame:
    """The server's rows, or the legacy rows where the server has none."""
    some = server.limit(1).select(F.lit(1).alias("_one"))
    return server.unionByName(legacy.withColumn("_one", F.lit(1)).join(some, "_one", "left_anti").drop("_one"))


def selection_guard(selected: DataFrame, most: int = 5, most_chars: int = 100_000) -> DataFrame:
    """(request) rows whose selection is allowed: at least one module, at most `most`, and the total length."""
    return selected.groupBy("request").agg(F.count("*").alias("modules"), F.sum(F.length("source_text")).alias("chars")).where((F.col("modules") <= most) & (F.col("chars") <= most_chars))


def concatenated(selected: DataFrame) -> DataFrame:
    """One source for each request: names joined by " + ", texts by an empty line, in the order of selection."""
    rows = F.array_sort(F.collect_list(F.struct("ordinal", "id", "name", "source_text")))
    return selected.groupBy("request").agg(rows.alias("r")).select("request", F.array_join("r.id", ",").alias("ids"), F.array_join("r.name", " + ").alias("name"), F.array_join("r.source_text", "\n\n").alias("source"))


def in_scope(modules: DataFrame, scope: str) -> DataFrame:
    """Modules of one scope ("demo", "mine"), or of any ("all")."""
    return modules if scope == "all" else modules.where(F.col("scope") == scope)
