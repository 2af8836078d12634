"""Request bodies as rows: JSON kept as VARIANT, read under any spelling of its fields, with a problem instead of an error.

Fields are declared: their names in order of preference, what they must be and
what stands for a missing one.  A body that is no object, or lacks what it
must have, stays in the result with `problem` set, so nothing vanishes;
`accepted` and `refused` part the two.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


@dataclass(frozen=True)
class Field:
    """A column of a body: `text` (trimmed, empty if missing), `optional` (null if blank), `list` (empty if it is none) or `index`.

    With `given` the first name that is there decides, else the first that is not empty.
    """

    column: str
    names: tuple[str, ...]
    kind: str = "text"
    given: bool = False
    needed: bool = False

    def read(self, body: Column) -> Column:
        if self.kind == "list":
            some = [F.when(F.try_variant_get(body, f"$.{n}", "array<variant>").isNotNull(), F.try_variant_get(body, f"$.{n}", "variant")) for n in self.names]
            return F.coalesce(*some, F.parse_json(F.lit("[]")))
        texts = [F.try_variant_get(body, f"$.{n}", "string") for n in self.names]
        if self.kind == "index":
            return whole(F.try_variant_get(body, f"$.{self.names[0]}", "variant"))
        if not self.given:
            texts = [F.nullif(t, F.lit("")) for t in texts]
        out = T.trimmed(F.coalesce(*texts, F.lit("")))
        return F.nullif(out, F.lit("")) if self.kind == "optional" else out


def whole(v: Column) -> Column:
    """A whole number from a variant: a number without its fraction, or digits in a text; 0 where there is none, null for anything else."""
    text = F.try_variant_get(v, "$", "string")
    kind = F.schema_of_variant(v)
    return F.when(v.isNull(), 0).when(kind == "STRING", F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(text).try_cast("int"))).when(kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL"), F.try_variant_get(v, "$", "double").try_cast("int")).otherwise(F.lit(None).cast("int"))


MODULE = (
    Field("id", ("id",), "optional"),
    Field("name", ("name",), needed=True),
    Field("source_text", ("source_text", "source"), given=True, needed=True),
    Field("original_filename", ("original_filename", "originalFilename"), "optional"),
    Field("storage_path", ("storage_path", "storagePath"), "optional"),
    Field("formatted_text", ("formatted_text", "formattedSource"), "optional", given=True),
    Field("structured_sections", ("structured_sections", "structuredSections"), "list"),
)
QUESTION = (
    Field("stem", ("stem",)),
    Field("options", ("options",), "list"),
    Field("correct_index", ("correctIndex",), "index", needed=True),
    Field("correct_rationale", ("correctRationale",)),
    Field("stem_evidence", ("stemEvidence",), "list"),
    Field("option_rationales", ("optionRationales",), "list"),
    Field("category", ("category",)),
    Field("concept", ("concept",)),
    Field("primary_section_id", ("primarySectionId",)),
    Field("section_ids", ("sectionIds",), "list"),
)


def read(bodies: DataFrame, fields: tuple[Field, ...], body: str = "body") -> DataFrame:
    """The rows with a column for each field in place of the JSON text `body`, and `problem`: the first that is wrong, or null."""
    parsed = bodies.withColumn("_v", F.try_parse_json(body)).withColumn("_ok", F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False)))
    out = parsed.drop(body).withColumns({f.column: f.read(F.col("_v")) for f in fields})
    lacks = [F.when(F.coalesce(F.col(f.column).cast("string"), F.lit("")) == "", f.column) for f in fields if f.needed]
    return out.withColumn("problem", F.coalesce(F.when(~F.col("_ok"), "body"), *lacks)).drop("_v", "_ok")


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where("problem IS NULL").drop("problem")


def refused(rows: DataFrame) -> DataFrame:
    return rows.where("problem IS NOT NULL")


def module_rows(bodies: DataFrame) -> DataFrame:
    """Modules from bodies; a module without an id is named after its content."""
    rows = read(bodies, MODULE)
    made = F.concat(F.lit("module-"), F.left(F.sha2(F.concat_ws("\n", "name", "source_text"), 256), F.lit(32)))
    return rows.withColumn("id", F.coalesce("id", made))


def question_rows(bodies: DataFrame, revision: str) -> DataFrame:
    """Bank rows from bodies (module_id, body) and a column with their source's revision."""
    return read(bodies.withColumnRenamed(revision, "source_revision"), QUESTION).withColumn("normalized_stem", T.stem_key(F.col("stem")))


#: The rules of a stored question, by the names that violations are reported under.
LISTS = ("options", "stem_evidence", "option_rationales", "section_ids")
RULES = ("question key", "module reference", "stem unique in module", "correct_index range", *(f"{c} is a list" for c in LISTS), "nothing missing")


def judged(questions: DataFrame, modules: DataFrame) -> DataFrame:
    """Questions with `broken`, the rules that each breaks, in the order of RULES.

    questions has (id, module_id, normalized_stem, correct_index) and the
    LISTS as VARIANT.  Keys that occur twice are told by counts, which are
    combined before they are shuffled, and only they are joined back.
    """
    twice = questions.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit(True).alias("_id"))
    stems = questions.groupBy("module_id", "normalized_stem").agg(F.count("*").alias("n")).where("n > 1").select("module_id", "normalized_stem", F.lit(True).alias("_stem"))
    known = modules.select(F.col("id").alias("module_id"), F.lit(True).alias("_known")).distinct()
    met = questions.join(twice, "id", "left").join(stems, ["module_id", "normalized_stem"], "left").join(known, "module_id", "left")
    absent = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in ("id", "module_id", "normalized_stem", "correct_index", *LISTS)))
    wrong = [
        F.col("_id").isNotNull(),
        F.col("module_id").isNotNull() & F.col("_known").isNull(),
        F.col("_stem").isNotNull(),
        ~F.col("correct_index").between(0, 7),
        *(F.col(c).isNotNull() & ~F.schema_of_variant(c).startswith("ARRAY") for c in LISTS),
        absent,
    ]
    broken = F.array_compact(F.array(*(F.when(F.coalesce(w, F.lit(False)), r) for w, r in zip(wrong, RULES, strict=True))))
    return met.withColumn("broken", broken).select(*questions.columns, "broken")


def violations(questions: DataFrame, modules: DataFrame) -> DataFrame:
    """(rule, n): how many questions break each rule, for the rules that any breaks."""
    return judged(questions, modules).select(F.explode("broken").alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


def stored(questions: DataFrame, modules: DataFrame, path: str, stamp: Column | None = None) -> dict[str, int]:
    """Write the questions that break no rule to `path`, stamped with updated_at, and count all breaches in the same pass.

    Returns the rows seen, those written and the breaches of each rule that
    has any.  The counts are observed while the rows go by, so nothing is read twice.
    """
    from pyspark.sql import Observation

    seen = Observation()
    counts = [F.count_if(F.array_contains("broken", r)).alias(r) for r in RULES]
    rows = judged(questions, modules).observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.size("broken") == 0).alias("written"), *counts)
    rows.where(F.size("broken") == 0).drop("broken").withColumn("updated_at", stamp if stamp is not None else F.current_timestamp()).write.parquet(path)
    return {k: v for k, v in seen.get.items() if v or k in ("rows", "written")}
