"""One query for each operation of the engine, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import quotes
from ..functions import text as T
from ..functions.keyterms import key_terms_of
from ..functions.similarity import ratio
from ..operators import analytics, chunking, dedup, facts, generation, grounding, pages, payloads, planning, provider, structure, tables, validation
from ..session import written
from ..sources import requests
from ..sources.files import members, page_sizes, pictures, supported
from ..sources.office import encoded, payload_bytes
from .registry import query, table
from .views import ATTEMPTS, CALLS, FOLD, MODULES, QUESTIONS, SPACES, attempts, calls, lines, lines_sql, modules, questions, raw_sources, slide_files, stem_key_sql

# --- scans and table changes ---------------------------------------------------------------------------------------


@query(f"SELECT id, name, updated_at FROM {MODULES} m")
def module_list_desc(spark: SparkSession, d: str) -> DataFrame:
    return tables.newest_first(modules(spark, d)).select("id", "name", "updated_at")


@query(f"SELECT id, name, source_text FROM {MODULES} m WHERE id = '7'")
def module_lookup(spark: SparkSession, d: str) -> DataFrame:
    return tables.lookup(modules(spark, d), "7").select("id", "name", "source_text")


@query(f"SELECT id, stem FROM {QUESTIONS} q WHERE module_id = '1'")
def bank_by_module(spark: SparkSession, d: str) -> DataFrame:
    return tables.of_module(questions(spark, d).withColumn("created_at", F.col("ordinal")), "1").select("id", "stem")


@query(f"SELECT original_filename FROM {MODULES} m")
def storage_projection(spark: SparkSession, d: str) -> DataFrame:
    return modules(spark, d).select("original_filename")


@query("""SELECT page_id, ext FROM (SELECT page_id, lower(regexp_extract(name, '(\\.[^./]+)$', 1)) AS ext FROM (SELECT page_id, 'p' || page_id || ['.PDF', '.docx', '.xls', '.PnG', '', '.md', '.tar.gz', '.txt'][page_id % 8 + 1] AS name FROM pages))
WHERE ext IN ('.pdf', '.docx', '.pptx', '.png', '.jpg', '.jpeg', '.webp', '.txt', '.md')""")
def supported_files(spark: SparkSession, d: str) -> DataFrame:
    ends = F.array(*map(F.lit, [".PDF", ".docx", ".xls", ".PnG", "", ".md", ".tar.gz", ".txt"]))
    files = table(spark, d, "pages").select("page_id", F.concat(F.lit("p"), "page_id", F.element_at(ends, (F.pmod("page_id", F.lit(8)) + 1).cast("int"))).alias("path"))
    return supported(files).select("page_id", F.col("suffix").alias("ext"))


@query("SELECT event_id, (props ->> '$.k')::BIGINT AS k, coalesce(props ->> '$.key', props ->> '$.k') AS alias FROM events")
def props_json_alias(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("props")
    return table(spark, d, "events").select("event_id", F.get_json_object(p, "$.k").cast("long").alias("k"), F.coalesce(F.get_json_object(p, "$.key"), F.get_json_object(p, "$.k")).alias("alias"))


@query("SELECT p_partkey, base64(p_name::BLOB) AS b64, (length(base64(p_name::BLOB)) * 3 // 4)::BIGINT AS payload_bytes FROM part")
def image_payload(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("p_name").cast("binary")
    return table(spark, d, "part").select("p_partkey", encoded(b).alias("b64"), payload_bytes(b).alias("payload_bytes"))


@query("SELECT * FROM (VALUES ('nclex', 10, 100), ('sample', 1, 1)) t(kind, batch_size, most)")
def constant_rows(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES ('nclex', 10, 100), ('sample', 1, 1) AS t(kind, batch_size, most)")


@query(f"SELECT CASE WHEN trim(id) = '' THEN sha256(name || chr(10) || source_text) ELSE id END AS id, name, CASE WHEN trim(name) = '' THEN 'name' WHEN trim(source_text) = '' THEN 'source_text' END AS missing FROM {MODULES} m")
def module_payload(spark: SparkSession, d: str) -> DataFrame:
    return tables.module_payload(modules(spark, d)).select("id", "name", "missing")


@query(f"""SELECT id, name || ' · Study notes' AS subtitle, original_filename AS "fileName", source_text AS source, 'shared' AS scope FROM {MODULES} m""")
def module_view(spark: SparkSession, d: str) -> DataFrame:
    return tables.module_view(modules(spark, d))


@query(f"SELECT module_id, stem, correct_index, left(stem, 20) AS concept, '' AS primary_section_id, sha256('{{\"module_id\":\"' || module_id || '\"}}') AS source_revision, normalized_stem FROM {QUESTIONS} q")
def question_row_view(spark: SparkSession, d: str) -> DataFrame:
    q = questions(spark, d).withColumns({"correctIndex": F.col("correct_index"), "concept": F.left("stem", F.lit(20)), "primarySectionId": F.lit(None).cast("string")})
    return tables.question_rows(q, tables.source_revision(F.col("module_id")))


@query(f"SELECT id, stem AS question, correct_index AS answer, 'clinical' AS mode FROM {QUESTIONS} q")
def question_browser_view(spark: SparkSession, d: str) -> DataFrame:
    return questions(spark, d).select("id", F.col("stem").alias("question"), F.col("correct_index").alias("answer"), F.lit("clinical").alias("mode"))


_KEYED = f"(SELECT * FROM {QUESTIONS} q)"
_FRESH = f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY module_id, normalized_stem ORDER BY ordinal) AS n FROM {_KEYED} c WHERE turn % 2 = 1 AND normalized_stem <> '') c
WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM {_KEYED} b WHERE b.turn % 2 = 0 AND b.module_id = c.module_id AND b.normalized_stem = c.normalized_stem))"""


def _bank_parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    q = questions(spark, d)
    return q.where("turn % 2 = 1"), q.where("turn % 2 = 0")


@query(f"SELECT module_id, id, normalized_stem FROM {_FRESH} f")
def bank_antijoin_merge(spark: SparkSession, d: str) -> DataFrame:
    new, bank = _bank_parts(spark, d)
    return tables.fresh(new, bank, [F.col("ordinal")]).select("module_id", "id", "normalized_stem")


@query(f"SELECT count(*) AS n FROM {_FRESH} f WHERE NOT EXISTS (SELECT 1 FROM {_FRESH} g WHERE f.module_id = g.module_id AND f.normalized_stem = g.normalized_stem)")
def merge_idempotent(spark: SparkSession, d: str) -> DataFrame:
    """Merging the same questions again inserts none."""
    new, bank = _bank_parts(spark, d)
    first = tables.fresh(new, bank, [F.col("ordinal")])
    return tables.fresh(new, bank.unionByName(first), [F.col("ordinal")]).agg(F.count("*").alias("n"))


@query(f"""SELECT c.module_id, c.n AS generated, coalesce(f.n, 0) AS inserted, c.n - coalesce(f.n, 0) AS duplicates, coalesce(b.n, 0) + coalesce(f.n, 0) AS total
FROM (SELECT module_id, count(*) AS n FROM {_KEYED} k WHERE turn % 2 = 1 GROUP BY 1) c LEFT JOIN (SELECT module_id, count(*) AS n FROM {_FRESH} x GROUP BY 1) f USING (module_id)
LEFT JOIN (SELECT module_id, count(*) AS n FROM {_KEYED} k WHERE turn % 2 = 0 GROUP BY 1) b USING (module_id)""")
def merge_counts(spark: SparkSession, d: str) -> DataFrame:
    new, bank = _bank_parts(spark, d)
    return tables.merge_counts(new, tables.fresh(new, bank, [F.col("ordinal")]), bank)


@query(f"SELECT module_id, id FROM (SELECT *, row_number() OVER (PARTITION BY module_id, normalized_stem ORDER BY ordinal) AS n FROM {QUESTIONS} q) WHERE n = 1")
def exact_dedup_first(spark: SparkSession, d: str) -> DataFrame:
    return tables.keep_first(questions(spark, d), ["module_id", "normalized_stem"], [F.col("ordinal")]).select("module_id", "id")


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'changed' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def module_update(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return tables.updated(c, c.where("c_custkey % 5 = 0").withColumn("c_mktsegment", F.lit("changed")), "c_custkey")


@query(f"SELECT id, module_id FROM {QUESTIONS} q WHERE module_id NOT IN (SELECT id FROM {MODULES} m WHERE length(source_text) < 1000)")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    gone = modules(spark, d).where(F.length("source_text") < 1000).select("id")
    return tables.deleted(modules(spark, d), questions(spark, d), gone)[1].select("id", "module_id")


@query("SELECT r_regionkey, r_name FROM region")
def migrate_if_empty(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "region").select("r_regionkey", "r_name")
    return tables.if_empty(r.where("r_regionkey < 0"), r)


def _filled(template: str, of: dict[str, Column]) -> Column:
    """A template whose every second piece between bars names an expression."""
    return F.concat(*(of[p] if i % 2 else F.lit(p) for i, p in enumerate(template.split("|"))))


def _filled_sql(template: str, of: dict[str, str]) -> str:
    return " || ".join(of[p] if i % 2 else f"'{p}'" for i, p in enumerate(template.split("|")))


def _either(k: str, cases: dict[int, str], other: str) -> tuple[Callable[[], Column], str]:
    """A text by the value of k, in Spark (made when asked for) and in SQL."""
    said = " ".join(f"WHEN {v} THEN '{t}'" for v, t in cases.items())
    whole = f"CASE {k} {said} ELSE '{other}' END"
    return lambda: F.expr(whole), whole


def _json(c: str) -> tuple[Callable[[], Column], str]:
    return lambda: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", ""), f"to_json({c})::VARCHAR"


_MODULE_BODY = '{"name":|name|,"|text_key|":|text|,"source":"an old text","|file_key|":"  notes.txt ","structured_sections":|first|,"structuredSections":["a"],"storagePath":"  ","formatted_text":null,"formattedSource":7|end|'
_MODULE_PARTS = {
    "name": _either("doc_id % 9", {1: "null", 2: '"  "', 3: "7", 4: '[1,"x"]'}, '" Lecture "'),
    "text_key": _either("doc_id % 2", {0: "source_text"}, "text"),
    "text": _json("text"),
    "file_key": _either("doc_id % 3", {0: "original_filename"}, "originalFilename"),
    "first": _either("doc_id % 4", {0: "[1,2,3]", 1: '"none"', 2: "null"}, "{}"),
    "end": _either("doc_id % 10", {9: ""}, "}"),
}


@query(rf"""SELECT doc_id, j IS NULL AS malformed, coalesce(trim(CASE WHEN j->>'$.name' = '' THEN NULL ELSE j->>'$.name' END), '') AS name,
length(regexp_replace(coalesce(j->>'$.source_text', j->>'$.source', ''), '^\s+|\s+$', '', 'g'))::INTEGER AS chars, CASE WHEN j IS NOT NULL THEN 'notes.txt' END AS original_filename, NULL::VARCHAR AS storage_path, j->>'$.formattedSource' AS formatted_text,
CASE WHEN j IS NULL THEN 0 WHEN json_type(j, '$.structured_sections') = 'ARRAY' THEN 3 ELSE 1 END AS sections,
CASE WHEN j IS NULL THEN 'body' WHEN coalesce(trim(j->>'$.name'), '') = '' THEN 'name' WHEN trim(coalesce(j->>'$.source_text', j->>'$.source', '')) = '' THEN 'source_text' END AS problem
FROM (SELECT doc_id, CASE WHEN json_valid(body) THEN body::JSON END AS j FROM (SELECT doc_id, {_filled_sql(_MODULE_BODY, {k: v[1] for k, v in _MODULE_PARTS.items()})} AS body FROM documents))""")
def module_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Documents as bodies of modules under either spelling, some with wrong types, some cut off."""
    bodies = table(spark, d, "documents").select("doc_id", _filled(_MODULE_BODY, {k: v[0]() for k, v in _MODULE_PARTS.items()}).alias("body"))
    rows = payloads.module_rows(bodies)
    return rows.select("doc_id", F.coalesce(F.col("problem") == "body", F.lit(False)).alias("malformed"), "name", F.length("source_text").alias("chars"), "original_filename", "storage_path", "formatted_text", F.size(F.variant_get("structured_sections", "$", "array<variant>")).alias("sections"), "problem")


_K = "(conv_id * 31 + turn) % 13"
_QUESTION_BODY = '{"stem":|stem|,"options":|options|,"|index_key|":|index|,"correctRationale":" r ","stemEvidence":|evidence|,"optionRationales":|rationales|,"category":null,"concept":|concept|,"sectionIds":|sections||end|'
_QUESTION_PARTS = {
    "stem": _json("text"),
    "options": _either(_K, {0: '"A"'}, '["A","B"," C"]'),
    "index_key": _either(_K, {6: "other"}, "correctIndex"),
    "index": _either(_K, {1: "9", 2: '" 2 "', 3: "2.7", 4: '"x"', 5: "null"}, "1"),
    "evidence": _either(_K, {7: '{"quote":"q"}'}, '[{"quote":"q"},{"quote":"r"}]'),
    "rationales": _either(_K, {8: '"none"'}, "[]"),
    "concept": _json("role"),
    "sections": _either(_K, {9: "3"}, '["s1"]'),
    "end": _either(_K, {10: ""}, "}"),
}
_QUESTION_JSON = f"(SELECT conv_id, turn, {_K} AS k, text, role, CASE WHEN json_valid(body) THEN body::JSON END AS j FROM (SELECT *, {_filled_sql(_QUESTION_BODY, {k: v[1] for k, v in _QUESTION_PARTS.items()})} AS body FROM conversations))"


def _question_bodies(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", F.floor(F.col("conv_id") / 20).cast("string").alias("module_id"), _filled(_QUESTION_BODY, {k: v[0]() for k, v in _QUESTION_PARTS.items()}).alias("body"), F.sha2(F.col("conv_id").cast("string"), 256).alias("revision"))


@query(rf"""SELECT conv_id, turn, (conv_id // 20)::VARCHAR AS module_id, CASE WHEN j IS NULL THEN '' ELSE regexp_replace(text, '^\s+|\s+$', '', 'g') END AS stem, CASE k WHEN 1 THEN 9 WHEN 2 THEN 2 WHEN 3 THEN 2 WHEN 4 THEN NULL WHEN 5 THEN NULL WHEN 6 THEN 0 WHEN 10 THEN 0 ELSE 1 END AS correct_index,
CASE WHEN k IN (0, 10) THEN 0 ELSE 3 END AS options, CASE WHEN k IN (7, 10) THEN 0 ELSE 2 END AS evidence, CASE WHEN k IN (9, 10) THEN 0 ELSE 1 END AS sections,
CASE WHEN j IS NULL THEN '' ELSE 'r' END AS correct_rationale, '' AS category, CASE WHEN j IS NULL THEN '' ELSE role END AS concept, CASE WHEN j IS NULL THEN '' ELSE {stem_key_sql('text')} END AS normalized_stem,
sha256(conv_id::VARCHAR) AS source_revision, CASE k WHEN 10 THEN 'body' WHEN 4 THEN 'correct_index' WHEN 5 THEN 'correct_index' END AS problem FROM {_QUESTION_JSON} q""")
def question_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Turns as bodies of questions, some with wrong types in every field, some cut off."""
    rows = payloads.question_rows(_question_bodies(spark, d), "revision")
    sizes = [F.size(F.variant_get(c, "$", "array<variant>")).alias(to) for c, to in [("options", "options"), ("stem_evidence", "evidence"), ("section_ids", "sections")]]
    return rows.select("conv_id", "turn", "module_id", "stem", "correct_index", *sizes, "correct_rationale", "category", "concept", "normalized_stem", "source_revision", "problem")


def _stored_questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions as they stand in bodies, unguarded, with ids that repeat every 50 conversations and modules that are not there."""
    v = F.try_parse_json("body")
    kinds = {to: F.try_variant_get(v, f"$.{c}", "variant") for c, to in [("options", "options"), ("stemEvidence", "stem_evidence"), ("optionRationales", "option_rationales"), ("sectionIds", "section_ids")]}
    c = _question_bodies(spark, d)
    return c.select(F.concat_ws("-", F.when(F.col("conv_id") % 50 == 1, 0).otherwise(F.col("conv_id")).cast("string"), "turn").alias("id"), F.when(F.col("conv_id") % 7 == 0, F.concat(F.lit("gone-"), "module_id")).otherwise(F.col("module_id")).alias("module_id"), T.stem_key(F.left(F.try_variant_get(v, "$.stem", "string"), F.lit(3))).alias("normalized_stem"), payloads.whole(F.try_variant_get(v, "$.correctIndex", "variant")).alias("correct_index"), *(e.alias(n) for n, e in kinds.items()))


@query(f"""WITH q AS (SELECT (CASE WHEN conv_id % 50 = 1 THEN 0 ELSE conv_id END) || '-' || turn AS id, (CASE WHEN conv_id % 7 = 0 THEN 'gone-' ELSE '' END) || (conv_id // 20) AS module_id,
CASE WHEN k <> 10 THEN {stem_key_sql('left(text, 3)')} END AS stem, k FROM {_QUESTION_JSON} q),
f AS (SELECT *, count(*) OVER (PARTITION BY id) AS ids, count(*) OVER (PARTITION BY module_id, stem) AS stems FROM q)
SELECT * FROM (SELECT 'question key' AS rule, count(*) FILTER (ids > 1) AS n FROM f UNION ALL SELECT 'module reference', count(*) FILTER (module_id NOT IN (SELECT doc_id::VARCHAR FROM documents)) FROM f
UNION ALL SELECT 'stem unique in module', count(*) FILTER (stems > 1 AND stem IS NOT NULL) FROM f UNION ALL SELECT 'correct_index range', count(*) FILTER (k = 1) FROM f UNION ALL SELECT 'options is a list', count(*) FILTER (k = 0) FROM f
UNION ALL SELECT 'stem_evidence is a list', count(*) FILTER (k = 7) FROM f UNION ALL SELECT 'option_rationales is a list', count(*) FILTER (k = 8) FROM f UNION ALL SELECT 'section_ids is a list', count(*) FILTER (k = 9) FROM f
UNION ALL SELECT 'nothing missing', count(*) FILTER (k IN (4, 5, 10)) FROM f) WHERE n > 0""")
def constraint_violations(spark: SparkSession, d: str) -> DataFrame:
    """Breaches of all nine rules by questions that break each of them."""
    return payloads.violations(_stored_questions(spark, d), modules(spark, d))


# --- guards --------------------------------------------------------------------------------------------------------


@query("SELECT doc_id FROM documents WHERE trim(text) <> ''")
def usable_sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(T.trimmed(F.col("text")) != "").select("doc_id")


_PICKED = f"(SELECT id::BIGINT // 4 AS request, id::BIGINT % 4 AS ordinal, * FROM {MODULES} m)"


def _picked(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id").cast("long")
    return modules(spark, d).withColumns({"request": F.floor(i / 4), "ordinal": F.pmod(i, F.lit(4))})


@query(f"SELECT request, count(*) AS modules, sum(length(source_text))::BIGINT AS chars FROM {_PICKED} p GROUP BY 1 HAVING count(*) <= 5 AND sum(length(source_text)) <= 100000")
def selection_guard(spark: SparkSession, d: str) -> DataFrame:
    return tables.selection_guard(_picked(spark, d))


@query(f"SELECT request, string_agg(id, ',' ORDER BY ordinal) AS ids, string_agg(name, ' + ' ORDER BY ordinal) AS name, string_agg(source_text, chr(10) || chr(10) ORDER BY ordinal) AS source FROM {_PICKED} p GROUP BY 1")
def multi_module_concat(spark: SparkSession, d: str) -> DataFrame:
    return tables.concatenated(_picked(spark, d))


@query("SELECT doc_id FROM documents WHERE length(text) BETWEEN 80 AND 100000 AND source <> ''")
def module_length_guard(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.length("text").between(80, 100_000) & (F.col("source") != "")).select("doc_id")


@query("SELECT url_host, pages, pages <= 20 AND biggest <= 8388608 AS allowed FROM (SELECT split_part(url, '/', 3) AS url_host, count(*) AS pages, max(strlen(html)) AS biggest FROM pages GROUP BY 1)")
def page_guards(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").groupBy(F.split_part("url", F.lit("/"), F.lit(3)).alias("url_host")).agg(F.count("*").alias("pages"), F.max(F.octet_length("html")).alias("biggest"))
    return p.select("url_host", "pages", ((F.col("pages") <= 20) & (F.col("biggest") <= 8 << 20)).alias("allowed"))


@query("SELECT o_orderkey, greatest(1, least(o_totalprice::BIGINT // 1000, 100)) AS clamped, o_totalprice::BIGINT // 1000 BETWEEN 1 AND 100 AS accepted FROM (SELECT o_orderkey, floor(o_totalprice) AS o_totalprice FROM orders)")
def count_clamp(spark: SparkSession, d: str) -> DataFrame:
    n = F.floor(F.floor("o_totalprice") / 1000)
    return table(spark, d, "orders").select("o_orderkey", N.clamp(n, 1, 100).cast("long").alias("clamped"), n.between(1, 100).alias("accepted"))


# --- text functions ------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {stem_key_sql('text')} AS key FROM documents")
def normalise_stem(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.stem_key(F.col("text")).alias("key"))


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM documents")
def whitespace_collapse(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.collapsed(F.col("text")).alias("flat"))


@query(r"SELECT doc_id, len(regexp_split_to_array(text, '\s+'))::INTEGER AS words FROM documents")
def word_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.word_count(F.col("text")).alias("words"))


_LEMMA = """CASE WHEN n > 5 AND l LIKE '%ies' THEN left(l, n - 3) || 'y' WHEN n > 5 AND regexp_matches(l, '(ch|sh|x|z)es$') THEN left(l, n - 2)
WHEN n > 5 AND l LIKE '%s' AND NOT regexp_matches(l, '(s|u|i)s$') THEN left(l, n - 1) WHEN n > 6 AND l LIKE '%ied' THEN left(l, n - 3) || 'y'
WHEN n > 6 AND l LIKE '%ed' THEN left(l, n - 2) WHEN n > 7 AND l LIKE '%ing' THEN left(l, n - 3) ELSE l END"""


@query(f"SELECT doc_id, lemma, count(*) AS n FROM (SELECT doc_id, {_LEMMA} AS lemma FROM (SELECT doc_id, lower(w) AS l, length(w) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z-]*')) AS w FROM documents))) GROUP BY ALL")
def lemma_counts(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "documents").select("doc_id", F.explode(T.word_tokens(F.col("text"))).alias("w"))
    return w.groupBy("doc_id", T.lemma(F.col("w")).alias("lemma")).agg(F.count("*").alias("n"))


@query(r"""SELECT doc_id, count(*) AS spans, max(length(s))::INTEGER AS longest FROM (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(text, '([.!?:])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1))) AS s FROM documents)
WHERE trim(s) <> '' GROUP BY 1""")
def sentence_spans(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").select("doc_id", F.explode(T.sentence_spans(F.col("text"))).alias("s"))
    return s.groupBy("doc_id").agg(F.count("*").alias("spans"), F.max(F.length("s")).alias("longest"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[^.!?\n]*[^.!?\n\s][^.!?\n]*[.!?]?'))::INTEGER AS sentences FROM documents")
def sentence_match(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).alias("sentences"))


_CONCEPT = r"""left(coalesce(CASE WHEN contains(t, '|') THEN nullif(trim(split_part(t, '|', 1)), '') END, CASE WHEN contains(t, ':') THEN nullif(trim(split_part(t, ':', 1)), '') END,
CASE WHEN contains(t, ' — ') THEN nullif(trim(split_part(t, ' — ', 1)), '') END, CASE WHEN contains(t, ' - ') THEN nullif(trim(split_part(t, ' - ', 1)), '') END,
nullif(array_to_string(list_slice(regexp_split_to_array(t, '\s+'), 1, 12), ' '), ''), 'Lecture concept'), 120)"""


@query(rf"SELECT item_id, {_CONCEPT} AS concept FROM (SELECT item_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM benchmark)")
def concept_from_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", T.concept(F.col("text")).alias("concept"))


_CATEGORY = f"""CASE WHEN regexp_matches({FOLD.format('text')}, 'first|priority|immediate|most important') THEN 'PRIORITY ASSESSMENT'
WHEN regexp_matches({FOLD.format('text')}, 'teaching|understanding|intervention|instruction') THEN 'PATIENT EDUCATION & SAFETY' ELSE 'PHYSICAL ASSESSMENT & CUE MAPPING' END"""


@query(f"SELECT conv_id, turn, {_CATEGORY} AS category FROM conversations")
def infer_category(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", T.category(F.col("text")).alias("category"))


@query("SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'document') AS name, left(regexp_replace(url, '\\.[^.]+$', ''), 70) AS title FROM pages")
def safe_filename(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.safe_name(F.col("url")).alias("name"), T.default_title(F.col("url")).alias("title"))


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS escaped FROM pages")
def html_escape(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.html_escaped(F.col("html")).alias("escaped"))


@query(r"SELECT page_id, regexp_replace(t, '\[Table row\]\s*', '', 'g') AS clean, regexp_replace(t, '^\s*[-*#]+\s*', '') AS unsigned FROM (SELECT page_id, '## [Table row]  ' || url AS t FROM pages)")
def marker_clean(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.lit("## [Table row]  "), "url")
    return table(spark, d, "pages").select("page_id", T.without_table_marks(t).alias("clean"), T.without_line_signs(t).alias("unsigned"))


@query(f"SELECT doc_id, array_to_string({lines_sql('text')}, chr(10) || chr(10)) AS formatted FROM documents")
def paragraph_format(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.paragraphs(F.col("text")).alias("formatted"))


@query("SELECT p_partkey, level, text FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 1 WHEN p_partkey % 3 = 1 THEN (p_partkey % 4)::INTEGER END AS level, CASE WHEN p_partkey % 3 < 2 THEN p_name END AS text FROM part)")
def heading_parse(spark: SparkSession, d: str) -> DataFrame:
    k = F.pmod("p_partkey", F.lit(3))
    line = F.when(k == 0, F.concat(F.lit("[heading] "), "p_name")).when(k == 1, F.concat(F.lit("[Heading "), F.pmod("p_partkey", F.lit(4)), F.lit("] "), "p_name")).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", T.heading_level(line).alias("level"), T.heading_text(line).alias("text"))


@query("SELECT p_partkey, trim(substr(sign || p_name, CASE WHEN sign = '' THEN 1 ELSE 3 END)) AS text FROM (SELECT p_partkey, p_name, ['- ', '* ', '•', ''][p_partkey % 4 + 1] AS sign FROM part)")
def bullet_strip(spark: SparkSession, d: str) -> DataFrame:
    sign = F.element_at(F.array(*map(F.lit, ["- ", "* ", "•", ""])), (F.pmod("p_partkey", F.lit(4)) + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", T.bullet_text(F.concat(sign, "p_name")).alias("text"))


@query("SELECT p_partkey, array_to_string(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i > 1 AND w[i] IN ('and', 'of', 'for', 'with', 'in', 'on', 'to') THEN w[i] ELSE upper(w[i][1]) || lower(w[i][2:]) END), ' ') AS title FROM (SELECT p_partkey, string_split('of ' || p_name || ' and ' || p_type, ' ') AS w FROM part)")
def title_case(spark: SparkSession, d: str) -> DataFrame:
    words = F.split(F.concat(F.lit("of "), "p_name", F.lit(" and "), "p_type"), " ")
    return table(spark, d, "part").select("p_partkey", T.term_title(words).alias("title"))


@query("SELECT p_partkey, trim(lower(p_name)) AS answer FROM part")
def answer_prefix(spark: SparkSession, d: str) -> DataFrame:
    lead = F.element_at(F.array(*map(F.lit, ["Correct answer: ", "option #", "CHOICE - ", ""])), (F.pmod("p_partkey", F.lit(4)) + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", F.trim(T.answer_text(F.concat(lead, "p_name"))).alias("answer"))


@query(f"""SELECT doc_id, CASE WHEN length(regexp_replace(line, '\\s+', ' ', 'g')) >= 12 AND len(regexp_extract_all(line, '[\\p{{L}}\\p{{N}}_]+')) >= 2 THEN line END AS quote FROM (SELECT doc_id, ({lines_sql('text')})[1] AS line FROM documents)""")
def canonical_quote(spark: SparkSession, d: str) -> DataFrame:
    """The first line with doubled spaces, found again in the source as it stands there."""
    line = F.get(lines(F.col("text")), F.lit(0))  # null where a text has no line
    return table(spark, d, "documents").select("doc_id", quotes.canonical_quote(F.col("text"), F.replace(line, F.lit(" "), F.lit("  "))).alias("quote"))


# --- chunks --------------------------------------------------------------------------------------------------------

_PACK = f"""WITH RECURSIVE l AS (SELECT doc_id, {lines_sql('text')} AS ls FROM documents),
p AS (SELECT doc_id, ls, 1 AS i, 1 AS k, length(ls[1]) AS size FROM l WHERE len(ls) > 0
UNION ALL SELECT doc_id, ls, i + 1, CASE WHEN size + length(ls[i + 1]) > 1800 THEN k + 1 ELSE k END, CASE WHEN size + length(ls[i + 1]) > 1800 THEN length(ls[i + 1]) ELSE size + length(ls[i + 1]) END FROM p WHERE i < len(ls))"""


@query(f"""{_PACK} SELECT doc_id || '-raw-' || k AS "sectionId", 'Original lecture text · part ' || k AS heading, string_agg(ls[i], chr(10) ORDER BY i) AS text, count(*)::INTEGER AS n_lines FROM p GROUP BY doc_id, k""")
def raw_chunk_pack(spark: SparkSession, d: str) -> DataFrame:
    return chunking.raw_chunks(raw_sources(spark, d)).select("sectionId", "heading", "text", "n_lines")


@query(f"""{_PACK} SELECT doc_id || '-raw-' || k AS "sectionId", (length('Original lecture text · part ' || k) + 2 * (sum(length(ls[i])) + count(*)))::BIGINT AS chars FROM p GROUP BY doc_id, k HAVING length('Original lecture text · part ' || k) + 2 * (sum(length(ls[i])) + count(*)) >= 45""")
def usable_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.usable(chunking.raw_chunks(raw_sources(spark, d))).select("sectionId", F.col("chars").cast("long").alias("chars"))


@query(f"SELECT doc_id, array_to_string(list_transform(list_sort(list_distinct(list_concat(ls, ls))), lambda x: x), '|') AS content FROM (SELECT doc_id, {lines_sql('text')} AS ls FROM documents)")
def compact_content(spark: SparkSession, d: str) -> DataFrame:
    ls = lines(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(chunking.compact(ls, ls, F.array())), "|").alias("content"))


@query(f"SELECT doc_id, array_to_string(list_concat([source], {lines_sql('text')}), chr(10)) AS text FROM documents")
def chunk_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", chunking.chunk_text(F.col("source"), lines(F.col("text"))).alias("text"))


@query(f"SELECT doc_id, source || coalesce(nullif(chr(10) || array_to_string(list_transform({lines_sql('text')}, lambda x: '- ' || x), chr(10)), chr(10)), '') AS flat FROM documents")
def sections_flatten(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", chunking.flattened(F.col("source"), lines(F.col("text"))).alias("flat"))


@query(f"""SELECT doc_id FROM (SELECT doc_id, text, list_distinct(list_filter({lines_sql('text')}, lambda x: length(x) >= 120)) AS parts FROM documents)
WHERE coalesce(list_sum(list_transform(parts, lambda x: length(x))), 0) + greatest(len(parts) - 1, 0) < 0.75 * length(text)""")
def structured_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Each source's long lines as the one structured chunk, as bullets and as evidence."""
    s = raw_sources(spark, d)
    long_lines = F.filter(lines(F.col("text")), lambda x: F.length(x) >= 120)
    return chunking.lacking(s.select("sourceId", F.concat(long_lines, long_lines).alias("parts")), s).select(F.col("sourceId").cast("long").alias("doc_id"))


@query()
def page_structure(spark: SparkSession, d: str) -> DataFrame:
    """Every document as one page, through the line parser; then the sections' chunks with grounded evidence."""
    pages = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.lit(1).alias("page_number"), "text", "source")
    found = structure.structured(pages)
    out = chunking.source_chunks(found.select(F.col("doc").alias("id"), F.col("source").alias("name"), "text", F.to_json("sections").alias("sections")), known_levels=2)  # structure.SECTION and SUBSECTION
    return out.select("sourceId", "sectionId", "ordinal", "heading", F.size("evidence").alias("n_evidence"), F.array_join("keyTerms", ", ").alias("key_terms"), "chars")


#: Nested sections of a document as JSON, four levels deep, in either spelling, with members that are no sections: text
#: between names of expressions.  parts are the lines whose number leaves 0 to 3 by 4, heads the first three lines.
_NESTED = (
    '[{"header":|head0|,"paragraphs":|part0|,"summary_notes":"No text says this anywhere.","page_number":1,"subsections":[7,'
    '{"sectionId":|own|,"heading":|source|,"bulletPoints":|part1|,"keyTerms":[|lang|," ",3],"pageNumber":2,"subsections":['
    '{"header":|head1|,"bullet_points":|part2|,"key_terms":[|source|,|lang|],"subsections":["no section",{"heading":|head2|,"paragraphs":|part3|,"summaryNotes":|head0|}]}]},'
    '{"header":"","bullet_points":"no list","subsections":null}]},{"header":|head0|,"bulletPoints":null}]'
)


def _nested_sources(spark: SparkSession, d: str) -> DataFrame:
    ls = lines(F.col("text"))

    def quoted(c: Column) -> Column:
        return F.coalesce(F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", ""), F.lit("null"))

    def part(k: int) -> Column:
        return F.to_json(F.filter(ls, lambda x, i: (i % 4 == k) & ((k < 3) | (F.col("doc_id") % 3 > 0))))

    of = {"own": quoted(F.concat(F.lit("own-"), F.col("doc_id"))), "source": quoted(F.col("source")), "lang": quoted(F.col("lang"))}
    of |= {f"head{k}": quoted(F.get(ls, k)) for k in range(3)} | {f"part{k}": part(k) for k in range(4)}
    pieces = [of[p] if i % 2 else F.lit(p) for i, p in enumerate(_NESTED.split("|"))]
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("name"), "text", F.concat(*pieces).alias("sections"))


def _nested_sql() -> str:
    of = {"own": "to_json('own-' || doc_id)", "source": "coalesce(to_json(source)::VARCHAR, 'null')", "lang": "coalesce(to_json(lang)::VARCHAR, 'null')"}
    of |= {f"head{k}": f"coalesce(to_json(ls[{k + 1}])::VARCHAR, 'null')" for k in range(3)}
    of |= {f"part{k}": f"to_json(list_filter(ls, lambda x, i: i % 4 = {(k + 1) % 4} AND ({k} < 3 OR doc_id % 3 > 0)))::VARCHAR" for k in range(4)}
    nested = " || ".join(of[p] if i % 2 else f"'{p}'" for i, p in enumerate(_NESTED.split("|")))
    strip = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"

    def field(*names: str) -> str:
        return strip.format(f"coalesce({', '.join(f'nullif(json_extract_string(node, {chr(39)}$.{n}{chr(39)}), {chr(39)}{chr(39)})' for n in names)}, '')")

    def listed(*names: str) -> str:
        tries = " ".join(f"WHEN json_type(node, '$.{n}') = 'ARRAY' THEN json_extract_string(node, '$.{n}[*]')" for n in names)
        return f"list_filter(list_transform(CASE {tries} ELSE [] END, lambda x: {strip.format('x')}), lambda x: x <> '')"

    def has(q: str) -> str:
        return rf"(contains(raw, {q}) AND length(regexp_replace({q}, '\s+', ' ', 'g')) >= 12 AND len(regexp_extract_all({q}, '[\p{{L}}\p{{N}}_]+')) >= 2)"

    return rf"""WITH RECURSIVE s AS (SELECT doc_id::VARCHAR AS "sourceId", {strip.format("text")} AS raw, ({nested})::JSON AS sections
  FROM (SELECT *, {lines_sql('text')} AS ls FROM documents) WHERE {strip.format("text")} <> ''),
t AS (SELECT "sourceId", [i] AS path, 'section' AS parent, sections[i - 1] AS node FROM (SELECT *, unnest(range(1, json_array_length(sections)::BIGINT + 1)) AS i FROM s)
  UNION ALL SELECT "sourceId", list_append(path, i), own, subs[i - 1] FROM (SELECT *, unnest(range(1, json_array_length(subs)::BIGINT + 1)) AS i FROM (
    SELECT *, node->'$.subsections' AS subs, coalesce(nullif(node->>'$.sectionId', ''), "sourceId" || '-' || parent || '-' || path[-1]) AS own FROM t
    WHERE json_type(node, '$.subsections') = 'ARRAY'))),
f AS (SELECT "sourceId", path, raw, coalesce(nullif(node->>'$.sectionId', ''), "sourceId" || '-' || parent || '-' || path[-1]) AS "sectionId",
    coalesce(node->>'$.page_number', node->>'$.pageNumber')::INT AS "pageNumber", {field("header", "heading")} AS head, {listed("paragraphs")} AS paras,
    {listed("bullet_points", "bulletPoints")} AS bullets, {listed("key_terms", "keyTerms")} AS terms, {field("summary_notes", "summaryNotes")} AS summary
  FROM t JOIN s USING ("sourceId") WHERE json_type(node) = 'OBJECT'),
e AS (SELECT *, list_filter(paras || bullets || [summary], lambda q: q <> '' AND {has("q")}) AS quotes FROM f),
v AS (SELECT *, CASE WHEN len(quotes) > 0 THEN quotes WHEN {has("head")} THEN [head] ELSE [] END AS said FROM e),
distinct_said AS (SELECT *, list_filter(said, lambda x, i: list_position(said, x) = i) AS evidence, list_distinct(paras || bullets || said) AS parts FROM v WHERE len(said) > 0),
have AS (SELECT "sourceId", sum(list_sum(list_transform(parts, lambda x: length(x))) + len(parts) - 1) AS n FROM distinct_said GROUP BY 1),
l AS (SELECT "sourceId", raw, {lines_sql('raw')} AS ls FROM s LEFT JOIN have USING ("sourceId") WHERE coalesce(n, 0) < 0.75 * length(raw)),
p AS (SELECT "sourceId", ls, 1 AS i, 1 AS k, length(ls[1]) AS size FROM l WHERE len(ls) > 0
  UNION ALL SELECT "sourceId", ls, i + 1, CASE WHEN size + length(ls[i + 1]) > 1800 THEN k + 1 ELSE k END, CASE WHEN size + length(ls[i + 1]) > 1800 THEN length(ls[i + 1]) ELSE size + length(ls[i + 1]) END FROM p WHERE i < len(ls)),
r AS (SELECT "sourceId", k, list(ls[i] ORDER BY i) AS part FROM p GROUP BY 1, 2),
every AS (SELECT "sourceId", 0 AS kind, path, "sectionId", "pageNumber", CASE WHEN head = '' THEN 'Study material' ELSE head END AS heading, paras, bullets, terms, evidence FROM distinct_said
  UNION ALL SELECT "sourceId", 1, [k], "sourceId" || '-raw-' || k, NULL, 'Original lecture text · part ' || k, part, [], [], part FROM r)
SELECT "sourceId", (row_number() OVER (PARTITION BY "sourceId" ORDER BY kind, path) - 1)::INT AS ordinal, "sectionId", "pageNumber", heading, array_to_string(bullets, '|') AS bullets,
  array_to_string(terms, '|') AS terms, array_to_string(evidence, '|') AS evidence, length(array_to_string(list_filter([heading] || paras || bullets || terms || evidence, lambda x: x <> ''), chr(10)))::INT AS chars FROM every"""


def _nested_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.source_chunks(_nested_sources(spark, d), known_levels=4)  # those of _NESTED


@query(_nested_sql())
def source_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Nested sections to chunks at any depth, raw chunks where they hold too little of the text."""
    listed = [F.array_join(c, "|").alias(to) for c, to in [("bulletPoints", "bullets"), ("keyTerms", "terms"), ("evidence", "evidence")]]
    return _nested_chunks(spark, d).select("sourceId", "ordinal", "sectionId", "pageNumber", "heading", *listed, "chars")


@query()
def source_chunk_plan(spark: SparkSession, d: str) -> DataFrame:
    """A plan of 25 questions for each document's chunks, structured and raw."""
    return planning.coverage_plan(_nested_chunks(spark, d).withColumnRenamed("sourceId", "request"), 25)


@query()
def key_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(key_terms_of(F.col("text")), ", ").alias("terms"))


# --- grounding -----------------------------------------------------------------------------------------------------

_FLAT_D = r"(SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM documents)"
_FLAT_B = r"(SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS q FROM benchmark)"
_GROUNDED = f"(SELECT d.doc_id, b.item_id FROM {_FLAT_D} d JOIN {_FLAT_B} b ON contains(d.flat, b.q) WHERE length(b.q) >= 12 AND len(regexp_extract_all(b.q, '[\\p{{L}}\\p{{N}}_]+')) >= 2)"


def _grounded(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    evidence = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("quote"))
    return grounding.grounded(docs, evidence)


@query(f"SELECT * FROM {_GROUNDED} g")
def evidence_grounding(spark: SparkSession, d: str) -> DataFrame:
    return _grounded(spark, d).select(F.col("source_id").alias("doc_id"), F.col("quote_id").alias("item_id"))


@query(f"SELECT item_id, min(doc_id) AS doc_id FROM {_GROUNDED} g GROUP BY 1 HAVING count(*) = 1")
def unique_source_evidence(spark: SparkSession, d: str) -> DataFrame:
    return grounding.unique_source(_grounded(spark, d)).select(F.col("quote_id").alias("item_id"), F.col("source_id").alias("doc_id"))


@query(f"SELECT g.item_id, coalesce(d.source, 'Study material') AS source FROM {_GROUNDED} g LEFT JOIN documents d ON d.doc_id = g.doc_id AND d.lang = 'en'")
def evidence_module_name(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("source_id"), "source")
    return _grounded(spark, d).join(names, "source_id", "left").select(F.col("quote_id").alias("item_id"), F.coalesce("source", F.lit("Study material")).alias("source"))


_FLAT_LINE = f"(SELECT doc_id, doc_id // 10 AS request, doc_id % 11 AS k, ({lines_sql('text')})[1] AS line FROM documents)"


@query(rf"""WITH l AS {_FLAT_LINE},
q AS (SELECT *, coalesce(length(regexp_replace(line, '\s+', ' ', 'g')) >= 12 AND len(regexp_extract_all(line, '[\p{{L}}\p{{N}}_]+')) >= 2, false) AS fit FROM l WHERE k NOT IN (0, 2) AND line IS NOT NULL)
SELECT request, 'missing' AS error, doc_id::VARCHAR AS source_id, 1::BIGINT AS n FROM l WHERE k = 0 OR k = 2
UNION ALL SELECT request, 'unknown', 'x' || doc_id, 1 FROM l WHERE k = 2 UNION ALL SELECT request, 'twice', doc_id::VARCHAR, 2 FROM l WHERE k = 1
UNION ALL SELECT request, 'other source', doc_id::VARCHAR, 1 FROM l WHERE k = 3
UNION ALL SELECT request, 'not in source', doc_id::VARCHAR, sum(CASE WHEN fit AND k <> 4 THEN 0 WHEN k = 4 OR NOT fit THEN 1 END * CASE k WHEN 1 THEN 2 ELSE 1 END)::BIGINT FROM q GROUP BY ALL HAVING bool_or(k = 4 OR NOT fit)""")
def extraction_errors(spark: SparkSession, d: str) -> DataFrame:
    """An extractor's output for every document, ten to a request: some are left out, given twice or under another id, some chunks name another source or quote what is not there."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.floor(F.col("doc_id") / 10).alias("request"), (F.col("doc_id") % 11).alias("k"), "text", F.element_at(F.concat(lines(F.col("text")), F.array(F.lit(None).cast("string"))), 1).alias("line"))
    given = docs.select("request", F.col("id").alias("source_id"))
    name = F.when(F.col("k") == 2, F.concat(F.lit("x"), "id")).otherwise(F.col("id"))
    times = F.explode(F.array_repeat(F.lit(1), F.when(F.col("k") == 1, 2).otherwise(1)))
    out = docs.where("k <> 0").select("*", name.alias("source_id"), times.alias("once"))
    quote = F.when(F.col("k") == 4, F.concat(F.lit("no such words "), "line")).otherwise(F.replace("line", F.lit(" "), F.lit("  ")))
    chunks = out.select("request", "source_id", F.when(F.col("k") == 3, "other").otherwise(F.col("source_id")).alias("chunk_source_id"), F.col("id").alias("chunk_id"), F.array_compact(F.array(quote)).alias("quotes"))
    return grounding.extraction_errors(given, out.select("request", "source_id"), chunks, docs.select("id", "text")).select("request", "error", "source_id", "n")


def _line_questions(spark: SparkSession, d: str) -> DataFrame:
    """(plan, question, quote_id, quote): every line of a document asks with itself, the next and the ninth after it as evidence."""
    def of(ls: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.greatest(F.size(ls) - 1, F.lit(0))), lambda i: F.transform(F.array(F.lit(0), F.lit(1), F.lit(9)), lambda k: F.struct(i.alias("question"), k.alias("k"), F.get(ls, i + k).alias("quote"))))
        return F.filter(F.flatten(each), lambda q: q["quote"].isNotNull())

    # the lines are bound once for a text: as a column below the generator they would be made again for every question
    asked = F.flatten(F.transform(F.array(lines(F.col("text"))), of))
    found = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("plan"), F.inline(asked))
    return found.select("plan", "question", F.concat_ws("-", "plan", "question", "k").alias("quote_id"), "quote")


def _placed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    asked, sources = _line_questions(spark, d), raw_sources(spark, d)
    spans = written(chunking.raw_spans(sources), "spans")  # small beside the texts, and read more than once
    of_sections = spans.select(F.col("sourceId").alias("source_id"), F.col("sectionId").alias("section"), "first", "last")
    held = grounding.held(sources.select(F.col("sourceId").alias("id"), "text"), asked.select(F.col("quote_id").alias("id"), F.col("plan").alias("source_id"), "quote"), of_sections)
    return asked, spans, grounding.section_scores(asked, held)


_SCORES = rf"""l AS (SELECT doc_id, {lines_sql('text')} AS ls FROM documents),
p AS (SELECT doc_id, ls, 1 AS i, 1 AS k, length(ls[1]) AS size FROM l WHERE len(ls) > 0
UNION ALL SELECT doc_id, ls, i + 1, CASE WHEN size + length(ls[i + 1]) > 1800 THEN k + 1 ELSE k END, CASE WHEN size + length(ls[i + 1]) > 1800 THEN length(ls[i + 1]) ELSE size + length(ls[i + 1]) END FROM p WHERE i < len(ls)),
chunk AS (SELECT doc_id, k, regexp_replace(string_agg(ls[i], ' ' ORDER BY i), '\s+', ' ', 'g') AS body FROM p GROUP BY 1, 2),
asked AS (SELECT doc_id, question, regexp_replace(ls[question + e.k + 1], '\s+', ' ', 'g') AS quote FROM (SELECT doc_id, ls, unnest(range(0, len(ls))) AS question FROM l), (VALUES (0), (1), (9)) e(k) WHERE question + e.k < len(ls)),
scores AS (SELECT doc_id, question, k, count(*) AS score FROM asked JOIN chunk USING (doc_id)
WHERE length(quote) >= 12 AND len(regexp_extract_all(quote, '[\p{{L}}\p{{N}}_]+')) >= 2 AND contains(body, quote) GROUP BY ALL)"""


@query(f"""WITH RECURSIVE {_SCORES} SELECT doc_id::VARCHAR AS plan, question::INT AS question, doc_id || '-raw-' || k AS section, score FROM scores""")
def section_evidence(spark: SparkSession, d: str) -> DataFrame:
    """How much of each question's evidence each chunk of its source holds."""
    return _placed(spark, d)[2]


@query(f"""WITH RECURSIVE {_SCORES}, options AS (SELECT doc_id, question, list({{'score': score, 'k': k}}) AS o FROM scores GROUP BY ALL),
steps AS (SELECT doc_id, question, row_number() OVER (PARTITION BY doc_id ORDER BY question) AS n, coalesce(o, []) AS o FROM (SELECT DISTINCT doc_id, question FROM asked) LEFT JOIN options USING (doc_id, question)),
walk AS (SELECT DISTINCT doc_id, 0::BIGINT AS n, NULL::BIGINT AS question, NULL::INTEGER AS k, []::INTEGER[] AS used, [] ::STRUCT(score BIGINT, k INTEGER)[] AS o FROM asked
UNION ALL SELECT doc_id, n, question, k, CASE WHEN k IS NULL THEN used ELSE list_append(used, k) END, o FROM (SELECT *, -best.place AS k FROM (
  SELECT s.doc_id, s.n, s.question, s.o, w.used, list_max(list_transform(list_filter(s.o, lambda x: len(list_filter(w.used, lambda u: u = x.k)) < 3), lambda x: {{'score': x.score, 'left': 3 - len(list_filter(w.used, lambda u: u = x.k)), 'place': -x.k}})) AS best
  FROM walk w JOIN steps s ON s.doc_id = w.doc_id AND s.n = w.n + 1)))
SELECT doc_id::VARCHAR AS plan, question::INT AS question, doc_id || '-raw-' || k AS section, coalesce(array_to_string(list_transform(list_sort(list_transform(o, lambda x: x.k)), lambda x: doc_id || '-raw-' || x), '|'), '') AS sections FROM walk WHERE n > 0""")
def question_sections(spark: SparkSession, d: str) -> DataFrame:
    """Questions dealt to the chunks of their source by evidence, three to a chunk at most."""
    asked, spans, scores = _placed(spark, d)
    quotas = spans.select(F.col("sourceId").alias("plan"), F.col("sectionId").alias("section"), F.lit(3).alias("quota"), "place")
    found = grounding.assigned(asked.select("plan", "question", F.col("question").alias("ordinal")).distinct(), scores, quotas)
    return found.select("plan", "question", "section", F.array_join("sections", "|").alias("sections"))


@query(f"SELECT source, coalesce(n, 0) AS n FROM (SELECT DISTINCT source FROM documents) LEFT JOIN (SELECT source, count(*) AS n FROM {_GROUNDED} g JOIN documents USING (doc_id) GROUP BY 1) USING (source)")
def coverage_zero_fill(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), "source")
    hits = _grounded(spark, d).join(docs, "source_id").groupBy("source").agg(F.count("*").alias("n"))
    return grounding.zero_filled(docs.select("source").distinct(), hits, "source", "n")


@query("SELECT l_orderkey AS question, arg_max(l_linenumber, (l_quantity, l_suppkey, -l_linenumber)) AS section FROM lineitem WHERE l_quantity > 10 AND l_suppkey > 0 GROUP BY 1")
def section_argmax(spark: SparkSession, d: str) -> DataFrame:
    scores = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("question"), F.col("l_linenumber").alias("section"), (F.when(F.col("l_quantity") > 10, F.col("l_quantity")).otherwise(0)).alias("score"), F.col("l_suppkey").alias("remaining"), F.col("l_linenumber").alias("ordinal"))
    return grounding.best_section(scores)


@query("SELECT c_custkey AS section, 12 - coalesce(n, 0) AS remaining FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE 12 - coalesce(n, 0) > 0")
def quota_remaining(spark: SparkSession, d: str) -> DataFrame:
    quota = table(spark, d, "customer").select(F.col("c_custkey").alias("section"), F.lit(12).cast("long").alias("quota"))
    return grounding.remaining_quota(quota, table(spark, d, "orders").select(F.col("o_custkey").alias("section")))


@query("SELECT o_orderkey AS doc, string_agg(p::VARCHAR, ',' ORDER BY p) AS missing FROM (SELECT o_orderkey, unnest(range(1, 8)) AS p FROM orders) WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = p) GROUP BY 1")
def missing_pages(spark: SparkSession, d: str) -> DataFrame:
    expected = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc"), F.explode(F.sequence(F.lit(1), F.lit(7))).alias("page"))
    found = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page"))
    return grounding.missing_pages(expected, found).select("doc", F.array_join(F.transform("missing", lambda p: p.cast("string")), ",").alias("missing"))


_SETS = "(SELECT l_orderkey, list(DISTINCT l_linenumber) AS a, list(DISTINCT (l_suppkey % 7 + 1)::INTEGER) AS b FROM lineitem GROUP BY 1)"


def _sets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("a"), F.collect_set((F.pmod("l_suppkey", F.lit(7)) + 1).cast("int")).alias("b"))


@query(f"SELECT l_orderkey, len(list_filter(b, lambda x: NOT list_contains(a, x))) = 0 AS subset, len(list_filter(b, lambda x: NOT list_contains(a, x))) = 0 AND len(a) = len(b) AS same, len(list_intersect(a, b))::INTEGER AS common FROM {_SETS} s")
def set_checks(spark: SparkSession, d: str) -> DataFrame:
    extra, lack = F.size(F.array_except("b", "a")), F.size(F.array_except("a", "b"))
    return _sets(spark, d).select("l_orderkey", (extra == 0).alias("subset"), ((extra == 0) & (lack == 0)).alias("same"), F.size(F.array_intersect("a", "b")).alias("common"))


# --- allocation ----------------------------------------------------------------------------------------------------


@query("SELECT source, doc_id, round_even(100.0::DOUBLE * greatest(1, length(text)) / sum(greatest(1, length(text))) OVER (PARTITION BY source), 0)::BIGINT AS questions FROM documents")
def section_weight_alloc(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", "doc_id", F.greatest(F.lit(1), F.length("text")).alias("w"))
    whole = docs.groupBy("source").agg(F.sum("w").alias("whole"))
    return docs.join(whole, "source").select("source", "doc_id", N.half_even(F.lit(100.0) * F.col("w") / F.col("whole")).cast("long").alias("questions"))


@query("SELECT o_orderkey, array_to_string(list_transform(range(0, k), lambda i: (n // k + CASE WHEN i < n % k THEN 1 ELSE 0 END)::VARCHAR), ',') AS sizes FROM (SELECT o_orderkey, o_custkey % 100 + 1 AS n, (o_custkey % 100 + 10) // 10 AS k FROM orders)")
def even_split(spark: SparkSession, d: str) -> DataFrame:
    n = F.pmod("o_custkey", F.lit(100)) + 1
    return table(spark, d, "orders").select("o_orderkey", F.array_join(F.transform(N.even_split(n, N.ceil_div(n, 10)), lambda x: x.cast("string")), ",").alias("sizes"))


@query("SELECT l_orderkey, l_linenumber, round_even(l_extendedprice / 100, 0) AS even, floor(l_extendedprice / 100 + 0.5)::BIGINT AS up FROM lineitem")
def rounding_rules(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("l_extendedprice") / 100
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", N.half_even(x).alias("even"), N.half_up(x).alias("up"))


@query()
def coverage_plan(spark: SparkSession, d: str) -> DataFrame:
    """A plan of 25 questions for each document's raw chunks."""
    chunks = chunking.raw_chunks(raw_sources(spark, d))
    return planning.coverage_plan(chunks.select(F.col("sourceId").alias("request"), F.substring_index("sectionId", "-", -1).cast("int").alias("ordinal"), "sectionId", "chars"), 25)


# --- deduplication and validation ----------------------------------------------------------------------------------


def _requests(spark: SparkSession, d: str) -> DataFrame:
    q = questions(spark, d)
    return q.select(F.col("module_id").alias("request"), "ordinal", "id", F.col("normalized_stem").alias("stem_key"), T.stem_key(T.concept(F.col("stem"))).alias("concept_key"))


@query()
def fuzzy_dedup(spark: SparkSession, d: str) -> DataFrame:
    return dedup.fuzzy_dedup(_requests(spark, d)).select("request", "id")


@query()
def stem_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Each turn's key against that of the turn before it in its conversation."""
    q = questions(spark, d).select("conv_id", "turn", "normalized_stem")
    before = q.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("normalized_stem").alias("previous"))
    return q.join(before, ["conv_id", "turn"]).select("conv_id", "turn", ratio(F.col("normalized_stem"), F.col("previous")).alias("ratio"))


def _judged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    q = questions(spark, d)
    words = F.split(T.collapsed(F.col("stem")), " ")
    full = q.select(
        F.col("module_id").alias("batch"),
        "ordinal",
        "stem",
        F.slice(words, 1, 4).alias("options"),
        F.col("correct_index").alias("correctIndex"),
        T.concept(F.col("stem")).alias("concept"),
        F.array_join(F.slice(words, 5, 5), " ").alias("correctRationale"),
        F.array("stem").alias("evidence"),
        F.concat(F.lit("s"), F.pmod("turn", F.lit(5))).alias("section"),
        F.lit(10).alias("quota"),
        F.col("normalized_stem").alias("stem_key"),
    ).withColumn("concept_key", T.stem_key(F.col("concept")))
    ruled = validation.rule_reason(full)
    return ruled, validation.judged(ruled)


@query(r"""SELECT conv_id * 1000 + turn AS ordinal, CASE WHEN length(text) < 30 THEN 'stem is short' WHEN len(w) < 4 THEN 'options must be 4 to 8'
WHEN len(list_distinct(list_transform(w[1:4], lambda x: lower(x)))) < 4 THEN 'options repeat' WHEN length(array_to_string(w[5:9], ' ')) < 20 THEN 'rationale is short' END AS reason
FROM (SELECT *, regexp_split_to_array(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS w FROM conversations)""")
def validation_rules(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d)[0].select("ordinal", "reason")


@query()
def rejection_quarantine(spark: SparkSession, d: str) -> DataFrame:
    ruled, judgement = _judged(spark, d)
    return validation.rejections(judgement, ruled)


@query()
def rejection_hint(spark: SparkSession, d: str) -> DataFrame:
    """The last twelve rejections that concern a batch or one of its sections."""
    ruled, judgement = _judged(spark, d)
    return validation.hint(validation.rejections(judgement, ruled), 0, ["s1", "s2"])


@query()
def provider_questions(spark: SparkSession, d: str) -> DataFrame:
    """Replies under different aliases, made uniform."""
    q = questions(spark, d)
    words = F.slice(F.split(T.collapsed(F.col("stem")), " "), 1, 4)
    one = F.to_json(F.struct(F.array(F.struct(F.col("stem").alias("question"), words.alias("options"), (F.col("correct_index") + 1).alias("correctAnswer"), F.array("stem").alias("evidence"))).alias("items")))
    two = F.to_json(F.struct(F.array(F.struct("stem", words.alias("options"), F.col("correct_index").alias("correctIndex"), F.array("stem").alias("evidenceQuotes"))).alias("questions")))
    replies = q.select(F.col("id").alias("reply"), F.when(F.col("turn") % 2 == 0, one).otherwise(two).alias("payload"))
    return provider.questions(replies).select("reply", "category", "stem", "correctIndex", F.size("options").alias("n_options"))


@query("SELECT event_id, event_id % 100 AS input_tokens, event_id % 10 AS output_tokens, event_id % 100 + event_id % 10 AS total_tokens FROM events")
def token_usage_alias(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    a, b = F.pmod("event_id", F.lit(100)), F.pmod("event_id", F.lit(10))
    new = F.to_json(F.struct(F.struct(a.alias("input_tokens"), b.alias("output_tokens")).alias("usage")))
    old = F.to_json(F.struct(F.struct(a.alias("prompt_tokens"), b.alias("completion_tokens"), (a + b).alias("total_tokens")).alias("usage")))
    given, made, total = provider.usage(F.when(F.col("event_id") % 2 == 0, new).otherwise(old))
    return e.select("event_id", given.alias("input_tokens"), made.alias("output_tokens"), total.alias("total_tokens"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN event_type || '-' || event_id ELSE '' END AS text FROM events""")
def response_text(spark: SparkSession, d: str) -> DataFrame:
    """Responses that hold their text whole, in parts beside a refusal, and not at all."""
    e = table(spark, d, "events")

    def part(kind: str, text) -> Column:
        return F.struct(F.lit(kind).alias("type"), text.alias("text"))

    parts = F.array(part("output_text", F.concat("event_type", F.lit("-"))), part("refusal", F.lit("no")), part("text", F.col("event_id").cast("string")))
    whole = F.to_json(F.struct(F.col("event_type").alias("output_text")))
    pieces = F.to_json(F.struct(F.lit(" ").alias("output_text"), F.array(F.struct(parts.alias("content"))).alias("output")))
    kind = F.pmod("event_id", F.lit(3))
    return e.select("event_id", provider.response_text_of(F.when(kind == 0, whole).when(kind == 1, pieces).otherwise(F.lit("{}"))).alias("text"))


@query("""SELECT doc_id, status, CASE WHEN status = 200 THEN octet_length(encode(text)) END AS n_bytes FROM (SELECT *, CASE WHEN doc_id % 5 = 0 OR text IS NULL OR text = '' THEN 400 WHEN doc_id % 3 = 0 THEN 415 WHEN doc_id % 5 = 1 THEN 422 ELSE 200 END AS status FROM documents)""")
def upload_guard(spark: SparkSession, d: str) -> DataFrame:
    """Uploads that are empty, of a type that is not read, no base64, and whole."""
    docs, kind = table(spark, d, "documents"), F.pmod("doc_id", F.lit(5))
    encoded = F.base64(F.encode("text", "UTF-8"))
    content = F.when(kind == 0, "").when((kind == 1) & (F.col("text") != ""), F.concat(encoded, F.lit("!"))).otherwise(encoded)
    names = F.when(F.pmod("doc_id", F.lit(3)) == 0, "notes.xls").otherwise("notes.TXT")
    found = requests.uploads(docs.select("doc_id", names.alias("filename"), F.regexp_replace(content, r"[\r\n]", "").alias("content_base64")))
    return found.select("doc_id", "status", F.octet_length("content").cast("long").alias("n_bytes"))


@query("""SELECT doc_id, 0 AS ordinal, CASE WHEN doc_id % 2 = 0 THEN 'source' ELSE doc_id::VARCHAR END AS "sourceId", source AS "sourceName", length(trim(text, chr(9) || chr(10) || chr(13) || ' ')) AS n_chars, CASE WHEN doc_id % 3 = 0 THEN '[{"header":"a"}]' WHEN doc_id % 3 = 1 THEN '[{"header":"b"}]' ELSE '[]' END AS sections
FROM documents WHERE trim(text, chr(9) || chr(10) || chr(13) || ' ') <> ''""")
def request_sources(spark: SparkSession, d: str) -> DataFrame:
    """Bodies of two sources, one of them blank, under either name for their sections."""
    docs, kind = table(spark, d, "documents"), F.pmod("doc_id", F.lit(3))
    one, two = (F.when(kind == i, F.array(F.struct(F.lit(h).alias("header")))) for i, h in enumerate("ab"))
    name = F.when(F.pmod("doc_id", F.lit(2)) == 0, "").otherwise(F.col("doc_id").cast("string"))
    full = F.struct(name.alias("id"), F.col("source").alias("name"), F.col("text"), one.alias("structuredSections"), two.alias("structured_sections"))
    blank = F.struct(F.lit("b").alias("id"), F.lit("b").alias("name"), F.lit(" ").alias("text"), F.lit(None).cast("array<struct<header:string>>").alias("structuredSections"), F.lit(None).cast("array<struct<header:string>>").alias("structured_sections"))
    found = requests.sources_of(docs.select("doc_id", F.to_json(F.struct(F.array(full, blank).alias("sources"))).alias("body")))
    return found.select("doc_id", "ordinal", "sourceId", "sourceName", F.length("rawText").alias("n_chars"), "sections")


# --- generation ----------------------------------------------------------------------------------------------------


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """A question for each document: after a reply that is no JSON, after a question without evidence, or never answered."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("request"), "text")
    first = F.concat(F.lit("These are the study notes of document "), "request", F.lit(" as they were uploaded."))
    texts = docs.select("request", F.lit(1).alias("ordinal"), F.lit("s-1").alias("sectionId"), F.lit("s").alias("sourceId"), F.concat_ws("\n", first, "text").alias("text"))

    def response(evidence) -> Column:
        stem = F.concat(F.lit("Which sentence opens the notes of document "), "request", F.lit("?"))
        question = F.struct(stem.alias("stem"), F.lit(T.CATEGORIES[0]).alias("category"), F.array(*map(F.lit, ["One", "Two", "Three", "Four"])).alias("options"), F.lit(2).alias("correctIndex"), F.lit("The notes say so in their first line.").alias("correctRationale"), F.array(evidence).alias("evidenceQuotes"))
        text = F.to_json(F.struct(F.array(question).alias("questions")))
        return F.to_json(F.struct(text.alias("output_text"), F.struct(F.lit(7).alias("input_tokens"), F.lit(5).alias("output_tokens"), F.lit(12).alias("total_tokens")).alias("usage")))

    kind = F.pmod("request", F.lit(3))
    bad = F.when(kind == 0, F.lit("{")).otherwise(response(F.lit("No line of any notes has ever said this.")))
    replies = docs.where(kind < 2).select("request", F.lit("quiz batch 1").alias("name"), F.posexplode(F.array(bad, response(first))).alias("ordinal", "payload"))
    return generation.generated(docs.select("request", F.lit(1).alias("count")), texts, texts.select("request", "sourceId", "text"), replies)


@query("""SELECT doc_id AS request, 's-1' AS section, 'These are the study notes of document ' || doc_id || ' as they were uploaded.' AS quote, 2 AS "correctIndex" FROM documents WHERE doc_id % 3 < 2""")
def generation_run(spark: SparkSession, d: str) -> DataFrame:
    """The questions that a run keeps, with their section and first quote."""
    return _runs(spark, d).select("request", F.explode("questions").alias("q")).select("request", "q.section", F.col("q.evidence")[0]["quote"].alias("quote"), "q.correctIndex")


@query("""SELECT doc_id AS request, 2 AS generator_request_count, (k < 2)::INTEGER AS generated_count, (k = 2)::INTEGER AS replacement_rounds, (k = 0)::INTEGER AS schema_retry_requests, (k = 0)::INTEGER AS incomplete_json_count,
(k = 1)::INTEGER AS batch_retry_attempts, (k = 1)::INTEGER AS rejected_question_count, CASE k WHEN 0 THEN 7 WHEN 1 THEN 14 END AS input_tokens, CASE k WHEN 0 THEN 12 WHEN 1 THEN 24 END AS total_tokens,
CASE WHEN k = 2 THEN 'batch 1: no reply to quiz batch 1; batch 2: no reply to quiz batch 2' ELSE '' END AS failures, CASE WHEN k = 2 THEN 2 ELSE 0 END AS warnings FROM (SELECT doc_id, doc_id % 3 AS k FROM documents)""")
def generation_record(spark: SparkSession, d: str) -> DataFrame:
    """What the record of each run says of its requests, retries, rejections and tokens."""
    counts = ("generator_request_count", "generated_count", "replacement_rounds", "schema_retry_requests", "incomplete_json_count", "batch_retry_attempts", "rejected_question_count", "input_tokens", "total_tokens")
    return generation.telemetry(_runs(spark, d)).select("request", *counts, F.array_join("failure_details", "; ").alias("failures"), F.size("warnings").alias("warnings"))


# --- analytics -----------------------------------------------------------------------------------------------------


def _answers(spark: SparkSession, d: str) -> DataFrame:
    a = attempts(spark, d)
    return a.select("attempt", "module_id", F.explode(F.sequence(F.lit(1).cast("long"), "answers")).alias("i"), "correct").withColumn("correct", F.col("i") <= F.col("correct"))


@query(f"SELECT sum(answers)::BIGINT AS answers, floor(100.0 * sum(correct) / sum(answers) + 0.5)::BIGINT AS accuracy FROM {ATTEMPTS} a")
def accuracy_overall(spark: SparkSession, d: str) -> DataFrame:
    return analytics.accuracy(_answers(spark, d), [])


@query(f"SELECT module_id, sum(answers)::BIGINT AS answers, floor(100.0 * sum(correct) / sum(answers) + 0.5)::BIGINT AS accuracy FROM {ATTEMPTS} a GROUP BY 1")
def accuracy_by_module(spark: SparkSession, d: str) -> DataFrame:
    return analytics.accuracy(_answers(spark, d), ["module_id"])


@query(f"SELECT attempt, floor(100.0 * correct / answers + 0.5)::BIGINT AS score FROM {ATTEMPTS} a")
def attempt_scores(spark: SparkSession, d: str) -> DataFrame:
    a = attempts(spark, d).withColumn("list", F.transform(F.sequence(F.lit(1).cast("long"), "answers"), lambda i: F.struct((i <= F.col("correct")).alias("correct"))))
    return a.select("attempt", analytics.score(F.col("list")).alias("score"))


@query(f"SELECT coalesce(sum(answers), 0)::BIGINT AS answers FROM {ATTEMPTS} a WHERE ts > (SELECT max(ts) FROM {ATTEMPTS} b) - INTERVAL 7 DAY")
def weekly_rolling(spark: SparkSession, d: str) -> DataFrame:
    a = attempts(spark, d)
    return analytics.rolling(a, F.lit(a.agg(F.max("ts")).first()[0]).cast("timestamp_ntz"))


@query(f"""SELECT day::DATE AS day, coalesce(sum(answers), 0)::BIGINT AS answers FROM (SELECT unnest(generate_series(max(ts)::DATE - INTERVAL 6 DAY, max(ts)::DATE::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM {ATTEMPTS} b)
LEFT JOIN {ATTEMPTS} a ON a.ts::DATE = day GROUP BY 1""")
def daily_zero_filled(spark: SparkSession, d: str) -> DataFrame:
    a = attempts(spark, d)
    return analytics.daily(a, F.lit(a.agg(F.max(F.to_date("ts"))).first()[0]))


@query(f"SELECT module_id, least(n / 300.0::DOUBLE, 1) AS progress, greatest(300 - n, 0) AS remaining FROM (SELECT module_id, sum(answers)::BIGINT AS n FROM {ATTEMPTS} a GROUP BY 1)")
def weekly_goal(spark: SparkSession, d: str) -> DataFrame:
    done, left = analytics.weekly_goal(F.col("n"), 300)
    return attempts(spark, d).groupBy("module_id").agg(F.sum("answers").alias("n")).select("module_id", done.alias("progress"), left.alias("remaining"))


@query(f"SELECT module_id, count(*) AS sessions, count(DISTINCT ts::DATE) AS days, greatest(1, max(answers)) AS scale FROM {ATTEMPTS} a GROUP BY 1")
def sessions_by_module(spark: SparkSession, d: str) -> DataFrame:
    return attempts(spark, d).groupBy("module_id").agg(F.count("*").alias("sessions"), F.count_distinct(F.to_date("ts")).alias("days"), F.greatest(F.lit(1), F.max("answers")).alias("scale"))


@query(f"SELECT attempt, module_id FROM {ATTEMPTS} a ORDER BY ts DESC, attempt DESC LIMIT 20")
def recent_activity_topk(spark: SparkSession, d: str) -> DataFrame:
    return analytics.latest(attempts(spark, d), 20).select("attempt", "module_id")


@query(f"SELECT module_id, least(count(DISTINCT event_type || (correct::VARCHAR)), 100) AS terms FROM {ATTEMPTS} a GROUP BY 1")
def distinct_terms(spark: SparkSession, d: str) -> DataFrame:
    return attempts(spark, d).groupBy("module_id").agg(F.least(F.count_distinct(F.concat("event_type", F.col("correct").cast("string"))), F.lit(100)).alias("terms"))


@query(f"""SELECT attempt, m AS module_id FROM (SELECT DISTINCT attempt, unnest([module_id, (module_id::BIGINT + 1)::VARCHAR, CASE WHEN attempt % 2 = 0 THEN module_id ELSE (module_id::BIGINT + 2)::VARCHAR END]) AS m FROM {ATTEMPTS} a)
WHERE m IN (SELECT id FROM {MODULES} x)""")
def attempts_for_module(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("module_id").cast("long")
    a = attempts(spark, d).select("attempt", F.array("module_id", (k + 1).cast("string")).alias("moduleIds"), F.when(F.col("attempt") % 2 == 0, F.col("module_id")).otherwise((k + 2).cast("string")).alias("moduleId"))
    return analytics.attempts_of(modules(spark, d), a).select("attempt", "module_id")


# --- telemetry -----------------------------------------------------------------------------------------------------


@query(f"""SELECT batch_index, round_even(max(finished_seconds) - min(started_seconds), 3) AS elapsed_seconds, count(*) AS provider_requests, string_agg(requested_questions::VARCHAR, ',' ORDER BY request_number) AS requested,
string_agg(status, ',' ORDER BY request_number) AS statuses FROM {CALLS} c GROUP BY 1""")
def batch_telemetry(spark: SparkSession, d: str) -> DataFrame:
    return analytics.batches(calls(spark, d))


@query(f"""SELECT count(*) AS requests, count(*) FILTER (schema_attempt > 1) AS schema_retries, count(*) FILTER (status = 'incomplete_json') AS incomplete_json, count(*) FILTER (status = 'schema_validation_error') AS schema_errors,
count(*) FILTER (replacement) AS replacements, count(DISTINCT CASE WHEN generation_attempt > 1 THEN batch_index * 10 + generation_attempt END) AS batch_retries FROM {CALLS} c""")
def conditional_counts(spark: SparkSession, d: str) -> DataFrame:
    return analytics.call_counts(calls(spark, d))


_TOLD = "bool_or(input_tokens IS NOT NULL OR output_tokens IS NOT NULL)"


@query(f"SELECT batch_index, " + ", ".join(f"CASE WHEN {_TOLD} THEN coalesce(sum({c}), 0)::BIGINT END AS {c}" for c in ("input_tokens", "output_tokens", "total_tokens")) + f" FROM {CALLS} c GROUP BY 1")
def nullable_token_sum(spark: SparkSession, d: str) -> DataFrame:
    return analytics.token_sums(calls(spark, d), ["batch_index"])


@query(f"""SELECT batch_index, max(o)::BIGINT AS max_concurrency FROM (SELECT batch_index, sum(x) OVER (PARTITION BY batch_index ORDER BY t, x ROWS UNBOUNDED PRECEDING) AS o FROM
(SELECT batch_index, started_seconds AS t, 1 AS x FROM {CALLS} c UNION ALL SELECT batch_index, finished_seconds, -1 FROM {CALLS} c)) GROUP BY 1""")
def max_concurrency(spark: SparkSession, d: str) -> DataFrame:
    return analytics.concurrency(calls(spark, d), ["batch_index"])


@query(f"""SELECT max(o)::BIGINT AS max_concurrency FROM (SELECT sum(x) OVER (ORDER BY t, x ROWS UNBOUNDED PRECEDING) AS o FROM
(SELECT started_seconds AS t, 1 AS x FROM {CALLS} c UNION ALL SELECT finished_seconds, -1 FROM {CALLS} c))""")
def max_concurrency_overall(spark: SparkSession, d: str) -> DataFrame:
    """Over all calls at once, by ranges of time."""
    return analytics.concurrency(calls(spark, d), [])


@query(f"""SELECT event_type, ts, n, (sum(n) OVER (PARTITION BY event_type ORDER BY ts))::BIGINT AS total FROM (SELECT event_type, ts, sum(answers)::BIGINT AS n FROM {ATTEMPTS} a GROUP BY ALL)""")
def running_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers given so far, by kind of event."""
    return analytics.prefix_sums(attempts(spark, d).select("event_type", "ts", F.col("answers").alias("n")), ["event_type"], "ts", "n")


@query(f"SELECT batch_index, request_number FROM (SELECT *, row_number() OVER (PARTITION BY batch_index ORDER BY request_number DESC) AS n FROM {CALLS} c) WHERE n <= 12")
def last_n_calls(spark: SparkSession, d: str) -> DataFrame:
    return grounding.last_rows(calls(spark, d), ["batch_index"], "request_number", 12).select("batch_index", "request_number")


@query(f"SELECT batch_index, min(finished_seconds) AS confidence, string_agg(status, ',' ORDER BY request_number) AS warnings FROM {CALLS} c GROUP BY 1")
def combined_results(spark: SparkSession, d: str) -> DataFrame:
    r = calls(spark, d).select(F.col("batch_index").alias("doc"), F.col("request_number").alias("batch"), F.array(F.lit("s")).alias("sections"), F.array("status").alias("warnings"), F.col("finished_seconds").alias("confidence"), F.lit("local").alias("mode"))
    return structure.combined(r).select(F.col("doc").alias("batch_index"), "confidence", F.array_join("warnings", ",").alias("warnings"))


@query("SELECT l_orderkey, l_linenumber, ((l_linenumber - 1) // 5)::BIGINT AS page_batch FROM lineitem")
def page_batches(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.floor((F.col("l_linenumber") - 1) / 5).alias("page_batch"))


_HOST_PAGE = "(SELECT split_part(url, '/', 3) AS doc, page_id, coalesce(strlen(html), 0) AS b FROM pages)"


def _host_pages(spark: SparkSession, d: str) -> DataFrame:
    """Each host's pages as those of a document."""
    return table(spark, d, "pages").select(F.split_part("url", F.lit("/"), F.lit(3)).alias("doc"), F.col("page_id").alias("page_number"), F.octet_length("html").cast("long").alias("n_bytes"))


@query(f"SELECT doc, count(*) AS n_pages, count(*) FILTER (b > 12000) AS n_over, CASE WHEN count(*) > 20 THEN 'too many pages' WHEN max(b) > 12000 THEN 'page too large' END AS refusal FROM {_HOST_PAGE} p GROUP BY 1")
def page_refusals(spark: SparkSession, d: str) -> DataFrame:
    return pages.guarded(_host_pages(spark, d), most_page_bytes=12000)


@query(f"""WITH RECURSIVE p AS (SELECT doc, page_id, b, row_number() OVER (PARTITION BY doc ORDER BY page_id, b) AS n, count(*) OVER (PARTITION BY doc) AS k, max(b) OVER (PARTITION BY doc) AS m FROM {_HOST_PAGE} p),
r AS (SELECT doc, page_id, n, 0 AS batch, 1 AS held, b AS bytes FROM p WHERE n = 1 AND k <= 20 AND m <= 12000
UNION ALL SELECT p.doc, p.page_id, p.n, CASE WHEN r.held >= 5 OR r.bytes + p.b > 12000 THEN r.batch + 1 ELSE r.batch END, CASE WHEN r.held >= 5 OR r.bytes + p.b > 12000 THEN 1 ELSE r.held + 1 END, CASE WHEN r.held >= 5 OR r.bytes + p.b > 12000 THEN p.b ELSE r.bytes + p.b END
FROM r JOIN p ON p.doc = r.doc AND p.n = r.n + 1)
SELECT doc, batch, string_agg(page_id::VARCHAR, ',' ORDER BY n) AS page_numbers FROM r GROUP BY 1, 2""")
def page_call_batches(spark: SparkSession, d: str) -> DataFrame:
    found = pages.batches(_host_pages(spark, d), most_page_bytes=12000, batch_bytes=12000)
    return found.select("doc", "batch", F.array_join(F.col("page_numbers").cast("array<string>"), ",").alias("page_numbers"))


_SLIDE_LINE = rf"""(SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1) // 6 AS slide, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1) % 6 AS place, line
FROM (SELECT doc_id, pos, trim(regexp_replace(ls[pos], '{SPACES}', ' ', 'g')) AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))) WHERE line <> '')"""


def _slide_files(spark: SparkSession, d: str) -> DataFrame:
    """Each document with text as a file of slides, which `views.slide_files` writes."""
    return slide_files(table(spark, d, "documents").select(F.concat("doc_id", F.lit(".pptx")).alias("path"), "text"))


@query(f"""SELECT doc_id || '.pptx' AS path, (slide + 1)::INTEGER AS page_number, string_agg('[x=0, y=' || place * 100 || ', w=900, h=80] ' || line, chr(10) ORDER BY place) AS text_hint, 1 AS n_images,
3 * ((strlen(arg_min(line, place)) + 2) // 3) AS n_bytes FROM {_SLIDE_LINE} l GROUP BY 1, slide""")
def slide_pages(spark: SparkSession, d: str) -> DataFrame:
    found = written(members(_slide_files(spark, d)), "members")
    sizes = page_sizes(found).withColumnRenamed("doc", "path")
    return found.where("kind = 'page'").select("path", "page_number", "text_hint", "n_images").join(sizes, ["path", "page_number"])


@query(f"SELECT doc_id || '.pptx' AS path, (slide + 1)::INTEGER AS page_number, 'Embedded image in slide ' || slide + 1 AS label, 'image/png' AS mime_type, base64(encode(line)) AS image_base64 FROM {_SLIDE_LINE} l WHERE place = 0")
def slide_pictures(spark: SparkSession, d: str) -> DataFrame:
    return pictures(members(_slide_files(spark, d)))


@query(f"SELECT doc_id, len(list_filter({lines_sql('text')}, lambda x: length(x) <= 100 AND NOT regexp_matches(x, '[.!?]$')))::INTEGER AS headings FROM documents")
def plain_headings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(F.filter(lines(F.col("text")), T.plain_heading)).alias("headings"))


# --- more of the library's operations ------------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in facts.CLOZE_STOP)


@query(rf"""WITH l AS (SELECT doc_id AS id, pos, trim(regexp_replace(ls[pos], '^\s*[-*#]+\s*', '')) AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
p AS (SELECT id, pos, trim(left(line, c - 1)) AS term, trim(substr(line, c + 1)) AS definition FROM (SELECT *, instr(line, ':') AS c FROM l WHERE line <> '') WHERE c > 2 AND c <= 100 AND length(trim(substr(line, c + 1))) > 15),
t AS (SELECT id FROM p GROUP BY 1 HAVING count(*) >= 4),
s AS (SELECT id, pos, trim(ss[pos]) AS definition FROM (SELECT doc_id AS id, ss, unnest(range(1, len(ss) + 1)) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '[^.!?\n]+[.!?]?') AS ss FROM documents WHERE doc_id NOT IN (SELECT id FROM t)))),
w AS (SELECT *, list_filter(regexp_extract_all(definition, '[a-zA-Z][a-zA-Z-]{{4,}}'), lambda x: lower(x) NOT IN ({_STOP})) AS ws FROM s WHERE length(definition) > 35),
c AS (SELECT id, pos, definition, list_reduce(ws, lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END) AS term FROM w WHERE len(ws) > 0)
SELECT id, 'topic' AS mode, term, definition FROM (SELECT *, row_number() OVER (PARTITION BY id, lower(term) ORDER BY pos) AS a, row_number() OVER (PARTITION BY id, lower(definition) ORDER BY pos) AS b FROM p WHERE id IN (SELECT id FROM t)) WHERE a = 1 AND b = 1
UNION ALL SELECT id, 'cloze', term, definition FROM (SELECT *, row_number() OVER (PARTITION BY id, lower(term) ORDER BY pos) AS a FROM c) WHERE a = 1""")
def study_facts(spark: SparkSession, d: str) -> DataFrame:
    return facts.facts(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'demo' ELSE 'mine' END AS scope FROM documents WHERE doc_id % 3 > 0")
def module_filter(spark: SparkSession, d: str) -> DataFrame:
    scoped = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "demo").otherwise("mine").alias("scope"))
    return tables.in_scope(scoped, "mine")


@query("SELECT event_id, strftime(ts, '%a') AS weekday, strftime(ts, '%b ') || day(ts) AS label, ts::DATE - 6 AS first_day FROM events")
def date_labels(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp_ntz")
    return table(spark, d, "events").select("event_id", F.date_format(ts, "E").alias("weekday"), F.date_format(ts, "MMM d").alias("label"), F.date_sub(F.to_date(ts), 6).alias("first_day"))


_LABEL = r"[A-Z][A-Za-z0-9 /&()''-]{2,55}:"
_LABEL_START = r"(^|[^\p{L}\p{N}\p{M}\p{Pc}])"


@query(rf"""SELECT doc_id, array_to_string(list_transform(found, lambda x: regexp_extract(x, '{_LABEL_START}({_LABEL})', 2)), '|') AS labels, (len(found) + 1)::INTEGER AS parts
FROM (SELECT doc_id, regexp_extract_all('Causes: ' || text || ' Risk factors: age', '{_LABEL_START}({_LABEL})') AS found FROM documents)""")
def label_split(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.lit("Causes: "), "text", F.lit(" Risk factors: age"))
    return table(spark, d, "documents").select("doc_id", F.array_join(T.labels(t), "|").alias("labels"), F.size(T.label_parts(t)).alias("parts"))


@query("SELECT p_partkey, len(list_distinct(list_transform(o, lambda x: lower(trim(x))))) = len(o) AS options_differ FROM (SELECT p_partkey, [p_name, upper(p_name) || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '!' END, p_brand, p_type] AS o FROM part)")
def distinct_options(spark: SparkSession, d: str) -> DataFrame:
    o = F.array("p_name", F.concat(F.upper("p_name"), F.when(F.col("p_partkey") % 2 == 0, "").otherwise("!")), "p_brand", "p_type")
    folded = F.transform(o, lambda x: F.lower(F.trim(x)))
    return table(spark, d, "part").select("p_partkey", (F.size(F.array_distinct(folded)) == F.size(o)).alias("options_differ"))


@query("SELECT 'customer' AS kind, c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'supplier', s_nationkey, count(*) FROM supplier GROUP BY 2")
def union_rounds(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("nation"))
    s = table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("nation"))
    return c.unionByName(s).groupBy("kind", "nation").agg(F.count("*").alias("n"))


@query()
def extraction_checks(spark: SparkSession, d: str) -> DataFrame:
    """Each document's structure against the rules of an extraction result, page 2 being expected too for every third."""
    pages = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.lit(1).alias("page_number"), "text")
    found = structure.structured(pages).withColumn("pages", F.when(F.col("doc") % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return structure.checked(found).select("doc", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"))
