"""Chunks of nested sections, places of evidence and quotas against plain loops."""

import json
import random

from pyspark.sql import functions as F

from studyloom.functions.quotes import Source
from studyloom.operators import chunking, grounding, planning


def _walk(source_id, raw, sections):
    out, own = [], Source(raw)

    def visit(s, parent, number):
        if not isinstance(s, dict):
            return
        def listed(*names):
            return next((s[n] for n in names if isinstance(s.get(n), list)), [])

        def text(*names):
            return next((str(s[n]) for n in names if s.get(n)), "").strip()

        head = text("header", "heading")
        paragraphs, bullets, terms = ([str(x).strip() for x in listed(*n) if str(x).strip()] for n in (["paragraphs"], ["bullet_points", "bulletPoints"], ["key_terms", "keyTerms"]))
        found = [own.canonical(q) for q in [*paragraphs, *bullets, text("summary_notes", "summaryNotes")]]
        evidence = list(dict.fromkeys(q for q in found if q)) or [q for q in [own.canonical(head)] if q]
        name = str(s.get("sectionId") or f"{source_id}-{parent}-{number}")
        if evidence:
            out.append((name, s.get("page_number", s.get("pageNumber")), head or "Study material", paragraphs, bullets, terms, evidence))
        for i, x in enumerate(s.get("subsections") or [], 1):
            visit(x, name, i)

    for i, s in enumerate(sections if isinstance(sections, list) else [], 1):
        visit(s, "section", i)
    return out


def _section(rnd, depth, lines):
    s = {rnd.choice(["header", "heading"]): rnd.choice([*lines, "", "no such line in it", " "])}
    if rnd.random() < 0.8:
        s[rnd.choice(["paragraphs", "bullet_points", "bulletPoints"])] = rnd.choice([rnd.sample(lines, 2), [], "no list", [7, " ", rnd.choice(lines).replace(" ", "  ")]])
    if rnd.random() < 0.4:
        s["summary_notes"] = rnd.choice(lines)
    if rnd.random() < 0.3:
        s["sectionId"] = f"own-{rnd.randrange(99)}"
    if rnd.random() < 0.3:
        s[rnd.choice(["page_number", "pageNumber"])] = rnd.randrange(9)
    if rnd.random() < 0.4:
        s["keyTerms"] = ["lesion", " ", 'a "quote" [with] brackets\\']
    if depth and rnd.random() < 0.8:
        s["subsections"] = [_section(rnd, depth - 1, lines) if rnd.random() < 0.9 else rnd.choice([5, "x"]) for _ in range(rnd.randint(0, 3))]
    return s


def test_nested_sections_equal_a_recursive_walk(spark):
    rnd = random.Random(2)
    rows, want = [], {}
    for i in range(60):
        lines = [f"line {k} of source {i} says more {'and more ' * rnd.randrange(9)}here." for k in range(6)]
        raw = "\n".join(lines)
        tree = [_section(rnd, 6, lines) for _ in range(rnd.randint(0, 3))]
        rows.append((str(i), f"n{i}", raw, json.dumps(tree)))
        want[str(i)] = _walk(str(i), raw, tree)
    rows += [("odd1", None, "One line that is long enough.", "not json"), ("odd2", "", "One line that is long enough.", '{"a": 1}'), ("odd3", "n", "  ", "[]"), (None, "n", "Another line that is long.", None)]
    df = spark.createDataFrame(rows, "id string, name string, text string, sections string").repartition(3)
    got = {}
    for r in chunking.source_chunks(df).orderBy("sourceId", "ordinal").collect():
        got.setdefault(r["sourceId"], []).append(r)
    raw_of = {r[0]: r[2] for r in rows}
    for key, chunks in want.items():
        made = [tuple(r[c] for c in ("sectionId", "pageNumber", "heading", "paragraphs", "bulletPoints", "keyTerms", "evidence")) for r in got[key]]
        assert made[: len(chunks)] == chunks
        have = sum(len("\n".join(dict.fromkeys([*c[3], *c[4], *c[6]]))) for c in chunks)
        assert (len(made) > len(chunks)) == (have < 0.75 * len(raw_of[key]))
    assert "odd3" not in got and [r["sectionId"] for r in got["source"]] == ["source-raw-1"]
    assert got["odd1"][0]["sourceName"] == got["odd2"][0]["sourceName"] == "Study material"
    r = got["odd1"][0]
    assert r["chars"] == len("\n".join([r["heading"], *r["paragraphs"], *r["evidence"]]))
    plan = planning.coverage_plan(chunking.source_chunks(df).withColumnRenamed("sourceId", "request"), 12).groupBy("request").agg(F.sum("quota").alias("n")).collect()
    assert {r["n"] for r in plan} == {12}
    assert chunking.source_chunks(df.limit(0)).count() == 0


def test_places_of_quotes_in_their_own_source(spark):
    sources = spark.createDataFrame([("a", "One  two three\nfour. One two three four."), ("b", "One two three four."), ("c", None)], "id string, text string")
    quotes = [(i, "ab"[i % 2], "One two  three") for i in range(50)] + [(100, "a", "short"), (101, "c", "One two three"), (102, None, "One two three"), (103, "b", "two three four. None")]
    got = sorted(map(tuple, grounding.located(sources, spark.createDataFrame(quotes, "id long, source_id string, quote string"), most=7).collect()))
    assert got == sorted([("a", i, b, b + 13) for i in range(0, 50, 2) for b in (0, 20)] + [("b", i, 0, 13) for i in range(1, 50, 2)])


def test_interval_join_equals_all_pairs(spark):
    rnd = random.Random(8)
    places = [(rnd.choice("ab"), b, b + rnd.randrange(1, 60)) for b in (rnd.randrange(500) for _ in range(200))]
    spans = [(rnd.choice("ab"), f, f + rnd.randrange(0, 200)) for f in (rnd.randrange(500) for _ in range(60))]
    got = grounding.contained(spark.createDataFrame(places, "k string, begin int, end int"), spark.createDataFrame(spans, "k string, first int, last int"), ["k"], width=64)
    want = sorted((k, b, e, f, x) for k, b, e in places for j, f, x in spans if k == j and f <= b and e <= x)
    assert sorted(map(tuple, got.select("k", "begin", "end", "first", "last").collect())) == want


def test_quota_fold_equals_a_loop(spark):
    rnd = random.Random(6)
    quotas = [(p, f"s{k}", rnd.randrange(3), k) for p in "xyz" for k in range(4)]
    questions = [(p, f"q{i}", i) for p in "xyzw" for i in range(12)]
    scores = [(p, q, f"s{k}", rnd.randint(1, 3)) for p, q, _ in questions if p != "w" for k in range(4) if rnd.random() < 0.6]
    want = []
    for p in "xyzw":
        left = {s: n for q, s, n, _ in quotas if q == p}
        for _, q, _ in (x for x in questions if x[0] == p):
            own = {s: n for a, b, s, n in scores if (a, b) == (p, q)}
            fit = [s for s in left if own.get(s) and left[s] > 0]
            best = max(fit, key=lambda s: (own[s], left[s])) if fit else None
            if best:
                left[best] -= 1
            want.append((p, q, best, [s for s in left if own.get(s)]))
    got = grounding.assigned(spark.createDataFrame(questions, "plan string, question string, ordinal int"), spark.createDataFrame(scores, "plan string, question string, section string, score long"), spark.createDataFrame(quotas, "plan string, section string, quota int, place int"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
