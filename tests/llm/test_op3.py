import hashlib
import random
import re

import pytest

from studyloom.llm import op3_pii as P

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(s):
    return re.sub("[^0-9]", "", s)


def brute(t):
    return {
        "email": [m.span() for m in EMAIL.finditer(t)],
        "ip": [m.span() for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))],
        "card": [m.span() for m in CARD.finditer(t) if 14 <= len(digits(m.group())) <= 19 and P.luhn(digits(m.group()))],
        "phone": [m.span() for m in PHONE.finditer(t) if 10 <= len(digits(m.group())) <= 15],
    }


def test_plain_spans_are_those_of_the_patterns():
    rng = random.Random(1)
    parts = ["a", "b.", "@", "@", ".", "1", "2", "25", "0", " ", "-", "+", "(", ")", "256", "4111 1111 1111 1111", "é", "+1", "😀"]
    for _ in range(8000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert P.plain(t) == brute(t), t


def found(text):
    base, every = P.spans(text)
    return [(text[a:b], k) for a, b, k in every]


def test_disguises_map_back_to_their_source():
    assert found("mail john.doe [at] example [dot] com now") == [("john.doe [at] example [dot] com", "email")]
    assert found("jane at mail dot example dot org") == [("jane at mail dot example dot org", "email")]
    assert found("usеr@exаmple.com 😀") == [("usеr@exаmple.com", "email")]
    assert found("call plus one two three four five five five one two three four now") == [("plus one two three four five five five one two three four", "phone")]
    assert found("ip one nine two dot one six eight dot zero dot one.") == [("one nine two dot one six eight dot zero dot one", "ip")]
    assert found("４１１１ １１１１ １１１１ １１１１") == [("４１１１ １１１１ １１１１ １１１１", "card")]


def test_prose_stays_alone_and_plain_spans_stay():
    assert found("Look at the dot on it, un deux et un point, one two three at home.") == []
    assert found("+1 (988) 555-2485 one two") == [("+1 (988) 555-2485", "phone")]


def test_long_runs_are_linear():
    for t in ("1" * 200_000, "a" * 200_000, "1." * 100_000, "+1" * 50_000, "one " * 20_000, "+1" + "(" * 100_000, "a@" * 50_000):
        P.spans(t)


def test_query_columns(spark, odd_docs, no_docs):
    docs = odd_docs.unionByName(spark.createDataFrame([(20, "x a@b.c y 1.2.3.4", "en", "s", 1, 1, 1, 1, "x")], odd_docs.schema))
    rows = {r["id"]: r for r in P.detect(docs).collect()}
    assert rows[20]["spans"] == rows[20]["base_spans"] == "email:2:7,ip:10:17"
    assert (rows[20]["n_email"], rows[20]["n_ip"], rows[20]["n_card"], rows[20]["n_added"]) == (1, 1, 0, 0)
    assert rows[4]["spans"] == "" and hashlib.sha256(b"").hexdigest()
    assert P.detect(docs).count() == docs.count() and P.detect(no_docs).count() == 0


@pytest.mark.parametrize(
    "said, tail",
    [
        ("usеr@example.com", "r@example.com"),
        ("john [dot] smith@example.com", "smith@example.com"),
        ("john@mail.example [dot] com", "john@mail.example"),
        ("john dot smith@example.com", "smith@example.com"),
        ("usеr@mail.example [dot] com", "r@mail.example"),
    ],
)
def test_a_disguise_of_a_part_leaves_the_whole_identifier(said, tail):
    text = f"Write to {said}, or 192.168.0.1 today."
    base, every = P.spans(text)
    at, inner = text.index(said), text.index(tail)
    assert base["email"] == [(inner, inner + len(tail))]
    assert (at, at + len(said), "email") in every and (inner, inner + len(tail), "email") in every
    assert len(every) == 3


def test_figures_of_other_scripts_belong_to_the_number():
    text = "Call +1 988 555 248５ now"
    base, every = P.spans(text)
    assert base["phone"] == [(5, 19)] and every == [(5, 19, "phone"), (5, 20, "phone")]
