"""Conversation structure repair by a forward Viterbi pass.

A conversation is well formed if the initials of its roles read (s?(ua)+)?:
at most one system turn, then user and assistant in turn.  The grammar has
four states (nothing yet, after system, after user, after assistant).  Rows
come in order; each layer keeps for every state the least (cost, audit),
where an audit is the string of edits so far: K keep (0), R give the role the
grammar wants (1), D delete (2), I insert an empty user or assistant turn (5).
A row that is blank or a duplicate must be deleted, a truncated one costs 5
more unless it is.  A layer is closed by inserts, of which two are enough:
from any state the others are two inserts away at most.  Equal costs go to
the audit that is least in ASCII.  Two audits of one state and cost are never
one a prefix of the other (what is longer has inserts more, and cost), so the
least audit stays least whatever follows, and a layer is all that is needed.

A layer carries the SHA-256 of what its path has kept so far as well, so the
repaired conversation is known when its last row is, and no text is kept.
Audits are chains that share their beginnings; two of them are compared from
where they part.

Rows of a conversation come sorted to one task (Spark sorts, and spills), and
stream through it: what is held is one Arrow batch, 16 bytes for each
distinct row and a link for each turn of the conversation at hand.  A
conversation is never split over tasks, because its hash is a chain from its
first turn to its last; one that holds a third of all rows takes the time of
its own hash, without texts in memory.  Role and text together tell
duplicates, by a 128-bit digest.

Rows with equal turns are ordered by role, then text.  A row that is repeated
comes out as a duplicate.  A null id is a conversation of its own, null turns
come first and count for no gap, a null role or text is one space.  A role
outside the grammar, the empty one included, cannot be kept.  An empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
#: state -> the state that an initial leads to.
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
#: state -> the turn that the grammar wants next: a role that may be given or inserted, and where it leads.
WANTED = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
LEGAL = {"su", "ua", "au"}
_SOLID = re.compile(r"[^\x20\x09-\x0D]")
_SPACE = " \t\n\v\f\r"


class Audit:
    """One edit behind those of an earlier audit."""

    __slots__ = ("before", "edit", "size")

    def __init__(self, before: Audit | None, edit: str):
        self.before, self.edit = before, edit
        self.size = before.size + 1 if before else 1


def text_of(audit: Audit | None, until: Audit | None = None) -> str:
    """The edits of an audit, those of `until` left out."""
    out = []
    while audit is not until:
        out.append(audit.edit)
        audit = audit.before
    return "".join(reversed(out))


def less(a: Audit | None, b: Audit | None) -> bool:
    """Whether audit a comes before b in ASCII."""
    x, y = a, b
    while x is not y:
        if y is None or x is not None and x.size > y.size:
            x = x.before
        elif x is None or y.size > x.size:
            y = y.before
        else:
            x, y = x.before, y.before
    return text_of(a, x) < text_of(b, x)


class Repair:
    """The state of one conversation while its rows come by."""

    def __init__(self) -> None:
        self.seen: set[bytes] = set()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.last = None  # of turns; the last one's role initial is `initial`
        self.initial: str | None = None
        # For each state that can be reached: cost, audit, hash of the kept rows, whether there are any.
        self.layer = {START: (0, None, hashlib.sha256(), False)}
        self.close()

    def offer(self, layer: dict, state: int, cost: int, before: tuple, edit: str, row: bytes | None) -> None:
        """A way into a state; the row is hashed once the way has won."""
        have = layer.get(state)
        if have is not None and cost > have[0]:
            return
        audit = Audit(before[1], edit)
        if have is None or cost < have[0] or less(audit, have[1]):
            layer[state] = (cost, audit, before, row)

    @staticmethod
    def settle(layer: dict) -> dict:
        """Each winner with the hash of its rows."""
        out = {}
        for state, (cost, audit, before, row) in layer.items():
            sha, any_row = before[2], before[3]
            if row is not None:
                sha = sha.copy()
                sha.update(b"\n" + row if any_row else row)
                any_row = True
            out[state] = (cost, audit, sha, any_row)
        return out

    def close(self) -> None:
        """Two rounds of inserts."""
        for _ in range(2):
            ways: dict = {}
            for state, now in self.layer.items():
                role, to = WANTED[state]
                have = self.layer.get(to)
                cost = now[0] + INSERT
                if have is None or cost <= have[0]:
                    if have is not None and cost == have[0] and not less(Audit(now[1], "I"), have[1]):
                        continue
                    self.offer(ways, to, cost, now, "I", f"{role}:".encode())
            if not ways:
                return
            self.layer.update(self.settle(ways))

    def row(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None:
            if self.low is None:
                self.low = turn
            if self.last is None or turn != self.last:
                self.turns += 1
            self.high = self.last = turn
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in LEGAL:
            self.illegal += 1
        self.initial = initial
        data = text.encode()
        gone, extra = True, 0
        if not _SOLID.search(text):
            self.blank += 1
        else:
            name = role.encode()
            key = hashlib.blake2b(b"%d:%b%b" % (len(name), name, data), digest_size=16).digest()
            if key in self.seen:
                self.duplicate += 1
            else:
                self.seen.add(key)
                gone = False
                if text.rstrip(_SPACE)[-1] not in ".!?":
                    self.truncated += 1
                    extra = TRUNCATED
        ways: dict = {}
        for state, now in self.layer.items():
            self.offer(ways, state, now[0] + DELETE, now, "D", None)
            if gone:
                continue
            if initial and (to := NEXT[state].get(initial)) is not None:
                self.offer(ways, to, now[0] + KEEP + extra, now, "K", role.encode() + b":" + data)
            new, to = WANTED[state]
            self.offer(ways, to, now[0] + REROLE + extra, now, "R", new.encode() + b":" + data)
        self.layer = self.settle(ways)
        self.close()

    def result(self) -> tuple:
        """gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
        ends = [self.layer[s] for s in (START, ASSISTANT) if s in self.layer]
        best = ends[0]
        for e in ends[1:]:
            if e[0] < best[0] or e[0] == best[0] and less(e[1], best[1]):
                best = e
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, best[0], text_of(best[1]), best[2].hexdigest()


_RESULT = [("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]


def damaged(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, turn, role, text, here): what crc32("id:turn") % 20 does to each row.

    0 drops it (here is false, and the row stays for its id's sake), 1 empties
    its text, 2 takes . ! ? out of it, 3 repeats it, 4 makes it the user's.
    """
    blank = F.lit(" ")
    turn = F.col(turn_col).cast("long")
    named = F.concat(F.coalesce(F.col(id_col).cast("string"), blank), F.lit(":"), F.coalesce(F.col(turn_col).cast("string"), blank))
    at = rows.select(F.col(id_col).alias("id"), turn.alias("turn"), F.coalesce(F.col(role_col), blank).alias("role"), F.coalesce(F.col(text_col), blank).alias("text"), (F.crc32(named) % 20).cast("int").alias("harm"))
    text = F.when(F.col("harm") <= 1, "").when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("harm") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("harm") == 3, F.array(F.lit(True), F.lit(True))).otherwise(F.array(F.col("harm") != 0)))
    return at.select("id", "turn", role.alias("role"), text.alias("text"), copies.alias("here"))


def repaired(rows: DataFrame) -> DataFrame:
    """One row for each id of (id, turn, role, text, here), with its faults, the cheapest audit and what it leaves."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, ids, out = None, None, [], []

        def sent(id_type: pa.DataType) -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, (_, t) in zip(zip(*out), _RESULT)]
            batch = pa.record_batch([pa.array(ids, id_type), *columns], names=["id", *(n for n, _ in _RESULT)])
            ids.clear()
            out.clear()
            return batch

        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for key, turn, role, text, here in zip(*(part.column(i).to_pylist() for i in range(5))):
                    if state is None or key != now:
                        if state is not None:
                            ids.append(now)
                            out.append(state.result())
                        now, state = key, Repair()
                    if here:
                        state.row(turn, role, text)
                if len(out) >= 512:
                    yield sent(id_type)
        if state is not None:
            ids.append(now)
            out.append(state.result())
            yield sent(id_type)

    kinds = {pa.int64(): "long", pa.string(): "string"}
    schema = f"id {kind}, " + ", ".join(f"{n} {kinds[t]}" for n, t in _RESULT)
    return rows.repartition("id").sortWithinPartitions("id", F.col("turn").asc_nulls_first(), "role", "text").select("id", "turn", "role", "text", "here").mapInArrow(run, schema)


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))).withColumnRenamed("id", "conv_id")


def _sql() -> str:
    """The same layers as a recursive query: a state is a struct of cost, audit and kept rows, and the least struct wins."""

    def edit(s: str, cost: str, letter: str, row: str) -> str:
        return f"CASE WHEN {s} IS NULL THEN NULL ELSE {{'c': {s}.c + {cost}, 'a': {s}.a || '{letter}', 't': {s}.t || {row}}} END"

    def least(*ways: str) -> str:
        return f"list_min(list_filter([{', '.join(ways)}], lambda x: x IS NOT NULL))"

    given, kept = "chr(10) || '{}:' || text", "chr(10) || role || ':' || text"
    delete = [edit(f"s{i}", "2", "D", "''") for i in range(4)]

    def stay(s: str, initial: str) -> str:
        return f"CASE WHEN NOT gone AND left(role, 1) = '{initial}' THEN {edit(s, 'extra', 'K', kept)} END"

    def rerole(s: str, role: str) -> str:
        return f"CASE WHEN NOT gone THEN {edit(s, '1 + extra', 'R', given.format(role))} END"

    user = [w for s in ("s0", "s1", "s3") for w in (stay(s, "u"), rerole(s, "user"))]

    def insert(s: str, role: str) -> str:
        return edit(s, "5", "I", f"chr(10) || '{role}:'")

    close_u = least("n2", insert("n0", "user"), insert("n1", "user"), insert("n3", "user"))
    return f"""
WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
bytes AS (SELECT DISTINCT name, encode(name) AS b FROM raw),
crc AS (SELECT name, 0 AS i, 4294967295::BIGINT AS c, b FROM bytes
  UNION ALL SELECT name, i + 1, list_reduce([xor(c, ascii(name[i + 1])::BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END), b
  FROM crc WHERE i < length(name)),
harm AS (SELECT name, xor(c, 4294967295) % 20 AS harm FROM crc WHERE i = length(name)),
hurt AS (SELECT conv_id, turn, CASE harm WHEN 4 THEN 'user' ELSE role END AS role,
    CASE harm WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE harm WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))
  FROM raw JOIN harm USING (name)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS again FROM hurt),
faults AS (SELECT *, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, again > 1 AS twice, NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS cut,
    left(lag(role) OVER w, 1) || left(role, 1) AS pair, i > 1 AS later FROM placed WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
steps AS (SELECT conv_id, i, role, text, blank OR twice AS gone, CASE WHEN cut THEN 5 ELSE 0 END AS extra FROM faults),
walk AS (
  SELECT conv_id, 0 AS i, {{'c': 0, 'a': '', 't': ''}} AS s0, NULL::STRUCT(c INTEGER, a VARCHAR, t VARCHAR) AS s1,
    {{'c': 5, 'a': 'I', 't': chr(10) || 'user:'}} AS s2, {{'c': 10, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS s3
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, n0, n1, m2, {least("n3", insert("m2", "assistant"))} FROM (SELECT *, {close_u} AS m2 FROM (
    SELECT w.conv_id, s.i::INTEGER AS i, {delete[0]} AS n0, {least(delete[1], stay("s0", "s"))} AS n1,
      {least(delete[2], *user)} AS n2, {least(delete[3], stay("s2", "a"), rerole("s2", "assistant"))} AS n3
    FROM walk w JOIN steps s ON w.conv_id IS NOT DISTINCT FROM s.conv_id AND s.i = w.i + 1))),
ends AS (SELECT conv_id, {least("s0", "s3")} AS best FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (NOT blank AND twice) AS duplicate, count(*) FILTER (NOT blank AND NOT twice AND cut) AS truncated,
    count(*) FILTER (later AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, best.c::BIGINT AS cost, best.a AS audit, sha256(substr(best.t, 2)) AS repaired_sha256
FROM ends e LEFT JOIN sums s ON e.conv_id IS NOT DISTINCT FROM s.conv_id
"""


SQL = _sql()
