"""Repair of a conversation's structure, solved once for each distinct signature.

A conversation's rows, in the order of their turns, become a string of one letter a row: the role's initial, in capitals if
the text is truncated, or d if the row must go, as blank or repeated. That signature is all that the cheapest repair
depends on. Each distinct one is solved once: its halves give tables of the cheapest edits from each state of the
turn-taking to each other, memoised by their letters, and the tables are joined. Audits, a letter an edit, go back to the
conversations by their signatures, and a second walk over the rows replays them.

Both walks stream over rows sorted by conversation, so a task holds a batch of rows, the signature or audit of one
conversation and, in the first, a digest of each of its distinct rows, never its texts. Only the signatures, of
which a common one is summed in each task first, are joined. A digest of one conversation must be read in order, so its rows meet in one
task however many they are.

Roles are taken by their initials: s, then u and a by turns, the last an a. Edits: K keeps, R gives the role user or
assistant, D deletes, I inserts an empty turn. Of the cheapest repairs the one with the least audit is taken.

Nulls: a null text or role is one space; rows without a turn come first; a null conversation is one of its own. An empty
role fits no place. Rows of one turn go by role, then text; repeated rows are duplicates. Very long texts are one row each. Extra
columns are left out, so their names can't clash. Rows marked as gone only name their conversation; one without others has an
empty repair. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from litmill.llm._base import SPACES, map_rows, materialise, slices, table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States of the turn-taking: nothing yet, after s, after u, after a; the last of a conversation is the first or the fourth.
START, SYSTEM, USER, ASSISTANT = range(4)
#: From each state, what a user's or assistant's turn leads to.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Signatures, and their letters, up to which they are sent to every executor with their audits.
BROADCAST_SIGNATURES, BROADCAST_LETTERS = 200_000, 4_000_000
#: Letters of a part whose table is remembered, and tables.
PART, PARTS = 16, 4_096

Table = tuple[tuple[tuple[int, str] | None, ...], ...]


def _joined(a: Table, b: Table) -> Table:
    """Cheapest edits through ``a``, then ``b``; of equal costs the least audit."""

    def best(s: int, t: int) -> tuple[int, str] | None:
        ways = [(x[0] + y[0], x, y) for x, y in ((a[s][m], b[m][t]) for m in range(4)) if x and y]
        if not ways:
            return None
        least = min(w[0] for w in ways)
        return least, min(x[1] + y[1] for c, x, y in ways if c == least)

    return tuple(tuple(best(s, t) for t in range(4)) for s in range(4))


def _table(edges: dict[tuple[int, int], tuple[int, str]]) -> Table:
    return tuple(tuple(edges.get((s, t)) for t in range(4)) for s in range(4))


NOTHING = _table({(s, s): (0, "") for s in range(4)})
#: Up to two insertions in a row; more only come back to a state.
INSERTIONS = _table({(s, s): (0, "") for s in range(4)} | {(s, NEXT[NEXT[s]]): (2 * INSERT, "II") for s in (START, SYSTEM)} | {(s, t): (INSERT, "I") for s, t in NEXT.items()})


@functools.lru_cache(maxsize=64)
def _letter(letter: str) -> Table:
    found = {(s, s): (DELETE, "D") for s in range(4)}
    if letter != "d":
        late, role = TRUNCATED * letter.isupper(), letter.lower()
        found |= {(s, t): (REROLE + late, "R") for s, t in NEXT.items()}
        found |= {(s, t): (KEEP + late, "K") for s, t in NEXT.items() if ROLES[t][0] == role}
        if role == "s":
            found[START, SYSTEM] = (KEEP + late, "K")
    return _joined(INSERTIONS, _table(found))


@functools.lru_cache(maxsize=PARTS)
def _part(letters: str) -> Table:
    return _halves(letters)


def _halves(letters: str) -> Table:
    if len(letters) < 2:
        return _letter(letters) if letters else NOTHING
    cut = 1 << (len(letters) - 1).bit_length() - 1  # so that parts of equal letters are cut alike
    a, b = (_part(x) if len(x) <= PART else _halves(x) for x in (letters[:cut], letters[cut:]))
    return _joined(a, b)


def solve(signature: str) -> tuple[int, str]:
    """Cost and audit of the cheapest repair."""
    whole = _joined(_halves(signature), INSERTIONS)[START]
    return min(x for x in (whole[START], whole[ASSISTANT]) if x)


def _sorted(rows: DataFrame, *first: str) -> DataFrame:
    order = [F.col(c).asc_nulls_first() for c in ("conv", *first, "turn", "role", "text")]
    return rows.repartition("conv").sortWithinPartitions(*order)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for part in slices(batch):
            yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 1_000, chars: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for r in rows:
        held.append(r)
        size += sum(len(x) for x in r if isinstance(x, str))
        if len(held) >= most or size >= chars:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _faults(text: Column) -> Column:
    """b of a blank text, t of one whose last character is no full stop, else -."""
    bare = F.rtrim(text, F.lit(SPACES))
    return F.when(bare == "", "b").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "t").otherwise("-")


def signatures(rows: DataFrame) -> DataFrame:
    """rows: conv, turn, role, text, gone. Result: conv, signature, gaps, blank, duplicate, truncated, illegal: a row a conversation."""
    kind = to_arrow_type(rows.schema["conv"].dataType)
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal")
    schema = pa.schema([("conv", kind), ("signature", pa.string()), *((c, pa.int64()) for c in counts)])
    narrow = _sorted(rows).select("conv", "turn", F.substring("role", 1, 1).alias("initial"), _faults(F.col("text")).alias("fault"), F.unhex(F.md5(F.concat("role", F.lit(":"), "text"))).alias("digest"), F.octet_length("role").alias("length"), "gone")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        conv, open_ = None, False
        letters, seen, turns, count, before = [], set(), [], {}, None

        def result():
            gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
            return conv, "".join(letters), gaps, *(count.get(c, 0) for c in counts[1:])

        for c, turn, initial, fault, digest, length, gone in _rows(batches):
            if not open_ or c != conv:
                if open_:
                    yield result()
                conv, open_ = c, True
                letters, seen, turns, count, before = [], set(), [], {}, None
            if gone:
                continue
            if turn is not None:
                turns = [turns[0], turn, turns[2] + (turn != turns[1])] if turns else [turn, turn, 1]
            if before is not None and before + initial not in ("su", "ua", "au"):
                count["illegal"] = count.get("illegal", 0) + 1
            before = initial
            name = "blank" if fault == "b" else "duplicate" if (length, digest) in seen else "truncated" if fault == "t" else None
            seen.add((length, digest))  # the length parts role and text
            if name:
                count[name] = count.get(name, 0) + 1
            letter = initial if initial in ("s", "u", "a") else "x"
            letters.append("d" if name in ("blank", "duplicate") else letter.upper() if name else letter)
        if open_:
            yield result()

    return narrow.mapInArrow(lambda batches: _batches(walk(batches), schema), f"conv {dict(rows.dtypes)['conv']}, signature string, " + ", ".join(f"{c} bigint" for c in counts))


def audits(encoded: DataFrame) -> DataFrame:
    """encoded: of signatures(), written. Adds cost and audit."""

    def start():
        def row(signature):
            cost, audit = solve(signature)
            yield signature, cost, audit

        return row

    distinct = encoded.groupBy("signature").agg(F.count("*")).select("signature")
    solved = materialise(map_rows(distinct, "solved string, cost bigint, audit string", start))
    n, letters = solved.agg(F.count("*"), F.coalesce(F.sum(F.length("solved") + F.length("audit")), F.lit(0))).first()
    solved = F.broadcast(solved) if n <= BROADCAST_SIGNATURES and letters <= BROADCAST_LETTERS else solved
    return encoded.join(solved, F.col("signature") == F.col("solved")).drop("solved")


def _replayed(rows: DataFrame, audited: DataFrame, schema: pa.Schema, ddl: str, turn_of) -> DataFrame:
    """``turn_of()`` gives two functions: of a repaired turn and of a conversation's end, each with the rows that it yields."""
    heads = audited.select("conv", F.lit(0).alias("kind"), F.lit(None).cast(dict(rows.dtypes)["turn"]).alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    bodies = rows.where(~F.col("gone")).select("conv", F.lit(1).alias("kind"), "turn", "role", "text")
    both = _sorted(heads.unionByName(bodies), "kind").select("conv", "kind", "role", "text")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        said, ended = turn_of()
        conv, audit, at, state = None, None, 0, START

        def inserted():
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                at, state = at + 1, NEXT[state]
                yield from said(conv, ROLES[state], "")

        for c, kind, role, text in _rows(batches):
            if kind == 0:
                if audit is not None:
                    yield from inserted()
                    yield from ended(conv)
                conv, audit, at, state = c, text, 0, START
                continue
            yield from inserted()
            edit, at = audit[at], at + 1
            if edit == "D":
                continue
            if edit == "K":
                state = SYSTEM if role[0] == "s" else NEXT[state]
            else:
                state = NEXT[state]
                role = ROLES[state]
            yield from said(conv, role, text)
        if audit is not None:
            yield from inserted()
            yield from ended(conv)

    return both.mapInArrow(lambda batches: _batches(walk(batches), schema), ddl)


def repaired_turns(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """conv, place (from 0), role, text: the turns of the repaired conversations."""

    def turn_of():
        places = {}

        def said(conv, role, text):
            place = places.get("at", 0)
            places["at"] = place + 1
            yield conv, place, role, text

        def ended(conv):
            places.clear()
            return ()

        return said, ended

    kind = rows.schema["conv"].dataType
    schema = pa.schema([("conv", to_arrow_type(kind)), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    return _replayed(rows, audited, schema, f"conv {kind.simpleString()}, place bigint, role string, text string", turn_of)


def repaired_digests(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """conv, repaired_sha256: of ``role:text`` of the repaired turns, with line ends between, read in passing."""

    def turn_of():
        import hashlib

        held = []

        def said(conv, role, text):
            if held:
                held[0].update(b"\n")
            else:
                held.append(hashlib.sha256())
            held[0].update(f"{role}:{text}".encode())
            return ()

        def ended(conv):
            yield conv, (held.pop() if held else hashlib.sha256()).hexdigest()

        return said, ended

    kind = rows.schema["conv"].dataType
    schema = pa.schema([("conv", to_arrow_type(kind)), ("repaired_sha256", pa.string())])
    return _replayed(rows, audited, schema, f"conv {kind.simpleString()}, repaired_sha256 string", turn_of)


def filled(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text, gone (false), as the other functions take them."""
    space = F.lit(" ")
    return turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, space).alias("role"), F.coalesce(text, space).alias("text"), F.lit(False).alias("gone"))


def repair(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, place, role, text: the turns of every conversation after its cheapest repair."""
    rows = filled(turns, conv=conv, turn=turn, role=role, text=text)
    audited = audits(materialise(signatures(rows)))
    return repaired_turns(rows, audited).withColumnRenamed("conv", conv)


def damaged(rows: DataFrame) -> DataFrame:
    """rows: of filled(). Some are dropped (gone), emptied, cut, repeated or given another role, as a hash of conversation and turn says."""
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv", "turn")))
    which = F.crc32(name.cast("binary")) % 20
    text = F.when(which == 1, "").when(which == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.when(which == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv", "turn", F.when(which == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (which == 0).alias("gone"), times.alias("_")).drop("_")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(filled(table(spark, sf_dir, "conversations")))
    audited = audits(materialise(signatures(rows)))
    audited = materialise(audited.drop("signature"))
    digests = repaired_digests(rows, audited).withColumnRenamed("conv", "of")
    return audited.join(digests, F.col("conv").eqNullSafe(F.col("of"))).drop("of").withColumnRenamed("conv", "conv_id")


def _values() -> str:
    """The states' edits for each letter, with the insertions before them, as rows of SQL."""
    rows = []
    for letter in ("s", "u", "a", "x", "S", "U", "A", "X", "d"):
        rows += [f"('{letter}', {s}, {t}, {x[0]}, '{x[1]}')" for s, line in enumerate(_letter(letter)) for t, x in enumerate(line) if x]
    return ", ".join(rows)


OP12_SQL = rf"""
WITH RECURSIVE filled AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations
), hashed AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(name, ''), lambda x: ord(x)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, k: xor(c // 2, 3988292384 * (c % 2)))), 4294967295::BIGINT) % 20 AS which FROM filled
), damaged AS (
  SELECT conv_id, turn, CASE WHEN which = 4 THEN 'user' ELSE role END AS role, CASE WHEN which = 1 THEN '' WHEN which = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN which = 3 THEN [0, 1] ELSE [0] END) AS again FROM hashed WHERE which <> 0
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM damaged
), seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again_seen FROM ordered
), faulty AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN again_seen THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault, left(role, 1) AS initial,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM seen
), lettered AS (
  SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'd' WHEN fault IS NULL THEN l ELSE upper(l) END AS letter FROM (SELECT *, CASE WHEN initial IN ('s', 'u', 'a') THEN initial ELSE 'x' END AS l FROM faulty)
), edits(letter, s, t, cost, audit) AS (
  VALUES {_values()}
), best AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS state, {{'cost': 0, 'audit': ''}} AS way FROM lettered
  UNION ALL
  SELECT b.conv_id, b.i + 1, e.t, min({{'cost': (b.way.cost + e.cost)::INTEGER, 'audit': b.way.audit || e.audit}})
  FROM best b JOIN lettered l ON b.conv_id IS NOT DISTINCT FROM l.conv_id AND l.i = b.i + 1 JOIN edits e ON e.letter = l.letter AND e.s = b.state GROUP BY b.conv_id, b.i + 1, e.t
), ends AS (
  SELECT b.conv_id, min(CASE state WHEN 0 THEN way WHEN 3 THEN way WHEN 2 THEN {{'cost': way.cost + {INSERT}, 'audit': way.audit || 'I'}} ELSE {{'cost': way.cost + {2 * INSERT}, 'audit': way.audit || 'II'}} END) AS way
  FROM best b JOIN (SELECT conv_id, max(i) AS n FROM lettered GROUP BY conv_id) z ON b.conv_id IS NOT DISTINCT FROM z.conv_id AND b.i = n GROUP BY b.conv_id
), steps AS (
  SELECT conv_id, unnest(string_split(way.audit, '')) AS edit, unnest(range(length(way.audit))) AS j FROM ends WHERE way.audit <> ''
), placed AS (
  SELECT *, sum((edit <> 'I')::INTEGER) OVER o AS i, sum((edit <> 'D')::INTEGER) OVER o AS turn_no FROM steps WINDOW o AS (PARTITION BY conv_id ORDER BY j)
), told AS (
  SELECT p.conv_id, j, edit, turn_no, role, text, coalesce(max((turn_no = 1 AND edit = 'K' AND initial = 's')::INTEGER) OVER (PARTITION BY p.conv_id), 0) AS led
  FROM placed p LEFT JOIN lettered l ON p.conv_id IS NOT DISTINCT FROM l.conv_id AND p.i = l.i AND edit <> 'I' WHERE edit <> 'D'
), repaired AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (turn_no - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS text FROM told GROUP BY conv_id
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM lettered GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(way.cost, 0) AS BIGINT) AS cost, coalesce(way.audit, '') AS audit, sha256(coalesce(r.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON o.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends e ON o.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN repaired r ON o.conv_id IS NOT DISTINCT FROM r.conv_id
"""
