import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from litmill.llm import repair
from tests import harness

PATTERN = re.compile("(s?(ua)+)?")


def cheapest(rows, room):
    """rows: role initial, fault. Tries every audit with up to ``room`` insertions: cost, audit and roles."""
    found = []

    def go(i, cost, audit, roles, left):
        if found and cost > found[0][0]:
            return
        if i == len(rows):
            if PATTERN.fullmatch("".join(roles)):
                found.append((cost, audit, roles))
                found.sort()
                del found[1:]
        else:
            role, fault = rows[i]
            go(i + 1, cost + 4, audit + "D", roles, left)
            if fault not in ("blank", "duplicate"):
                late = 3 * (fault == "truncated")
                go(i + 1, cost + late, audit + "K", (*roles, role), left)
                for r in "ua":
                    go(i + 1, cost + 3 + late, audit + "R", (*roles, r), left)
        if left:
            for r in "ua":
                go(i, cost + 3, audit + "I", (*roles, r), left - 1)

    go(0, 0, "", (), room)
    return found[0]


def test_audits_agree_with_trying_all():
    letters = {"s": ("s", None), "u": ("u", None), "a": ("a", None), "x": ("x", None), "U": ("u", "truncated"), "d": ("u", "blank")}
    for n in range(5):
        for sig in itertools.product(letters, repeat=n):
            assert repair.solve("".join(sig)) == cheapest([letters[x] for x in sig], 3)[:2], sig


def by_steps(signature):
    """Row by row instead of by halves."""
    now = {0: (0, "")}
    for x in [*signature, None]:
        for _ in range(2):
            for s, (c, a) in list(now.items()):
                t = repair.NEXT[s]
                now[t] = min(now.get(t, (9e9, "")), (c + 3, a + "I"))
        if x is None:
            break
        new = {}
        for s, (c, a) in now.items():
            ways = [(s, c + 4, "D")]
            if x != "d":
                late = 3 * x.isupper()
                t = repair.NEXT[s]
                ways.append((t, c + 3 + late, "R"))
                if repair.ROLES[t][0] == x.lower():
                    ways.append((t, c + late, "K"))
                if x.lower() == "s" and s == 0:
                    ways.append((1, c + late, "K"))
            for t, cost, edit in ways:
                new[t] = min(new.get(t, (9e9, "")), (cost, a + edit))
        now = new
    return min(now[t] for t in (0, 3) if t in now)


def test_long_signatures_by_halves_and_row_by_row():
    rnd = random.Random(4)
    for n in [5, 17, 33, 100, 257, 2000]:
        for _ in range(10):
            sig = "".join(rnd.choices("suaxSUAXd", [1, 5, 5, 1, 1, 2, 2, 1, 2], k=n))
            assert repair.solve(sig) == by_steps(sig)
    cost, audit = repair.solve("ua" * 100_000)
    assert (cost, audit) == (0, "K" * 200_000)


def plain(rows, damage):
    """rows: conv, turn, role, text. What the query returns, by trying all repairs of short conversations."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = []
        for _, turn, role, text in [r for r in rows if r[0] == conv]:
            role, text = " " if role is None else role, " " if text is None else text
            k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            own += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = [], set()
        for _, role, text in own:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
            seen.add((role, text))
        turns = [t for t, *_ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit, roles = cheapest([(r[1][:1] or "?", f) for r, f in zip(own, faults, strict=True)], 4)
        said, i, j = [], 0, 0
        for edit in audit:
            if edit != "D":
                full = {"u": "user", "a": "assistant"}.get(roles[j])
                said.append(f"{own[i][1] if edit == 'K' else full}:{'' if edit == 'I' else own[i][2]}")
                j += 1
            i += edit != "I"
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


SCHEMA = "conv_id bigint, turn bigint, role string, text string, conv string, kind string, gone string, signature string, audit string"


def made(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], SCHEMA)


def odd_rows():
    rnd = random.Random(12)
    texts = ["Hi.", "Yes!", "No", "", " \t", None, "a\nb?", "é. ", "x" * 50]
    rows = [(c, rnd.choice([None, *range(9)]), rnd.choice(["user", "assistant", "system", "tool", None, "", "u"]), rnd.choice(texts)) for c in range(60) for _ in range(rnd.randrange(1, 6))]
    return rows + [(None, None, None, None), (70, 5, "user", "y. " * 100_000), (71, 1, "user", "same."), (71, 1, "user", "same."), (72, -3, "system", "ok."), (72, 9, "user", "ok.")]


def test_query_agrees_with_a_plain_version(spark, tmp_path):
    rows = odd_rows()
    made(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in repair.op12_repair(spark, str(tmp_path)).collect()}
    assert got == plain(rows, True)


def test_repaired_turns_are_those_of_the_digest(spark):
    rows = odd_rows()
    got = {}
    for r in repair.repair(made(spark, rows)).collect():
        got.setdefault(r["conv_id"], []).append((r["place"], f"{r['role']}:{r['text']}"))
    want = plain(rows, False)
    for conv, turns in got.items():
        assert sorted(p for p, _ in turns) == list(range(len(turns)))
        assert hashlib.sha256("\n".join(t for _, t in sorted(turns)).encode()).hexdigest() == want[conv][-1]
    assert {c for c, w in want.items() if w[-1] != hashlib.sha256(b"").hexdigest()} == got.keys()


def test_query_agrees_with_its_sql(spark):
    for sf_dir in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        assert harness.differences(spark, harness.connect(sf_dir), sf_dir, repair.op12_repair, repair.OP12_SQL) == ""


def test_signatures_are_joined_when_they_are_many(spark, sf, monkeypatch):
    want = sorted(map(tuple, repair.op12_repair(spark, sf).collect()))
    monkeypatch.setattr(repair, "BROADCAST_SIGNATURES", 0)
    assert sorted(map(tuple, repair.op12_repair(spark, sf).collect())) == want


def test_long_conversations_and_empty_tables(spark):
    long = spark.range(30_000).select(F.lit(1).cast("bigint").alias("conv_id"), "id", F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), "id", F.lit(".")).alias("text"))
    assert repair.repair(long, turn="id").count() == 30_000
    assert repair.repair(made(spark, odd_rows()).where("false")).count() == 0
