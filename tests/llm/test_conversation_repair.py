"""Repairs against all edits of short conversations, a path search over long ones, whole results by plain code."""
import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from qamill.llm import conversation_repair as R
from tests.conftest import SF_SMALL

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def all_edits(rows):
    """(cost, audit) by trying every edit of every row and up to two insertions between rows."""
    choices = [["D"] if r == "d" else ["D", "K", "Ru", "Ra"] for r in rows]
    best = None
    for picks in itertools.product(*choices):
        for gaps in itertools.product(("", "u", "a", "ua", "au"), repeat=len(rows) + 1):
            roles, audit, cost = "", "", 0
            for k, gap in enumerate(gaps):
                roles, audit, cost = roles + gap, audit + "I" * len(gap), cost + 2 * len(gap)
                if k < len(rows):
                    p = picks[k]
                    audit += p[0]
                    if p == "D":
                        cost += 3
                    else:
                        roles += rows[k][0] if p == "K" else p[1]
                        cost += (p != "K") * 2 + (rows[k][1:] == "!")
            if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def relaxed(rows):
    """(cost, audit) by relaxing whole audits until nothing changes."""
    moves = {("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a", ("", "s"): "s"}
    layer = {"": (0, "")}
    for k in range(len(rows) + 1):
        for _ in range(4):
            for (a, b), c in moves.items():
                if b != "s" and a in layer:
                    new = layer[a][0] + 2, layer[a][1] + "I"
                    layer[c] = min(layer.get(c, new), new)
        if k == len(rows):
            return min(layer[s] for s in ("", "a") if s in layer)
        after, row = {}, rows[k]
        for s, (cost, audit) in layer.items():
            steps = [(s, cost + 3, audit + "D")]
            if row != "d":
                cut = row[1:] == "!"
                steps += [(moves[s, b], cost + 2 + cut, audit + "R") for b in "ua" if (s, b) in moves]
                if (s, row[0]) in moves:
                    steps.append((moves[s, row[0]], cost + cut, audit + "K"))
            for t, c, x in steps:
                after[t] = min(after.get(t, (c, x)), (c, x))
        layer = after
    return None


CODES = ["d", "s", "u", "a", "-", "u!", "a!", "s!", "-!"]


def test_short_conversations_against_all_edits():
    for n in range(3):
        for rows in itertools.product(CODES, repeat=n):
            assert R.cheapest(list(rows)) == all_edits(rows), rows
    rng = random.Random(1)
    for _ in range(40):
        rows = rng.choices(CODES, k=3)
        assert R.cheapest(rows) == all_edits(rows), rows


def test_longer_conversations_against_relaxation():
    rng = random.Random(2)
    for n in (4, 5, 7, 12, 30, 90):
        for _ in range(60):
            rows = rng.choices(CODES, weights=[1, 1, 6, 6, 1, 2, 2, 1, 1], k=n)
            assert R.cheapest(rows) == relaxed(rows), rows
    assert R.cheapest(["u", "a"] * 5000) == (0, "K" * 10_000)
    assert R.cheapest(["u"] * 2000)[0] == relaxed(["u"] * 2000)[0]


def plain(rows):
    """The contract's result of one conversation's rows (turn, role, text), undamaged, by plain code."""
    conv = rows[0][0]
    after = []
    for _, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        code = zlib.crc32(key.encode()) % 20
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        after += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    if not after:
        return conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()
    codes, seen, n = [], set(), {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in after:
        ink = re.findall(r"[^\x20\x09-\x0d]", text)
        fault = "blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else ""
        seen.add((role, text))
        if fault:
            n[fault] += 1
        codes.append("d" if fault in ("blank", "duplicate")
                     else (role[0] if role[:1] in ("s", "u", "a") else "-") + "!" * (fault == "truncated"))
    turns = [t for t, _, _ in after if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(after, after[1:]))
    cost, audit = relaxed(codes)
    out, k = [], 0
    for letter in audit:
        _, role, text = after[k] if letter != "I" else (0, "", "")
        k += letter != "I"
        if letter != "D":
            out.append((role if letter == "K" else "assistant" if out and out[-1][0][0] == "u" else "user", text))
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, sha


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def results(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=str)


def by_plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    return sorted(map(plain, groups.values()), key=str)


def test_whole_table_against_plain_code(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select(*SCHEMA.split()[::2]).collect()]
    want = by_plain(rows)
    assert results(R.query(spark, SF_SMALL)) == want
    assert sum(r[6] > 0 for r in want) > 5


def test_awkward_rows(spark, monkeypatch):
    rng = random.Random(4)
    texts = ["Yes.", "no", "", " \t\n", None, "Why?", "　", "done! \r", "x" * 50_000 + ".", "ö.\x1c"]
    roles = ["user", "assistant", "system", None, "", "User", "agent", "tool", "support"]
    rows = [(rng.choice([None, 1, 2, 3, 5, 8, 13]), rng.choice([None, 0, 1, 2, 3, 7, -4]), rng.choice(roles), rng.choice(texts))
            for _ in range(160)]
    rows += [(99, k, "user", "same.") for k in range(300)] + [(77, None, None, None)]
    rows += [(k, 0, "user", "Hm.") for k in range(1000, 1060)]   # some are dropped whole
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = by_plain(rows)
    assert any(r[7] == "" and r[6] == 0 for r in want)
    clash = df.withColumn("_conv", F.lit(1)).withColumn("gaps", F.lit("x")).withColumn("_id", F.lit("y"))
    assert results(R.repaired_damage(clash)) == want
    monkeypatch.setattr(R, "SPOOL", 100)   # spooled to disk, in many batches
    assert results(R.repaired_damage(df)) == want
    assert R.repaired_damage(spark.createDataFrame([], SCHEMA)).count() == 0
    messages = R.repair(R.damaged(df)).collect()
    for conv, *_, audit, sha in want:
        own = sorted((m for m in messages if m.conv_id == conv), key=lambda m: m.place)
        assert "".join(m.edit for m in own) == audit.replace("D", "")
        assert hashlib.sha256("\n".join(f"{m.role}:{m.text}" for m in own).encode()).hexdigest() == sha
