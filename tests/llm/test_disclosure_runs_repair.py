"""Operators 11 to 13 by brute force and on odd rows."""

import hashlib
import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tidegraph.llm import disclosure, periodic_runs, repair_turns

DOCS = "doc_id long, text string"
TURNS = "conv_id long, turn long, role string, text string"


# 11


def test_terms_that_reveal_are_marked_wherever_they_are(spark):
    rows = [(i, f"{w} call Zorblat of Acme at +1 (017) 555-7713 or zor@x.example.com {w}") for i, w in enumerate("uno due tre quattro cinque".split())]
    rows += [(20 + i, "acme sells of late " + str(i)) for i in range(1000)]
    odd = [(10, None), (11, ""), (None, "the Zorblat, zorblat zorblat@b.co and Acme 1.2.3.4, 4111-1111-1111-1111"), (12, "x" * 50_000 + " Zorblat"), (12, "x" * 50_000 + " Zorblat")]
    docs = spark.createDataFrame(rows + odd, DOCS).withColumn("h", F.lit(1)).withColumn("term", F.lit("t"))
    got = sorted(disclosure.disclosed(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) + 5
    assert [(x.start, x.end, x.value) for x in by[None].term] == [(4, 11, "Zorblat"), (13, 20, "zorblat")]  # not in the address
    assert [x.value for x in by[None].card] == ["4111-1111-1111-1111"] and [x.value for x in by[None].ip] == ["1.2.3.4"] and [x.value for x in by[None].email] == ["zorblat@b.co"]
    assert [(x.start, x.end) for x in by[12].term] == [(50_001, 50_008)]
    assert all(not by[i].term for i in (10, 11, 25)) and "Acme" not in {x.value for r in got for x in r.term}
    # of all documents eight hold the term, five of them the address near it
    n, df, both, holds = len(rows) + 5, 8, 5, 5
    assert {round(x.disclosure, 9) for x in by[None].term} == {round(math.log(n * both / (df * holds)) / math.log(n / holds), 9)}
    texts = {r.doc_id: r.text for r in disclosure.sanitised(docs).collect()}
    assert "@" not in texts[None] and "Zorblat" not in texts[None] and texts[25] == "acme sells of late 5" and texts[10] == ""
    assert disclosure.disclosed(docs.limit(0)).count() == 0


def test_patterns_are_those_of_the_contract(spark):
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    def ok(kind, v):
        d = re.sub("[^0-9]", "", v)
        return {"email": True, "ip": all(int(x) <= 255 for x in v.split(".")) if kind == "ip" else True, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]

    rng = random.Random(4)
    bits = ["a.b@c.d", "@", ".", "x@y.z-1.q", "+", "1", "255", "256", "1.2.3.4", "4111111111111111", "4111 1111-1111 1111", "+1 (017) 555-7713", " ", "-", "é", "00.1.2.3", "+123456789", "5", "\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    got = disclosure.with_entities(spark.createDataFrame(enumerate(texts), DOCS)).collect()
    for r in got:
        for kind, p in plain.items():
            want = [(m.start(), m.end()) for m in re.finditer(p, r.text) if ok(kind, m.group())]
            assert [(x.start, x.end) for x in r[kind]] == want, (kind, r.text)


# 12


def runs_by_hand(w):
    n, best = len(w), {}
    for q in range(1, n // 3 + 1):
        i = q
        while i < n:
            j = i
            while j < n and w[j] == w[j - q]:
                j += 1
            if j > i and j - i + q >= max(24, 3 * q):
                best.setdefault((i - q, j), q)
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in best.items()), key=lambda r: (r[0], r[2]))


def test_runs_by_brute_force(spark):
    rng, texts = random.Random(1), []
    for t in range(300):
        words = []
        for _ in range(rng.randint(0, 5)):
            p = [rng.choice("abcdefgh"[: rng.choice([1, 2, 4, 8])]) for _ in range(rng.randint(1, 60))]
            words += (p * 200)[: rng.randint(1, 200)]
        texts.append(rng.choice([" ", "\n", "\t "]).join(words) if t % 7 else " ".join(rng.choice("ab") for _ in range(80)))
    docs = spark.createDataFrame([*enumerate(texts), (1000, None), (1001, ""), (1002, " \n"), (None, "a " * 24), (5, texts[5]), (1003, "u v " * 60_000)], DOCS).withColumn("runs", F.lit(1))
    found = 0
    for r in periodic_runs.with_runs(docs).collect():
        if r.doc_id == 1003:
            assert [tuple(x) for x in r.runs] == [(0, 120_000, 2)] and r.collapsed == "u v"
            continue
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        want = runs_by_hand(words)
        dropped = {i for s, n, q in want for i in range(s + q, s + n)}
        assert [tuple(x) for x in r.runs] == want and r.collapsed == " ".join(w for i, w in enumerate(words) if i not in dropped)
        found += len(want)
    assert found > 100 and periodic_runs.with_runs(docs.limit(0)).count() == 0


# 13


def cheapest(faults, initials):
    """The cheapest audit, the least of these, of all strings of edits up to a length."""
    best, n = None, len(faults)
    for size in range(n + 3):
        for audit in itertools.product("DIKR", repeat=size):
            if sum(e != "I" for e in audit) != n:
                continue
            cost, state, i, ok = 0, 0, 0, True
            for e in audit:
                given = None
                if e == "I":
                    cost, given = cost + 5, "uuau"[state]
                else:
                    fault, own = faults[i], initials[i]
                    i += 1
                    if e == "D":
                        cost += 2
                    else:
                        cost += (e == "R") + 5 * (fault == "truncated")
                        given = own if e == "K" else "uuau"[state]
                        ok &= fault not in ("blank", "duplicate")
                if given is not None:
                    state = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((state, given))
                    if state is None:
                        ok = False
                if not ok:
                    break
            if ok and state in (0, 3):
                best = min(best or (10**9, ""), (cost, "".join(audit)))
    return best


def test_repairs_by_all_edits(spark):
    rng, rows, convs = random.Random(2), [], {}
    for c in range(60):
        rows_of = [(t if rng.random() < 0.9 else t + 1, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(["Yes.", "no", "", " \n", "What? ", f"a{t}.", f"b{t}!", None])) for t in range(rng.randint(1, 5))]
        convs[c] = rows_of
        rows += [(c, *r) for r in rows_of]
    rows += [(None, None, "user", "hello."), (None, 3, "assistant", "there."), (None, 3, "assistant", "there.")]
    frame = spark.createDataFrame(rows, TURNS).withColumn("place", F.lit(0))
    got = {r.conv_id: r for r in repair_turns.report(frame).collect()}
    assert got[None].audit == "KKD" and got[None].duplicate == 1 and got[None].gaps == 0 and len(got) == 61
    for c, rows_of in convs.items():
        seen, faults, initials = set(), [], []
        key = lambda r: (r[0], r[1], hashlib.md5(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).hexdigest())
        for _, role, text in sorted([(t, " " if a is None else a, " " if b is None else b) for t, a, b in rows_of], key=key):
            end = text.rstrip(" \t\n\v\f\r")
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
            seen.add((role, text))
            initials.append(role[:1])
        assert (got[c].cost, got[c].audit) == cheapest(faults, initials)
        assert (got[c].blank, got[c].duplicate, got[c].truncated) == tuple(faults.count(f) for f in ("blank", "duplicate", "truncated"))
    assert repair_turns.report(frame.limit(0)).count() == 0


@pytest.mark.parametrize("parts", ["1", "7"])
def test_a_conversation_over_many_ranges_is_repaired_as_in_one(spark, parts):
    rng = random.Random(6)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "no", "", f"line {t}."])) for t in range(3000)] + [(2, t, "user", "ok.") for t in range(40)]
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        frame = spark.createDataFrame(rows, TURNS)
        got = {r.conv_id: (r.cost, hashlib.sha256(r.audit.encode()).hexdigest(), r.repaired_sha256) for r in repair_turns.report(frame).collect()}
        lines = repair_turns.repaired(frame).orderBy("conv_id", "part", "place", "nth").where("conv_id = 1").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])
    assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in lines).encode()).hexdigest() == got[1][2]
    assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in lines))
    again = test_a_conversation_over_many_ranges_is_repaired_as_in_one.__dict__.setdefault("seen", got)
    assert again == got
