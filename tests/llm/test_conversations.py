import hashlib
import heapq
import random
import re

from pyspark.sql import functions as F

from phenogrid.llm import repair
from phenogrid.llm.common import Scratch
from phenogrid.llm.queries import damaged, op11_repair, oracle_sql

SCHEMA = "conv_id long, turn long, role string, text string"


def judged(rows):
    """Rows (turn, role, text) in order with their first fault."""
    seen, out = set(), []
    for turn, role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        out.append((turn, role, text, "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""))
        seen.add((role, text))
    return out


def cheapest(rows):
    """Cost, edits and lines of the best repair, by a search over all edits from the front: cost first, then the edits' text."""
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, edits, i, roles, lines = heapq.heappop(queue)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, edits, lines
        state = i, roles[:1] == "s", len(roles.lstrip("s")) % 2, bool(roles), roles == "s"
        if state in done or len(edits) > 2 * len(rows) + 4:
            continue
        done.add(state)
        next_role = "assistant" if roles.endswith("u") else "user"
        options = [(2, "I", i, roles + next_role[0], (*lines, f"{next_role}:"))]
        if i < len(rows):
            _, role, text, fault = rows[i]
            options.append((3, "D", i + 1, roles, lines))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                options.append((2 + more, "R", i + 1, roles + next_role[0], (*lines, f"{next_role}:{text}")))
                if role[:1] and (role[0] == next_role[0] or role[0] == "s" and not roles):
                    options.append((more, "K", i + 1, roles + role[0], (*lines, f"{role}:{text}")))
        for extra, edit, *rest in options:
            heapq.heappush(queue, (cost + extra, edits + edit, *rest))


def by_definition(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit, digest of one conversation's rows in order."""
    turns = [t for t, _, _ in rows if t is not None]
    marked = judged(rows)
    faults = [f for *_, f in marked]
    initials = [role[:1] for _, role, _ in rows]
    cost, edits, lines = cheapest(marked)
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def drawn_rows(rng, n):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", "unknown"]
    texts = ["One.", "Two!", "Three?", "cut of", "", " \t\n", "End. \n", "a.b"]
    return [(i if rng.random() < 0.9 else i + 7, rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"Text {i}{rng.choice(['.', ''])}") for i in range(0, n)]


def test_solutions_of_signatures():
    """Short strings of all letters against a search; halves put together give what one recursion gives."""
    rng = random.Random(3)
    for _ in range(300):
        rows = drawn_rows(rng, rng.randint(0, 9))
        rows = judged(rows)
        letters = {"": repair.SOUND, "truncated": repair.TRUNCATED, "blank": repair.BLANK, "duplicate": repair.DUPLICATE}
        sig = "".join(letters[f]["sua".find(role[0]) if role else -1] for _, role, _, f in rows)
        ways = repair.solve(sig)[repair.START]
        best = min((w[0] + repair.FINISHED[s][0], w[1] + repair.FINISHED[s][1]) for s, w in enumerate(ways) if w)
        assert best == cheapest(rows)[:2], sig


def test_long_signature_needs_no_deep_recursion():
    ways = repair.solve("sua" + "ua" * 50_000)[repair.START]
    assert ways[repair.ASSISTANT] == (0, "K" * 100_003)


def results(rows):
    found = repair.audits(rows)
    digests = {r["conv_id"]: r["repaired_sha256"] for r in repair.repaired_digests(rows, found).collect()}
    return {r["conv_id"]: (*[r[f] for f in repair.FACTS], r["audit"], digests[r["conv_id"]]) for r in found.collect()}


def test_conversations_by_definition(spark):
    rng = random.Random(11)
    convs = {c: sorted(drawn_rows(rng, rng.randint(1, 14)), key=lambda r: r[0]) for c in range(60)}
    convs = {c: [r for i, r in enumerate(rows) if not i or r[0] != rows[i - 1][0]] for c, rows in convs.items()}
    rows = spark.createDataFrame([(c, *r) for c, rs in convs.items() for r in rs], SCHEMA)
    assert results(rows.repartition(5)) == {c: by_definition(r) for c, r in convs.items()}


def test_conversation_in_pieces(spark):
    """One conversation with most rows lies in several ranges; its pieces are solved apart."""
    rng = random.Random(5)
    long_one = [(i, *r[1:]) for i, r in enumerate(drawn_rows(rng, 600))]
    rows = spark.createDataFrame([(1, *r) for r in long_one] + [(2, 0, "user", "Hi.")], SCHEMA)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pieces = repair._pieces(repair._named(rows, "conv_id", "turn", "role", "text"), Scratch(spark))
        assert pieces.where("conv = 1").count() > 1
        got = results(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert got == {1: by_definition(long_one), 2: by_definition([(0, "user", "Hi.")])}


def test_odd_rows(spark):
    """Nulls in every column, equal rows, equal turns, an id that is null, long texts, columns with clashing names."""
    rows = [
        (1, None, "user", "First."), (1, 2, None, "Lost role."), (1, 2, "user", None), (1, 3, "assistant", "Yes. " * 20000),
        (2, 5, "user", "Again."), (2, 5, "user", "Again."), (2, 5, "user", "Again."),
        (None, None, None, None), (None, 1, "system", "S."), (3, 1, "assistant", ""),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("conv", F.lit("x")).withColumn("h1", F.lit(1)).withColumn("leads", F.lit(1)).withColumn("audit", F.lit(1))
    space = [[(t, r or " ", " " if x is None else x) for c, t, r, x in rows if c == k] for k in (1, 2, None, 3)]
    space[0].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert results(df) == {k: by_definition(r) for k, r in zip((1, 2, None, 3), space)}
    assert results(df.limit(0)) == {}


def test_repaired_turns(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "There."), (1, 2, "tool", "cut"), (2, 0, "system", " ")], SCHEMA)
    out = repair.repaired(rows, repair.audits(rows)).orderBy("conv_id", "place").collect()
    assert [tuple(r) for r in out] == [(1, 0, 0, "K", "user", "Hi."), (1, 1, None, "I", "assistant", ""), (1, 2, 1, "K", "user", "There."), (1, 3, 2, "R", "assistant", "cut")]
    assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in out))


def test_query_by_definition(spark):
    source = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    convs = {}
    for r in damaged(source).collect():
        convs.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    got = {r[0]: tuple(r)[1:] for r in op11_repair(spark, "/root/testdata/sf0.01").collect()}
    assert got.keys() == {r["conv_id"] for r in source.collect()}
    for c, row in got.items():
        assert row == by_definition(sorted(convs.get(c, []), key=lambda r: (r[0] is not None, r[0] or 0))), c
    assert "op11_repair" in oracle_sql()
