"""Repair of the turns of conversations by solving each signature once.

A conversation's rows, in order, become a string: a letter for each row
tells its role's initial and its first fault.  What a repair costs and which
edits it takes depend on that string alone, so distinct strings are solved
once, by a recursion over halves that remembers what it has solved, and
edits are joined back to their conversations and replayed on the rows.

A string is made of pieces, one for each range of sorted rows that has some
of a conversation.  A piece's solution has the cheapest edits for each state
it may begin in and end in, so a conversation's pieces are solved apart and
then put together.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenogrid.llm.common import Scratch, small_batches

# letters of a row by its role's initial, s, u, a or another: sound, truncated, blank, duplicate
SOUND, TRUNCATED, BLANK, DUPLICATE = "suao", "SUAO", "0123", "4567"
START, SYSTEM, USER, ASSISTANT = range(4)  # the repaired roles so far end in
RETOLD, REMOVED, ADDED, UNFINISHED = 2, 3, 2, 1
FINISHED = {START: (0, ""), SYSTEM: (2 * ADDED, "II"), USER: (ADDED, "I"), ASSISTANT: (0, "")}
LEGAL = {"su", "ua", "au"}
ROLES = {USER: "user", ASSISTANT: "assistant"}
FACTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def after(state: int) -> int:
    """The state after the one role that may be put in or set there."""
    return ASSISTANT if state == USER else USER


def kept(initial: str, state: int) -> int | None:
    """The state after a row is kept, or None where its role may not stand."""
    if initial == "s" and state == START:
        return SYSTEM
    if initial == "u" and state != USER:
        return USER
    return ASSISTANT if initial == "a" and state == USER else None


def _letter(letter: str) -> list[list[tuple[int, str] | None]]:
    """Cheapest edits of one row, with what is put in before it, by state before and after; ties go to the ASCII-least."""
    table: list[list[tuple[int, str] | None]] = [[None] * 4 for _ in range(4)]
    more = UNFINISHED if letter in TRUNCATED else 0
    for start in range(4):
        state, cost, edits = start, 0, ""
        for _ in range(3):  # two added rows in a row lead back to the state before, or from the first states to the last
            options = [(state, cost + REMOVED, edits + "D")]
            if letter in SOUND + TRUNCATED:
                options.append((after(state), cost + RETOLD + more, edits + "R"))
                if (then := kept(letter.lower(), state)) is not None:
                    options.append((then, cost + more, edits + "K"))
            for then, *way in options:
                table[start][then] = min(table[start][then] or tuple(way), tuple(way))
            state, cost, edits = after(state), cost + ADDED, edits + "I"
    return table


MOST_KNOWN = 1 << 14  # solutions that a task remembers


def solve(signature: str, known: dict | None = None) -> list[list[tuple[int, str] | None]]:
    """Cheapest edits of a run of rows by state before and after, from those of its halves; ``known`` remembers solutions."""
    known = {} if known is None else known
    if signature in known:
        return known[signature]
    if not signature:
        return [[(0, "") if i == j else None for j in range(4)] for i in range(4)]
    if len(signature) == 1:
        found = _letter(signature)
    else:
        half = 1 << (len(signature) - 1).bit_length() - 1
        left, right = solve(signature[:half], known), solve(signature[half:], known)
        found = [
            [min(((x[0] + right[m][j][0], x[1] + right[m][j][1]) for m, x in enumerate(left[i]) if x and right[m][j]), default=None) for j in range(4)]
            for i in range(4)
        ]
    if len(known) >= MOST_KNOWN:
        known.clear()
    known[signature] = found
    return found


def roles(signature: str) -> str:
    """The roles' initials that a signature stands for."""
    return signature.translate(str.maketrans(TRUNCATED + BLANK + DUPLICATE, SOUND * 3))


def faults(signature: str) -> tuple[int, int, int, int]:
    """Blank, duplicate and truncated rows, and neighbours whose roles may not follow each other."""
    initials = roles(signature)
    return *(sum(map(signature.count, kind)) for kind in (BLANK, DUPLICATE, TRUNCATED)), sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


def _named(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    return rows.select(rows[conv_col].alias("conv"), rows[turn_col].alias("turn"), F.coalesce(rows[role_col], F.lit(" ")).alias("role"), F.coalesce(rows[text_col], F.lit(" ")).alias("text"))


ORDER = ["turn", "role", "h1", "h2"]


def _hashed(named: DataFrame) -> DataFrame:
    return named.withColumn("h1", F.xxhash64("text")).withColumn("h2", F.xxhash64(F.lit("second"), "text"))


def _pieces(named: DataFrame, scratch: Scratch) -> DataFrame:
    """``conv, part, sig`` and the turns' ``low, high, turns``: the rows of each conversation in each range of all rows."""
    kind = F.expr(r"case when not text rlike '[^\\x20\\x09-\\x0D]' then 2 when text rlike '[.!?][\\x20\\x09-\\x0D]*\\z' then 0 else 1 end")
    rows = _hashed(named).select("conv", *ORDER, kind.alias("kind"))
    rows = scratch.keep(rows.groupBy("conv", *ORDER).agg(F.first("kind").alias("kind"), F.count("*").alias("n")))
    again = rows.groupBy("conv", "role", "h1", "h2").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("times")).where("times > 1")
    again = again.select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("h1").alias("x"), F.col("h2").alias("y"), "first")
    seen = rows.join(again, F.expr("conv <=> c and role = r and h1 = x and h2 = y"), "left")
    seen = seen.select("conv", *ORDER, "kind", "n", F.expr("first is not null and not first.turn <=> turn").alias("seen"), F.expr("coalesce(instr('sua', nullif(substr(role, 1, 1), '')) - 1, -1)").alias("initial"))
    ranged = seen.repartitionByRange("conv", *ORDER).sortWithinPartitions("conv", *ORDER).withColumn("part", F.spark_partition_id())
    conv_type = ranged.schema["conv"].dataType.simpleString()

    def spell(batches):
        held = None

        def done():
            conv, part, letters, turns = held
            spelt = [t for t in turns if t is not None]
            return pa.RecordBatch.from_pydict({"conv": pa.array([conv], type=conv_arrow), "part": pa.array([part], pa.int32()), "sig": ["".join(letters)], "low": pa.array([min(spelt, default=None)], pa.int64()), "high": pa.array([max(spelt, default=None)], pa.int64()), "turns": pa.array([len(spelt)], pa.int64())})

        for batch in batches:
            conv_arrow = batch.schema.field("conv").type
            columns = [batch.column(c).to_pylist() for c in ("conv", "part", "turn", "kind", "n", "seen", "initial")]
            ready = []
            for conv, part, turn, kind, n, again_, initial in zip(*columns):
                if held is None or held[0] != conv:
                    if held is not None:
                        ready.append(done())
                    held = (conv, part, [], [])
                later = BLANK[initial] if kind == 2 else DUPLICATE[initial]
                held[2].append((later if kind == 2 or again_ else (SOUND, TRUNCATED)[kind][initial]) + later * (n - 1))
                if not held[3] or held[3][-1] != turn:
                    held[3].append(turn)
            if ready:
                yield pa.Table.from_batches(ready).combine_chunks().to_batches()[0]
        if held is not None:
            yield done()

    return scratch.keep(ranged.select("conv", "part", "turn", "kind", "n", "seen", "initial").mapInArrow(spell, f"conv {conv_type}, part int, sig string, low long, high long, turns long"))


TABLE = "array<struct<cost: long, edits: string>>"


def _solved(pieces: DataFrame) -> DataFrame:
    """``sig, ways``: the solution of each distinct signature, 16 ways in order of the states before and after."""

    def run(batches):
        kind, known = pa.list_(pa.struct([("cost", pa.int64()), ("edits", pa.string())])), {}
        for batch in small_batches(batches, 1 << 16):
            sigs = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[w and {"cost": w[0], "edits": w[1]} for row in solve(s, known) for w in row] for s in sigs], type=kind)], names=["sig", "ways"])

    return pieces.select("sig").distinct().mapInArrow(run, f"sig string, ways {TABLE}")


def audits(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each conversation: its id, ``FACTS`` as longs, and ``audit``, the initials of its cheapest edits in order.

    Rows go by turn, null ones first, equal turns by role and then by a hash
    of the text, so that equal rows are neighbours.  A null role or text is
    one space; null ids are one conversation.  A row's first fault counts:
    blank (nothing but ASCII white space), duplicate (role and text seen
    earlier), truncated (its last character that is no white space is none
    of ``.!?``).  Edits are Keep, Rerole, Delete (blank and duplicate rows
    must go) and Insert; roles' initials then read ``(s?(ua)+)?``.  Gaps are
    turns missing between the least and the greatest.  Texts may be of any
    length; a conversation may have any number of rows, as long as a string
    holds its audit.  Other columns are not read, whatever their names.  An
    empty table gives an empty one.
    """
    scratch = Scratch(rows.sparkSession)
    pieces = _pieces(_named(rows, conv_col, turn_col, role_col, text_col), scratch)
    solved = pieces.join(_solved(pieces), "sig")
    gathered = solved.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("part", "sig", "low", "high", "turns", "ways"))).alias("pieces"))
    schema = f"conv {rows.schema[conv_col].dataType.simpleString()}, " + "".join(f"{f} long, " for f in FACTS) + "audit string"

    def put_together(batches):
        for batch in small_batches(batches):
            out = {f: [] for f in (*FACTS, "audit")}
            for parts in batch.column(1).to_pylist():
                counts, low, high, turns, last = np.zeros(4, np.int64), None, None, 0, ""
                for p in parts:
                    counts += faults(p["sig"])
                    initials = roles(p["sig"])
                    counts[3] += bool(last) and last + initials[0] not in LEGAL
                    last = initials[-1]
                    if p["low"] is not None:
                        turns += p["turns"] - (high == p["low"])
                        low, high = p["low"] if low is None else low, p["high"]
                best = [FINISHED[s] for s in range(4)]
                for p in reversed(parts):
                    ways = p["ways"]
                    best = [min((w["cost"] + best[j][0], w["edits"] + best[j][1]) for j, w in enumerate(ways[4 * i : 4 * i + 4]) if w) for i in range(4)]
                for name, value in zip(out, (0 if low is None else high - low + 1 - turns, *counts.tolist(), *best[START])):
                    out[name].append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(out[f], type=pa.int64()) for f in FACTS], pa.array(out["audit"], type=pa.string())], names=["conv", *out])

    return gathered.mapInArrow(put_together, schema).withColumnRenamed("conv", conv_col)


def _replayed(batches):
    """Edits of sorted rows, each conversation's audit before its rows: for each row left its conversation, turn, edit, role and text; the conversation alone at its end."""
    conv = audit = None
    at = state = 0

    def added():
        nonlocal at, state
        while audit is not None and at < len(audit) and audit[at] == "I":
            at, state = at + 1, after(state)
            yield conv, None, "I", ROLES[state], ""

    for batch in small_batches(batches):
        for c, leads, turn, role, text in zip(*[batch.column(i).to_pylist() for i in range(5)]):
            if leads:
                if audit is not None:
                    yield from added()
                    yield conv, None, None, None, None
                conv, audit, at, state = c, text, 0, START
                continue
            yield from added()
            edit, at = audit[at], at + 1
            if edit == "R":
                state = after(state)
                role = ROLES[state]
            elif edit == "K":
                state = kept(role[0], state)
            if edit != "D":
                yield conv, turn, edit, role, text
    if audit is not None:
        yield from added()
        yield conv, None, None, None, None


def _in_order(rows: DataFrame, found: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Rows of each conversation in a task, behind the row that has its audit."""
    named = _hashed(_named(rows, *columns)).withColumn("leads", F.lit(False))
    first = found.select(F.col(columns[0]).alias("conv"), F.lit(None).cast(named.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"), F.lit(True).alias("leads"))
    both = named.unionByName(first).repartition("conv").sortWithinPartitions("conv", F.desc("leads"), *ORDER)
    return both.select("conv", "leads", "turn", "role", "text")


def repaired(rows: DataFrame, found: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The turns that ``audits`` of ``rows`` leave: id, ``place`` from 0, ``turn`` (null if put in), ``edit``, ``role``, ``text``."""
    ordered = _in_order(rows, found, (conv_col, turn_col, role_col, text_col))
    types = [ordered.schema[c].dataType.simpleString() for c in ("conv", "turn")]

    def run(batches):
        place, held, size, kinds = 0, [], 0, None

        def batch_of(held):
            return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*held), kinds)], names=["conv", "place", "turn", "edit", "role", "text"])

        def watched():
            nonlocal kinds
            for batch in batches:
                kinds = [batch.schema.field(0).type, pa.int64(), batch.schema.field(2).type, pa.string(), pa.string(), pa.string()]
                yield batch

        for conv, turn, edit, role, text in _replayed(watched()):
            if edit is None:
                place = 0
                continue
            held.append((conv, place, turn, edit, role, text))
            place, size = place + 1, size + len(text) + 64
            if size > 1 << 20:
                yield batch_of(held)
                held, size = [], 0
        if held:
            yield batch_of(held)

    return ordered.mapInArrow(run, f"conv {types[0]}, place long, turn {types[1]}, edit string, role string, text string").withColumnRenamed("conv", conv_col)


def repaired_digests(rows: DataFrame, found: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Id and ``repaired_sha256`` of each conversation of ``audits``: hex SHA-256 of its repaired ``role:text``, joined by newlines.

    A digest goes through its conversation's texts in turn, a slice at a time.
    """
    ordered = _in_order(rows, found, (conv_col, turn_col, role_col, text_col))

    def run(batches):
        kind, state, before = None, hashlib.sha256(), b""
        convs, digests = [], []

        def watched():
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field(0).type
                yield batch

        def made():
            return pa.RecordBatch.from_arrays([pa.array(convs, type=kind), pa.array(digests, type=pa.string())], names=["conv", "repaired_sha256"])

        for conv, _, edit, role, text in _replayed(watched()):
            if edit is None:
                convs.append(conv), digests.append(state.hexdigest())
                state, before = hashlib.sha256(), b""
                if len(convs) == 10_000:
                    yield made()
                    convs, digests = [], []
            else:
                state.update(before + f"{role}:{text}".encode())
                before = b"\n"
        if convs:
            yield made()

    return ordered.mapInArrow(run, f"conv {ordered.schema['conv'].dataType.simpleString()}, repaired_sha256 string").withColumnRenamed("conv", conv_col)
