"""Repair of conversations by the cheapest edits.

A conversation's rows become a signature, a symbol a row (role and fault). Different signatures are sorted by range;
each task walks its own as a prefix trie, depth first: the layers of the dynamic program (the least cost of each state
of the role pattern) are computed once per shared prefix and the answer is read at a signature's end. Texts stay out of
it: they pass once more, sorted, beside their conversation's answer, and are hashed as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_spread, text_slices, write_shared

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States of the pattern (s?(ua)+)?: nothing yet, after s, after u, after a; it may end in the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
#: Where each state goes by an inserted or a re-roled row, and the role of that row.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = ("user", "user", "assistant", "user")
#: Where each state goes by a row that is kept.
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
_FAR = 1 << 60

# --- the dynamic program: a symbol is the role's initial (o: another), upper case if the row is truncated, or x: delete


def _inserted(layer: list[int]) -> list[int]:
    """The layer after any number of inserts."""
    moved = True
    while moved:
        moved = False
        for q in range(4):
            if layer[q] + INSERT < layer[NEXT[q]]:
                layer[NEXT[q]] = layer[q] + INSERT
                moved = True
    return layer


def _edges(q: int, symbol: str) -> Iterator[tuple[str, int, int]]:
    """(edit, cost, state after) of the edits that consume a row, by ASCII."""
    yield "D", DELETE, q
    if symbol != "x":
        more = TRUNCATED if symbol.isupper() else 0
        to = KEPT.get((q, symbol.lower()))
        if to is not None:
            yield "K", KEEP + more, to
        yield "R", REROLE + more, NEXT[q]


FIRST = _inserted([0, _FAR, _FAR, _FAR])


def layer_after(layer: Sequence[int], symbol: str) -> list[int]:
    """Least costs of the states after one row more and any inserts."""
    out = [_FAR] * 4
    for q in range(4):
        for _, cost, to in _edges(q, symbol):
            out[to] = min(out[to], layer[q] + cost)
    return _inserted(out)


def answer(layers: Sequence[Sequence[int]], signature: str) -> tuple[int, str]:
    """(cost, audit): back over the edges that cost no more than need be, then forth by the smallest letter."""
    cost = min(layers[-1][q] for q in ENDS)
    good: list[set[int]] = [set() for _ in layers]
    good[-1] = {q for q in ENDS if layers[-1][q] == cost}
    for i in range(len(signature), -1, -1):
        here, layer = good[i], layers[i]
        if i < len(signature):
            ahead, symbol = good[i + 1], signature[i]
            here |= {q for q in range(4) for _, c, to in _edges(q, symbol) if to in ahead and layer[q] + c == layers[i + 1][to]}
        for _ in range(3):
            here |= {q for q in range(4) if NEXT[q] in here and layer[q] + INSERT == layer[NEXT[q]]}
    audit, q, i = [], START, 0
    while i < len(signature) or not (q in ENDS and layers[i][q] == cost):
        insert = NEXT[q] in good[i] and layers[i][q] + INSERT == layers[i][NEXT[q]]
        steps = {e: to for e, c, to in _edges(q, signature[i]) if to in good[i + 1] and layers[i][q] + c == layers[i + 1][to]} if i < len(signature) else {}
        if "D" in steps or not insert:
            edit = min(steps)
            q, i = steps[edit], i + 1
        else:
            edit, q = "I", NEXT[q]
        audit.append(edit)
    return cost, "".join(audit)


def solve_sorted(signatures: Iterator[str]) -> Iterator[tuple[str, int, str]]:
    """(signature, cost, audit) of sorted signatures: a walk of their trie, of which the path to the last one is held."""
    path, last = [FIRST], ""
    for s in signatures:
        shared = 0
        while shared < min(len(s), len(last)) and s[shared] == last[shared]:
            shared += 1
        del path[shared + 1 :]
        for symbol in s[shared:]:
            path.append(layer_after(path[-1], symbol))
        last = s
        yield s, *answer(path, s)


def _solve(signatures: DataFrame) -> DataFrame:
    """signature, cost, audit of different signatures."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solved = solve_sorted(s for b in batches for s in b.column(0).to_pylist())
        rows, size = [], 0
        for row in solved:
            rows.append(row)
            size += len(row[0])
            if size > 1 << 20 or len(rows) == 10_000:
                yield _batch(rows)
                rows, size = [], 0
        yield _batch(rows)

    def _batch(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))], ["signature", "cost", "audit"])

    return signatures.repartitionByRange("signature").sortWithinPartitions("signature").mapInArrow(walk, "signature string, cost long, audit string")


# --- rows and faults

_INK = r"[^\x20\x09-\x0D]"


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone after the damage that crc32 of `conv_id:turn` mod 20 names (nulls: one space); a dropped row stays as gone."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    rows = rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copy", "copies")


def with_faults(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, gone) with at (place in the conversation), initial, fault (blank, duplicate, truncated or none).

    A conversation's rows stand by turn (nulls first), rows of equal turn by role and text.
    """
    initial = F.substring("role", 1, 1)
    in_order = Window.partitionBy("conv_id", "gone").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    same = Window.partitionBy("conv_id", "gone", "role", "mark").orderBy("at")
    rows = rows.withColumn("mark", F.sha2("text", 256)).withColumn("at", F.row_number().over(in_order).cast("long")).withColumn("nth", F.row_number().over(same))
    fault = (
        F.when(~F.col("text").rlike(_INK), "blank").when(F.col("nth") > 1, "duplicate").when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated").otherwise("")
    )
    return rows.select("conv_id", "turn", "role", "text", "gone", "at", initial.alias("initial"), fault.alias("fault"))


def _symbol() -> Column:
    letter = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    return F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)


def counts_and_signatures(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, signature of each conversation of rows with faults."""
    in_order = Window.partitionBy("conv_id", "gone").orderBy("at")
    pair = F.concat(F.lag("initial").over(in_order), F.col("initial"))
    fresh = F.col("turn").isNotNull() & ~F.coalesce(F.lag("turn").over(in_order) == F.col("turn"), F.lit(False))
    rows = rows.drop("text", "role").withColumn("pair", pair).withColumn("fresh", fresh).withColumn("symbol", _symbol()).where("not gone or at = 1")
    here = ~F.col("gone")
    n = lambda c: F.count_if(here & c)
    turns = F.when(here, F.col("turn"))
    found = rows.groupBy("conv_id").agg(
        F.coalesce(F.max(turns) - F.min(turns) + 1 - n(F.col("fresh")), F.lit(0)).cast("long").alias("gaps"),
        *[n(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
        n(~F.col("pair").isin("su", "ua", "au")).alias("illegal"),
        F.array_sort(F.collect_list(F.when(here, F.struct("at", "symbol")))).alias("symbols"),
    )
    return found.withColumn("signature", F.array_join(F.transform("symbols", lambda x: x["symbol"]), "")).drop("symbols")


_ANSWER = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def _repaired(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """conv_id, the columns of answers and the hash of the repaired rows.

    Answers stand as rows of place 0 before their conversation's own; sorted partitions are read as a stream, so that
    a conversation of any length holds no memory.
    """
    types = dict(answers.dtypes)
    body = rows.where("not gone").select("conv_id", "at", "role", "text", F.lit(None).cast(answers.select(F.struct(*_ANSWER)).schema[0].dataType).alias("answer"))
    head = answers.select("conv_id", F.lit(0).cast("long").alias("at"), F.lit("").alias("role"), F.lit("").alias("text"), F.struct(*_ANSWER).alias("answer"))
    lines = head.unionByName(body).repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "at")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        now: dict = {}

        def put(line: bytes) -> None:
            now["hash"].update(line if now["first"] else b"\n" + line)
            now["first"] = False

        def inserts() -> None:
            audit = now["answer"]["audit"]
            while now["next"] < len(audit) and audit[now["next"]] == "I":
                put(ROLE[now["state"]].encode() + b":")
                now["state"] = NEXT[now["state"]]
                now["next"] += 1

        def close() -> None:
            if now:
                inserts()
                done.append((now["conv_id"], *(now["answer"][c] for c in _ANSWER), now["hash"].hexdigest()))

        def out() -> pa.RecordBatch:
            kinds = [schema.field("conv_id").type, *[pa.string() if c == "audit" else pa.int64() for c in _ANSWER], pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate(kinds)], ["conv_id", *_ANSWER, "repaired_sha256"])

        schema = None
        for batch, texts in text_slices(batches):
            schema = batch.schema
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "at", "role", "answer")]
            for conv_id, at, role, reply, text in zip(*columns, texts, strict=True):
                if at == 0:
                    close()
                    now = {"conv_id": conv_id, "answer": reply, "hash": hashlib.sha256(), "first": True, "next": 0, "state": START}
                    continue
                inserts()
                edit, q = now["answer"]["audit"][now["next"]], now["state"]
                now["next"] += 1
                if edit == "K":
                    put(role.encode() + b":" + text)
                    now["state"] = KEPT[q, role[:1]]
                elif edit == "R":
                    put(ROLE[q].encode() + b":" + text)
                    now["state"] = NEXT[q]
            if len(done) >= 5_000:
                yield out()
                done.clear()
        close()
        if schema is not None:
            yield out()

    return lines.mapInArrow(stream, f"conv_id {types['conv_id']}, " + ", ".join(f"{c} {types[c]}" for c in _ANSWER) + ", repaired_sha256 string")


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation.

    rows: conv_id, turn, role, text, gone. Edits: keep a row (0), give it the role user or assistant (2), delete it (3;
    blank and duplicate rows must go), insert an empty row of user or assistant (2); a truncated row that is not deleted
    adds 1. The cheapest edits give role initials (s?(ua)+)?, of equal ones the audit that is least in ASCII. A null
    conv_id is a conversation of its own, roles of other initials can only be re-roled or go. No rows but gone ones:
    zeros, no audit, the hash of nothing. Repeated rows are duplicates. Very long texts and conversations pass as
    streams; one symbol a row is what is gathered of a conversation. Extra columns do not matter. Empty table: no rows.
    """
    rows = write_shared(with_faults(rows.select("conv_id", "turn", "role", "text", "gone")), "repair-rows")
    found = write_shared(counts_and_signatures(rows), "repair-signatures")
    load = found.groupBy("signature").agg(F.count("*").alias("load"))
    load = write_shared(load, "repair-loads")
    solved = _solve(load.select("signature")).join(load, "signature")
    answers = join_spread(found, write_shared(solved, "repair-answers"), ["signature"], "load", found.count()).drop("load", "signature")
    return _repaired(rows, answers)


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """repair() of the rows that damage leaves; nulls in role and text are one space."""
    return repair(damaged(conversations))
