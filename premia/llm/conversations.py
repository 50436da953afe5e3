"""Conversation structure repair: cheapest edits by depth-first branch-and-bound.

A conversation is right when the initials of its roles read `(s?(ua)+)?`. Turns are kept (0), given another role (1),
deleted (2; required for blank and repeated turns) or inserted without text (5); a truncated turn that stays costs 5 more.
Of the cheapest edits, the ASCII-least string of their initials is taken: D, I, K, R.

Turns of a conversation are taken by turn (nulls first), then role, then a digest of the text. Nulls in role or text read
as one space; a role that is empty or starts otherwise than s, u, a cannot be kept. A null key is a conversation of its
own. An empty table has no conversations. Other columns, whatever their names, are ignored.

Conversations pass through tasks as sorted streams: a task holds one byte for each turn of a conversation and its audit,
never its texts. Long conversations are searched in blocks; best edits between the states of a block's ends are joined.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Costs of edits; a truncated turn that is not deleted costs TRUNCATED more.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Turns that are searched as one problem, and turns of each block of a longer conversation.
BLOCK, PART = 48, 10
#: What has been emitted so far: nothing, a system turn, a user turn, an assistant turn last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: States in which a conversation may end.
ENDS = (NOTHING, ASSISTANT)
#: State after a kept turn, by state and initial of its role.
KEPT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: State after a turn whose role is chosen.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: White space between characters that count.
WHITE = " \t\n\x0b\x0c\r"
#: A turn's facts in one character: the initial of a sound turn, its capital if truncated, "-" if it must be deleted.
MUST_GO, OTHER, OTHER_TRUNCATED = "-", "x", "X"
LEGAL = {"su", "ua", "au"}


def facts_cost(turn: str) -> int:
    """The least that any edit of a turn costs."""
    if turn == MUST_GO or turn.isupper():
        return min(DELETE, TRUNCATED)
    return KEEP if turn in "sua" else REROLE


def search(turns: str, entry: int, ends: tuple[int, ...]) -> tuple[int, str, int] | None:
    """(cost, audit, end) of the cheapest, then ASCII-least, edits of `turns` that lead from `entry` to one of `ends`.

    Depth first over an explicit stack. `rest[i]` is a bound on the cost of turns i and on. A node is a number of consumed
    turns and a state; its table entry is the best (cost, audit) that reached it, and a prefix that is no better is
    dropped. That is sound for the audit too: two prefixes of equal cost at a node differ at some character, since one
    that only inserts more costs more, so whatever follows cannot change their order. The search ends when the stack is
    empty: every prefix left out is dominated, or its bound says that it cannot beat the incumbent.
    """
    n = len(turns)
    rest = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        rest[i] = rest[i + 1] + facts_cost(turns[i])
    best: tuple[int, str, int] | None = None
    reached: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, entry, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        if best is not None and (cost + rest[i] > best[0] or (cost + rest[i] == best[0] and audit > best[1][: len(audit)])):
            continue
        known = reached.get((i, state))
        if known is not None and known <= (cost, audit):
            continue
        reached[i, state] = (cost, audit)
        if i == n and state in ends and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, state)
        after = [(i, NEXT[state], cost + INSERT, audit + "I")]
        if i < n:
            turn = turns[i]
            after.append((i + 1, state, cost + DELETE, audit + "D"))
            if turn != MUST_GO:
                more = TRUNCATED if turn.isupper() else 0
                after.append((i + 1, NEXT[state], cost + REROLE + more, audit + "R"))
                kept = KEPT.get((state, turn.lower()))
                if kept is not None:
                    after.append((i + 1, kept, cost + KEEP + more, audit + "K"))
        # the most promising is popped first: least bound, then the ASCII-least edit
        after.sort(key=lambda node: (node[2] + rest[node[0]], node[3]), reverse=True)
        stack.extend(after)
    return best


_block = lru_cache(maxsize=100_000)(search)


def cheapest(turns: str) -> tuple[int, str]:
    """(cost, audit) of a whole conversation; one of over BLOCK turns is searched in blocks of PART."""
    if len(turns) <= BLOCK:
        cost, audit, _ = _block(turns, NOTHING, ENDS)
        return cost, audit
    # by state: cost, and the audit as (audit before the last block, last block's part); how audits of two states compare
    fronts: dict[int, tuple[int, tuple | None]] = {NOTHING: (0, None)}
    order: dict[tuple[int, int], int | tuple[str, str]] = {(NOTHING, NOTHING): ("", "")}
    for at in range(0, len(turns), PART):
        block = turns[at : at + PART]
        chosen: dict[int, tuple[int, int, str]] = {}
        for end in range(4):
            for entry, (cost, _) in fronts.items():
                found = _block(block, entry, (end,))
                if found is None:
                    continue
                new = (cost + found[0], entry, found[1])
                old = chosen.get(end)
                if old is None or new[0] < old[0] or (new[0] == old[0] and _less(_further(order[entry, old[1]], new[2], old[2]))):
                    chosen[end] = new
        order = {(f, g): _further(order[chosen[f][1], chosen[g][1]], chosen[f][2], chosen[g][2]) for f in chosen for g in chosen}
        fronts = {end: (cost, (fronts[entry][1], part)) for end, (cost, entry, part) in chosen.items()}
    ends = [end for end in ENDS if end in fronts]
    best = ends[0]
    for end in ends[1:]:
        if fronts[end][0] < fronts[best][0] or (fronts[end][0] == fronts[best][0] and _less(order[end, best])):
            best = end
    cost, node = fronts[best]
    parts = []
    while node is not None:
        node, part = node
        parts.append(part)
    return cost, "".join(reversed(parts))


def _further(order: int | tuple[str, str], one: str, two: str) -> int | tuple[str, str]:
    """How two audits compare when both go on: -1 or 1 once they differ, else what one of them has beyond the other."""
    if isinstance(order, int):
        return order
    one, two = order[0] + one, order[1] + two
    if one.startswith(two):
        return one[len(two) :], ""
    if two.startswith(one):
        return "", two[len(one) :]
    return -1 if one < two else 1


def _less(order: int | tuple[str, str]) -> bool:
    return order == -1 if isinstance(order, int) else not order[0] and bool(order[1])


def damage(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, gone): turns with faults planted by crc32 of `conv_id:turn` modulo 20.

    0 takes the turn away (`gone`, so that its conversation is still known), 1 empties its text, 2 removes its full stops,
    exclamation and question marks, 3 repeats it, 4 makes it the user's. Nulls read as one space.
    """
    shown = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    fault = F.pmod(F.crc32(F.concat(shown(conv), F.lit(":"), shown(turn)).cast("binary")), F.lit(20))
    rows = turns.select(F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), shown(role).alias("role"), shown(text).alias("text"), fault.alias("fault"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("fault") == 0).alias("gone"),
        F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _turns(turns: DataFrame, conv: str, turn: str, role: str, text: str, gone: str | None) -> DataFrame:
    """(conv, turn, role, text, digest, gone) with nulls read as one space."""
    shown = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    out = F.coalesce(F.col(f"`{gone}`"), F.lit(False)) if gone else F.lit(False)
    rows = turns.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), shown(role).alias("role"), shown(text).alias("text"), out.alias("gone"))
    return rows.withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows of a conversation in one partition and in order; heads of conversations, where there are any, first."""
    first = [F.col("head").desc()] if "head" in rows.columns else []
    return rows.repartition(F.col("conv")).sortWithinPartitions("conv", *first, F.col("turn").asc_nulls_first(), "role", "digest")


def _facts(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, digest, initial, sound, truncated, first, gone), without texts.

    `first` is the least turn at which the conversation has a turn of this role and text: an aggregate, and a join that
    adaptive execution splits, so a text that one conversation repeats endlessly is no group in a task.
    """
    ends: Column = F.rtrim(F.col("text"), F.lit(WHITE))
    ends = F.substring(ends, -1, 1)
    rows = rows.select(
        "conv",
        "turn",
        "role",
        "digest",
        "gone",
        F.substring("role", 1, 1).alias("initial"),
        (ends == "").alias("blank"),
        (~ends.isin(".", "!", "?")).alias("truncated"),
    )
    key = ["conv", "role", "digest"]
    # a null turn comes first of all: present as (0, null), others as (1, turn)
    order = F.struct(F.when(F.col("turn").isNull(), 0).otherwise(1).alias("k"), F.col("turn").alias("turn"))
    firsts = rows.where(~F.col("gone")).groupBy(*[F.col(c).alias(f"{c}_") for c in key]).agg(F.min(order).alias("first"))
    same = [rows[c].eqNullSafe(firsts[f"{c}_"]) for c in key]
    joined = rows.join(firsts, same[0] & same[1] & same[2], "left")
    return joined.select(*rows.columns, (F.col("first.turn").eqNullSafe(F.col("turn"))).alias("at_first"))


_REPORT = pa.schema([(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.large_string())])


class _Conversation:
    """Counts and facts of the conversation that is being read."""

    def __init__(self, conv):
        self.conv, self.turns, self.last, self.least, self.most, self.distinct = conv, bytearray(), None, None, None, 0
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.initial = None

    def add(self, turn, role, digest, initial, blank, truncated, at_first) -> None:
        if turn is not None:
            self.least = turn if self.least is None else self.least
            self.distinct += turn != self.most
            self.most = turn
        if self.initial is not None and self.initial + initial not in LEGAL:
            self.illegal += 1
        same = self.last == (turn, role, digest)
        self.initial, self.last = initial, (turn, role, digest)
        if blank:
            self.blank += 1
            fact = MUST_GO
        elif same or not at_first:
            self.duplicate += 1
            fact = MUST_GO
        else:
            self.truncated += truncated
            fact = (initial if initial in ("s", "u", "a") else OTHER) if not truncated else (initial.upper() if initial in ("s", "u", "a") else OTHER_TRUNCATED)
        self.turns += fact.encode()

    def report(self) -> tuple:
        cost, audit = cheapest(self.turns.decode())
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.distinct
        return min(gaps, 2**63 - 1), self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None) -> DataFrame:
    """One row for each conversation: its key, counts of faults, and cost and audit of the cheapest repair.

    `gone` names a boolean column of turns that count as absent but whose conversation is to be reported.
    """
    facts = _ordered(_facts(_turns(turns, conv, turn, role, text, gone)))
    kind = facts.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, key_type, done = None, None, []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*[(c.conv, *c.report()) for c in done], strict=True))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], key_type)] + [pa.array(v, f.type) for v, f in zip(columns[1:], _REPORT, strict=True)], names=["conv", *_REPORT.names])

        for batch in batches:
            key_type = batch.schema.field("conv").type
            for key, at, who, digest, out, initial, blank, truncated, at_first in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now is None or now.conv != key:
                    if now is not None:
                        done.append(now)
                        if len(done) >= 4096:
                            yield flush()
                    now = _Conversation(key)
                if not out:
                    now.add(at, who, digest, initial, blank, truncated, at_first)
        if now is not None:
            done.append(now)
            yield flush()

    return facts.mapInArrow(run, f"conv {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string").withColumnRenamed("conv", "conv_id")


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(key, edit, role, text) of every turn that a repaired conversation has, in order; (key, None, None, None) when one begins."""
    key, audit, at, state, begun = None, "", 0, NOTHING, False

    def inserted():
        nonlocal at, state
        while audit[at : at + 1] == "I":
            at, state = at + 1, NEXT[state]
            yield key, "I", ROLE[state], ""

    for batch in batches:
        for conv, head, plan, who, said in zip(*[batch.column(c).to_pylist() for c in ("conv", "head", "audit", "role", "text")], strict=True):
            if head:
                if begun:
                    yield from inserted()
                key, audit, at, state, begun = conv, plan, 0, NOTHING, True
                yield key, None, None, None
                continue
            yield from inserted()
            edit, at = audit[at], at + 1
            if edit == "K":
                state = KEPT[state, who[0]]
                yield key, edit, who, said
            elif edit == "R":
                state = NEXT[state]
                yield key, edit, ROLE[state], said
    if begun:
        yield from inserted()


def _with_plans(turns: DataFrame, report: DataFrame, conv: str, turn: str, role: str, text: str, gone: str | None) -> DataFrame:
    rows = _turns(turns, conv, turn, role, text, gone).where(~F.col("gone")).drop("gone").withColumns({"head": F.lit(False), "audit": F.lit(None).cast("string")})
    heads = report.select(F.col("conv_id").alias("conv"), F.lit(True).alias("head"), "audit")
    return _ordered(rows.unionByName(heads, allowMissingColumns=True)).select("conv", "head", "audit", "role", "text")


def repaired(turns: DataFrame, report: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None) -> DataFrame:
    """(conv_id, position, edit, role, text) of the turns of all repaired conversations; `report` is `repair`'s."""
    rows = _with_plans(turns, report, conv, turn, role, text, gone)
    kind = rows.schema["conv"].dataType.simpleString()

    def run(batches):
        key_type, out, position, size = None, [], 0, 0

        def types(batches):
            nonlocal key_type
            for batch in batches:
                key_type = batch.schema.field("conv").type
                yield batch

        def flush() -> pa.RecordBatch:
            nonlocal size
            columns = list(zip(*out, strict=True))
            out.clear()
            size = 0
            kinds = (key_type, pa.int64(), pa.string(), pa.large_string(), pa.large_string())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds, strict=True)], names=["conv_id", "position", "edit", "role", "text"])

        for key, edit, who, said in _applied(types(batches)):
            if edit is None:
                position = 0
                continue
            position += 1
            out.append((key, position, edit, who, said))
            size += len(said)
            if len(out) >= 8192 or size >= 4 << 20:
                yield flush()
        if out:
            yield flush()

    return rows.mapInArrow(run, f"conv_id {kind}, position long, edit string, role string, text string")


def digests(turns: DataFrame, report: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None) -> DataFrame:
    """(conv_id, repaired_sha256): SHA-256 of `role:text` of the repaired turns, joined by line feeds, read as a stream."""
    rows = _with_plans(turns, report, conv, turn, role, text, gone)
    kind = rows.schema["conv"].dataType.simpleString()

    def run(batches):
        key_type, done, now, hashed, empty = None, [], None, None, True

        def types(batches):
            nonlocal key_type
            for batch in batches:
                key_type = batch.schema.field("conv").type
                yield batch

        def flush() -> pa.RecordBatch:
            keys, values = zip(*done, strict=True)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, key_type), pa.array(values, pa.string())], names=["conv_id", "repaired_sha256"])

        for key, edit, who, said in _applied(types(batches)):
            if edit is None:
                if hashed is not None:
                    done.append((now, hashed.hexdigest()))
                    if len(done) >= 8192:
                        yield flush()
                now, hashed, empty = key, hashlib.sha256(), True
                continue
            hashed.update(f"{'' if empty else chr(10)}{who}:{said}".encode())
            empty = False
        if hashed is not None:
            done.append((now, hashed.hexdigest()))
            yield flush()

    return rows.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")
