"""Repair of conversations: the cheapest edits that make the roles of a chat take turns, by auction.

A chat of n rows spans a lattice of nodes (row, state), where the state tells what the next role may be. Arcs keep,
rerole or delete a row, or insert one; their costs are small whole numbers. The auction algorithm for shortest paths
holds a price for each node and one path from the origin: the path is extended along the arc that is cheapest with
the price of its end, and contracted, with a higher price, where no arc is worth the node's price. When the path is
there, the prices are an optimal dual solution, so every arc of every cheapest path is tight (price = cost + price
of its end), and the least audit is read off by walking tight arcs in the order of their letters.

Chats are cut into segments of SEGMENT rows, since a price can only climb by the cost of a segment. What is left to
pay after a segment comes from the last segment backwards; a segment's exit arcs bear it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm import rows
from revlens.operators.scan import range_scan
from revlens.session import written

SEGMENT = 128
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
ROLES = {"u": "user", "a": "assistant"}
#: States of the pattern (s?(ua)+)?: nothing yet, after s, after u, after a.
NOTHING, AFTER_S, AFTER_U, AFTER_A = range(4)
FOLLOWS = {NOTHING: {"s": AFTER_S, "u": AFTER_U}, AFTER_S: {"u": AFTER_U}, AFTER_U: {"a": AFTER_A}, AFTER_A: {"u": AFTER_U}}
#: What is left to pay after the last row: the pattern must be whole.
END = (0, None, None, 0)
BLANK = r"\A[\x20\x09-\x0D]*\z"
CUT = r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z"


def spaced(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with the damage that crc32 of 'conv_id:turn' deals; nulls become one space.

    Of 20 remainders 0 drops the row, 1 empties its text, 2 takes its end marks, 3 repeats it, 4 makes it the user's.
    """
    kind = F.pmod(F.crc32(F.concat_ws(":", spaced("conv_id"), spaced("turn"))), F.lit(20))
    own = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("_kind"))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("_kind") == 3, 2).otherwise(1)))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    return own.where("_kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def costs(row: str, state: int) -> list[tuple[str, int, int]]:
    """Arcs that use up a row: (letter, cost, next state), by letter. A row is its role's initial and its fault, '-' for none."""
    initial, fault = row
    arcs = [("D", DELETE, state)]
    if fault in "-t":
        more = TRUNCATED if fault == "t" else 0
        if initial in FOLLOWS[state]:
            arcs.append(("K", KEEP + more, FOLLOWS[state][initial]))
        arcs += [("R", REROLE + more, to) for role, to in FOLLOWS[state].items() if role in ROLES]
    return arcs


def lattice(rows_: str, left: tuple[int | None, ...]) -> list[list[tuple[str, int, int]]]:
    """Arcs of the nodes 4 * row + state; the sink is the last node, reached at what is left to pay in each state."""
    n = len(rows_) // 2
    sink = 4 * n + 4
    arcs: list[list[tuple[str, int, int]]] = []
    for k in range(n + 1):
        for state in range(4):
            own = [("I", INSERT, 4 * k + to) for role, to in FOLLOWS[state].items() if role in ROLES]
            if k < n:
                own += [(letter, cost, 4 * k + 4 + to) for letter, cost, to in costs(rows_[2 * k : 2 * k + 2], state)]
            elif left[state] is not None:
                own.append(("", left[state], sink))
            arcs.append(sorted(own))
    return [*arcs, []]


def prices_at_first(rows_: str, left: tuple[int | None, ...]) -> list[int]:
    """Prices that no arc undercuts: what must be paid for the faults of the rows to come, and the least that is left."""
    price = min(x for x in left if x is not None)
    out = [price]
    for k in range(len(rows_) - 1, 0, -2):
        price += DELETE if rows_[k] != "-" else 0
        out.append(price)
    return [p for p in reversed(out) for _ in range(4)] + [0]


def auction(arcs: list[list[tuple[str, int, int]]], price: list[int], origin: int) -> int:
    """Raise the prices until a path of tight arcs leads from the origin to the sink; the distance. The prices stay for the next origin."""
    sink, path = len(arcs) - 1, [origin]
    while path[-1] != sink:
        node = path[-1]
        best, to = min((cost + price[to], to) for _, cost, to in arcs[node])
        if price[node] < best:
            price[node] = best
            if len(path) > 1:
                path.pop()
        else:
            path.append(to)
    return price[origin]


def traced(arcs: list[list[tuple[str, int, int]]], price: list[int], origin: int) -> tuple[str, int]:
    """The least letters of a path of tight arcs to the sink, and the state before it."""
    tight = [[arc for arc in own if price[node] == arc[1] + price[arc[2]]] for node, own in enumerate(arcs)]
    comes: list[list[int]] = [[] for _ in arcs]
    for node, own in enumerate(tight):
        for _, _, to in own:
            comes[to].append(node)
    sink = len(arcs) - 1
    leads, todo = {sink}, [sink]
    while todo:
        for node in comes[todo.pop()]:
            if node not in leads:
                leads.add(node)
                todo.append(node)
    letters, node, last = [], origin, origin
    while node != sink:
        letter, _, to = next(arc for arc in tight[node] if arc[2] in leads)
        letters.append(letter)
        last, node = node, to
    return "".join(letters), last % 4


@lru_cache(1 << 14)
def solved(rows_: str, left: tuple[int | None, ...], state: int) -> tuple[int, str, int]:
    """Least cost from this state on, the letters of these rows, and the state after them."""
    arcs, price = lattice(rows_, left), prices_at_first(rows_, left)
    cost = auction(arcs, price, state)
    return cost, *traced(arcs, price, state)


@lru_cache(1 << 14)
def before(rows_: str, left: tuple[int | None, ...]) -> tuple[int, ...]:
    """What is left to pay before these rows, in each state."""
    arcs, price = lattice(rows_, left), prices_at_first(rows_, left)
    return tuple(auction(arcs, price, state) for state in range(4))


def segments(coded: DataFrame) -> DataFrame:
    """(conv_id, seg, left): what is left to pay after each segment of chats that have several. Two letters a row go in, no texts."""
    own = coded.where("seg is not null").groupBy("conv_id", "seg").agg(F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("rows"))
    own = own.select("conv_id", "seg", F.array_join(F.col("rows.code"), "").alias("rows"))
    long = own.where("seg > 0").select(F.col("conv_id").alias("_long")).distinct()
    own = own.join(long, F.col("conv_id").eqNullSafe(F.col("_long")), "left_semi")
    schema = pa.schema([("conv_id", pa.string()), ("seg", pa.int64()), ("left", pa.list_(pa.int64()))])

    def backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, left = None, END
        for batch in batches:
            lefts = []
            for conv, seg, codes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != (conv,):
                    at, left = (conv,), END
                lefts.append(list(left))
                left = before(codes, left)
            yield rows.batch({"conv_id": batch.column(0), "seg": batch.column(1), "left": lefts}, schema)

    dealt = own.select(F.col("conv_id").cast("string"), F.col("seg").cast("long"), "rows").repartition(rows.partitions(own.sparkSession), "conv_id")
    return rows.mapped(dealt.sortWithinPartitions("conv_id", F.desc("seg")), backwards, "conv_id string, seg long, left array<long>")


EDITS = ["conv_id", "at", "edit", "turn", "fault", "was", "role", "text"]
_EDITS = pa.schema([(n, pa.int64() if n in ("at", "turn") else pa.string()) for n in EDITS])
DIGEST = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
_DIGEST = pa.schema([(n, pa.string() if n in ("conv_id", "audit", "repaired_sha256") else pa.int64()) for n in DIGEST])


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long'}" for f in schema)


def _segment_edits(conv, held: list[tuple], left, state: int, at: int) -> tuple[list[tuple], int]:
    """Rows of EDITS for the rows (turn, code, role, text) of one segment, and the state after them."""
    _, letters, after = solved("".join(x[1] for x in held), END if left is None else tuple(left), state)
    out, own = [], iter(held)
    for at, letter in enumerate(letters, at):
        turn, code, was, text = (None, "--", None, "") if letter == "I" else next(own)
        role = was
        if letter in "IR":
            role = ROLES[next(r for r in FOLLOWS[state] if r in ROLES)]
        if letter != "D":
            state = FOLLOWS[state][role[0]]
        out.append((conv, at, letter, turn, code[1], was, role, text))
    return out, after


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of chats in order to edits; one segment's rows are held at a time."""
    conv, seg, state, at, left, held, out = None, None, NOTHING, 0, None, [], []

    def close():
        nonlocal state, at, held
        if held:
            more, state = _segment_edits(conv[0], held, left, state, at)
            at, held = at + len(more), []
            out.extend(more)

    for batch in rows.slices(batches):
        for of, pos, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            turn, own_seg, own_left, code, role, text = row
            if conv != (of,):
                close()
                conv, seg, state, at = (of,), None, NOTHING, 0
            if not pos:
                out.append((of, -1, None, None, None, None, None, None))
                continue
            if own_seg != seg:
                close()
                seg, left = own_seg, own_left
            held.append((turn, code, role, text))
        if out:
            yield rows.batch(dict(zip(EDITS, zip(*out, strict=True), strict=True)), _EDITS)
            out = []
    close()
    if out:
        yield rows.batch(dict(zip(EDITS, zip(*out, strict=True), strict=True)), _EDITS)


class _Digest:
    """Sums, audit and hash of one chat, whose edits come in order."""

    def __init__(self, conv):
        self.conv, self.cost, self.audit, self.sha, self.lines = conv, 0, [], sha256(), 0
        self.low = self.high = self.initial = None
        self.distinct = self.illegal = 0
        self.faults = dict.fromkeys("bdt-", 0)

    def add(self, edit, turn, fault, was, role, text) -> None:
        self.audit.append(edit)
        self.cost += {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[edit] + TRUNCATED * (fault == "t" and edit != "D")
        if edit != "I":
            self.faults[fault] += 1
            if turn is not None:
                self.distinct += turn != self.high
                self.low, self.high = turn if self.low is None else self.low, turn
            self.illegal += self.initial is not None and self.initial + was[:1] not in ("su", "ua", "au")
            self.initial = was[:1]
        if edit != "D":
            self.sha.update(("\n" * (self.lines > 0) + f"{role}:{text}").encode())
            self.lines += 1

    def result(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return self.conv, gaps, *(self.faults[f] for f in "bdt"), self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chat, done = None, []
    for batch in rows.slices(batches):
        for conv, at, *edit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if chat is None or chat.conv != conv:
                if chat:
                    done.append(chat.result())
                chat = _Digest(conv)
            if at >= 0:
                chat.add(*edit)
        if done:
            yield rows.batch(dict(zip(DIGEST, zip(*done, strict=True), strict=True)), _DIGEST)
            done = []
    if chat:
        yield rows.batch(dict(zip(DIGEST, zip(chat.result(), strict=True), strict=True)), _DIGEST)


def coded(turns: DataFrame) -> DataFrame:
    """Rows of chats in order (turn, nulls first, then role and text by their bytes): conv_id, turn, role, text, pos from 1, seg, code.

    ``code`` is the role's first letter (x if not s, u or a) and the row's first fault: b blank, d duplicate,
    t truncated, - none. Positions are counted by ranges of the order, and the first of equal rows is found by an
    aggregate, so that one chat may hold most rows.
    """
    turn = F.struct(F.col("turn").isNotNull().alias("x"), F.col("turn").alias("y"))
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    own = turns.select("conv_id", "turn", "role", "text", turn.alias("_turn"), same.alias("_same"), F.monotonically_increasing_id().alias("_nth"))
    placed = range_scan(own, ["conv_id"], ["_turn", "role", "text", "_nth"], {"pos": ("sum", F.lit(1).cast("long"))})
    first = placed.groupBy(F.col("conv_id").alias("_conv"), F.col("_same").alias("_key")).agg(F.min("pos").alias("_first"))
    marked = placed.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_same") == F.col("_key")))
    fault = F.when(F.col("text").rlike(BLANK), "b").when(F.col("pos") > F.col("_first"), "d").when(F.col("text").rlike(CUT), "t").otherwise("-")
    initial = F.substring(F.col("role"), 1, 1)
    code = F.concat(F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("x")), fault)
    return marked.select("conv_id", "turn", "role", "text", "pos", F.floor((F.col("pos") - 1) / SEGMENT).alias("seg"), code.alias("code"))


def repaired(turns: DataFrame, chats: DataFrame | None = None) -> DataFrame:
    """The cheapest edits of each chat, in order: conv_id, at (from 0), edit, turn, fault, was (role before), role, text.

    ``turns`` has conv_id, turn, role and text, without nulls in the last two; ``chats`` names chats that must occur
    even without turns (at is -1 there and edit null). A row's first fault counts: blank (nothing but white space),
    duplicate (an earlier row has its role and text), truncated (its last letter is no end mark). Edits: Keep costs 0,
    Rerole 1, Delete 2 (must be for blank and duplicate rows), Insert 5, and a truncated row that stays 5 more. The
    initials of the roles that stay match (s?(ua)+)?. Of the cheapest edits those with the ASCII-least letters hold.

    Rows of a null conv_id make one chat. Rows of one turn stand by role and text. Repeated rows are duplicates,
    whatever their turn. An empty table gives no rows. Other columns are left out. Long chats are solved by segments;
    the rows of one chat stream through one task, which holds a segment of them.
    """
    kind = dict(turns.dtypes)["conv_id"]
    own = written(coded(turns), "coded")
    left = segments(own).withColumnRenamed("conv_id", "_conv").withColumnRenamed("seg", "_seg")
    own = own.withColumn("conv_id", F.col("conv_id").cast("string"))
    with_left = own.join(left, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("seg") == F.col("_seg")), "left")
    every = with_left.select("conv_id", "pos", "turn", "seg", "left", "code", "role", "text")
    if chats is not None:
        every = every.unionByName(chats.select(F.col("conv_id").cast("string"), F.lit(0).cast("long").alias("pos")).distinct(), allowMissingColumns=True)
    dealt = every.repartition(rows.partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "pos")
    return rows.mapped(dealt, _edits, ddl(_EDITS)).withColumn("conv_id", F.col("conv_id").cast(kind))


def digests(edits: DataFrame) -> DataFrame:
    """One row for each chat of ``repaired``'s rows, as they lie: faults, gaps between turns, illegal neighbours, cost, audit and digest.

    A chat without rows has zeros, an empty audit and the digest of the empty string.
    """
    kind = dict(edits.dtypes)["conv_id"]
    own = edits.select(F.col("conv_id").cast("string"), "at", "edit", "turn", "fault", "was", "role", "text")
    return rows.mapped(own, _digests, ddl(_DIGEST)).withColumn("conv_id", F.col("conv_id").cast(kind))


def repaired_after_damage(turns: DataFrame) -> DataFrame:
    """``digests`` of the repair of the rows that ``damaged`` leaves, with a row for each chat there was."""
    own = turns.select("conv_id", "turn", "role", "text")
    return digests(repaired(damaged(own), own.select("conv_id")))
