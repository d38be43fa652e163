"""Repair of conversations whose turns are lost, blank, repeated, cut short or out of order.

The rows of a conversation, in order, and the roles met so far span a lattice of edits:
a node is (rows used, state), and the states are those of the grammar
``(s?(ua)+)?`` of role initials: nothing yet, system, user, assistant.  Keep, Rerole and Delete
use a row, Insert does not.  Two Dijkstra searches meet in it, one from the first node, one
from the accepting ends, each with a heap; they go on until no crossing of the best cost is left,
and the least concatenated audit (the edits' initials) of all crossings wins.  A state
and an edit determine the next state, so audits of one node never are prefixes of each other.

No conversation is gathered in one task.  The rows are sorted over range partitions by
(conversation, turn, role, text), equal rows counted first.  A conversation inside a range is
solved as the range streams by; the ones at the ends of a range, or longer than
``OPEN_ROWS``, are cut into blocks of ``BLOCK_ROWS``.  A block yields the cost of each (state before, state
after) and the order of the audits that start alike; one small row a block is
chained per conversation, after which every block writes its own part of the result.
A digest needs its text in order: the last step streams the parts of a conversation through one
task and holds one part at a time.

Defined results: a null role or text, and a null id or turn inside the damage key, is one space; a null
conversation is one of its own; rows of equal turn are ordered by role, then text, and equal rows are
duplicates of the first; empty table: no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickcast.llm.catalog import register
from clickcast.llm.common import table, written

#: Fixed values of the task: costs, white space, sentence ends, and how often each kind of damage strikes.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
DAMAGE = 20
#: Rows of a range partition, of a conversation solved while its range streams by, and of a block.
RANGE_ROWS = 8192
OPEN_ROWS = 2048
BLOCK_ROWS = 256

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
KEEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The state after an inserted or re-labelled turn, and its role.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
#: What completes a conversation that ends in a state: cost and audit.
CLOSE = {START: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}

#: A row for the lattice: role initial, may it stay, is it truncated, rows that must go after it.
Item = tuple[str, bool, bool, int]


def edits(item: Item, state: int) -> list[tuple[int, int, str]]:
    """(next state, cost, audit) of the ways to use a row in a state."""
    initial, stays, truncated, forced = item
    cost, tail = DELETE * forced, "D" * forced
    if not stays:
        return [(state, cost, tail)]
    ways = [(state, cost + DELETE, "D" + tail), (NEXT[state], cost + REROLE + truncated * TRUNCATED, "R" + tail)]
    if (state, initial) in KEEP:
        ways.append((KEEP[state, initial], cost + truncated * TRUNCATED, "K" + tail))
    return ways


@lru_cache(maxsize=4096)
def shortest(items: tuple[Item, ...], entry: int, ends: tuple[tuple[int, tuple[int, str]], ...]):
    """(cost, least audit, last state) of the cheapest way from ``entry`` to an end (state, (cost, audit) beyond); or None.

    Nothing is inserted after the last row: that belongs to what follows.
    """
    n = len(items)
    after: dict[tuple[int, int], list] = {}
    before: dict[tuple[int, int], list] = {}
    for i in range(n):
        for q in STATES:
            ways = [((i + 1, to), cost, audit) for to, cost, audit in edits(items[i], q)]
            ways.append(((i, NEXT[q]), INSERT, "I"))
            after[i, q] = ways
            for to, cost, audit in ways:
                before.setdefault(to, []).append(((i, q), cost, audit))
    forward = {(0, entry): (0, "")}
    reverse = {(n, q): label for q, label in ends}
    # Equal costs are settled in row order (free edits use a row), so that audits are final when a node is.
    heap_f, heap_r = [(0, 0, entry)], sorted((label[0], -n, q) for q, label in ends)
    done_f: set = set()
    done_r: set = set()
    best = math.inf
    while heap_f and heap_r and heap_f[0][0] + heap_r[0][0] <= best:
        ahead = heap_f[0][0] <= heap_r[0][0]
        cost, at, q = heapq.heappop(heap_f if ahead else heap_r)
        node = (abs(at), q)
        labels, others, edges = (forward, reverse, after) if ahead else (reverse, forward, before)
        settled = done_f if ahead else done_r
        if node in settled or cost > labels[node][0]:
            continue
        settled.add(node)
        if node in others:
            best = min(best, cost + others[node][0])
        audit = labels[node][1]
        for to, more, letters in edges.get(node, ()):
            new = (cost + more, audit + letters if ahead else letters + audit)
            if to not in labels or new < labels[to]:
                if to not in labels or new[0] < labels[to][0]:
                    heapq.heappush(heap_f if ahead else heap_r, (new[0], to[0] if ahead else -to[0], to[1]))
                labels[to] = new
            if to in others:
                best = min(best, new[0] + others[to][0])
    if best == math.inf:
        return None
    final_r = done_r | {(n, q) for q, _ in ends}  # the ends' labels are final from the start
    found = []
    for u in done_f:
        cost, audit = forward[u]
        if u in final_r and cost + reverse[u][0] == best:
            found.append(audit + reverse[u][1])
        for v, more, letters in after.get(u, ()):
            if v in final_r and cost + more + reverse[v][0] == best:
                found.append(audit + letters + reverse[v][1])
    audit = min(found)
    return best, audit, run_states(items, entry, audit)


def run_states(items: tuple[Item, ...], entry: int, audit: str) -> int:
    """The state after an audit's edits."""
    state = entry
    for kind, _, item in steps(items, audit):
        if kind == "K":
            state = KEEP[state, item[0]]
        elif kind in "RI":
            state = NEXT[state]
    return state


def steps(items: tuple[Item, ...], audit: str) -> Iterator[tuple[str, int, Item | None]]:
    """(edit, number of its row, row) of an audit; the rows that must go are skipped over."""
    at, i = 0, 0
    while at < len(audit):
        if audit[at] == "I":
            yield "I", -1, None
            at += 1
            continue
        item = items[i]
        yield (audit[at] if item[1] else "D"), i, item
        at += item[1] + item[3]
        i += 1


def block_table(items: tuple[Item, ...]) -> dict[tuple[int, int], tuple[int, str]]:
    """(state before, state after) → (cost, least audit) of a block of rows."""
    out = {}
    for entry in STATES:
        for end in STATES:
            way = shortest(items, entry, ((end, (0, "")),))
            if way is not None:
                out[entry, end] = way[:2]
    return out


def chain(tables: list[dict[tuple[int, int], tuple[int, object]]]) -> tuple[int, list[int]]:
    """Cost of the whole and the states between blocks; the second part of a table's values orders its audits."""
    togo = [{q: label[0] for q, label in CLOSE.items()}]
    for t in reversed(tables):
        togo.append({q: min((c + togo[-1][e] for (a, e), (c, _) in t.items() if a == q), default=math.inf)
                     for q in STATES})
    togo.reverse()
    states = [START]
    for k, t in enumerate(tables):
        q = states[-1]
        states.append(min((order, e) for (a, e), (c, order) in t.items()
                          if a == q and c + togo[k + 1][e] == togo[k][q])[1])
    return int(togo[0][START]), states


def solve(items: list[Item]) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    if len(items) <= BLOCK_ROWS:
        cost, audit, _ = shortest(tuple(items), START, tuple(CLOSE.items()))
        return cost, audit
    blocks = [tuple(items[i:i + BLOCK_ROWS]) for i in range(0, len(items), BLOCK_ROWS)]
    tables = [block_table(b) for b in blocks]
    cost, states = chain(tables)
    audit = "".join(t[a, b][1] for t, a, b in zip(tables, states, states[1:]))
    return cost, audit + CLOSE[states[-1]][1]


def repaired(rows: list[tuple[str, str]], items: tuple[Item, ...], audit: str, state: int) -> list[str]:
    """The ``role:text`` lines an audit leaves, from a state on."""
    lines = []
    for kind, i, item in steps(items, audit):
        if kind == "K":
            state = KEEP[state, item[0]]
            lines.append(f"{rows[i][0]}:{rows[i][1]}")
        elif kind in "RI":
            state = NEXT[state]
            lines.append(f"{ROLE[state]}:{rows[i][1] if kind == 'R' else ''}")
    return lines


def damaged(conversations: DataFrame) -> DataFrame:
    """conv, turn, role, text, copies of the rows that the damage leaves; by crc32 of ``conv_id:turn``."""
    space = F.lit(" ")
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    kind = F.crc32(F.concat(F.coalesce(conv, space), F.lit(":"), F.coalesce(turn, space)).cast("binary")) % DAMAGE
    rows = conversations.select(conv.alias("conv"), F.col("turn").cast("long").alias("turn"),
                                F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
                                kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(
        F.col("text"))
    return rows.select("conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                       text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))


def text_fault(text: Column) -> Column:
    """2 blank, 1 truncated, 0 neither."""
    body = F.rtrim(text, F.lit(BLANKS))
    return F.when(body == "", 2).when(F.substring(body, -1, 1).isin(*ENDS), 0).otherwise(1)


def as_item(role: str, fault: int, copies: int, first: bool) -> Item:
    """A row with its copies; ``first``: its role and text were not seen before."""
    stays = fault != 2 and first
    return role[:1], stays, fault == 1, copies - stays


class Tally:
    """Counts of a run of rows that can be added up over runs."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_turn = self.last_turn = self.last_initial = self.first_initial = None

    def add(self, turn: int | None, item: Item, fault: int, copies: int) -> None:
        self.blank += copies if fault == 2 else 0
        self.duplicate += 0 if fault == 2 else item[3]
        self.truncated += item[1] and item[2]
        self.illegal += copies - 1
        if self.last_initial is None:
            self.first_initial = item[0]
        else:
            self.illegal += self.last_initial + item[0] not in LEGAL
        self.last_initial = item[0]
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn

    def values(self) -> list[int]:
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        return [gaps, self.blank, self.duplicate, self.truncated, self.illegal]


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_ROW = ["conv", "turn", "role", "text", "copies", "fault"]
_DONE = ["conv", *COUNTS, "audit", "repaired_sha256"]
DONE = f"conv string, {', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired_sha256 string"


def _sha(lines: list[str]) -> str:
    return hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest()


def _whole(conv: str | None, rows: list[tuple]) -> tuple:
    """The result of a conversation whose rows (turn, role, text, copies, fault) are all here."""
    tally, items, seen = Tally(), [], set()
    for turn, role, text, copies, fault in rows:
        item = as_item(role, fault, copies, (role, text) not in seen)
        seen.add((role, text))
        items.append(item)
        tally.add(None if turn is None else int(turn), item, fault, copies)
    cost, audit = solve(items)
    lines = repaired([r[1:3] for r in rows], tuple(items), audit, START)
    return conv, *tally.values(), cost, audit, _sha(lines)


def _stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows → results of the conversations inside the range; rows of the others as they are, numbered."""
    conv, rows, number, is_open, begun = None, [], 0, True, False
    left: list[tuple] = []

    def give_up() -> None:
        """The rows held go on as they are."""
        nonlocal number
        for row in rows:
            left.append((conv, *[None] * (len(COUNTS) + 2), number, *row))
            number += 1
        rows.clear()

    for batch in batches:
        done: list[tuple] = []
        for row in zip(*(batch[c].tolist() for c in _ROW)):
            if begun and row[0] != conv:
                if is_open:
                    give_up()
                else:
                    done.append((*_whole(conv, rows), *[None] * len(_ROW)))
                    rows.clear()
                is_open = False
            conv, begun = row[0], True
            rows.append(row[1:])
            is_open = is_open or len(rows) > OPEN_ROWS
            if is_open:
                give_up()
        yield pd.DataFrame([*done, *left], columns=[*_DONE, "number", *_ROW[1:]], dtype=object)
        left = []
    if rows:
        give_up()
        yield pd.DataFrame(left, columns=[*_DONE, "number", *_ROW[1:]], dtype=object)


def _items(pdf: pd.DataFrame) -> tuple[Item, ...]:
    return tuple(as_item(r, int(f), int(c), bool(x)) for r, f, c, x in zip(
        pdf["role"], pdf["fault"], pdf["copies"], pdf["first"]))


def _measure(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """One row a block: counts, and costs and order of audits by (state before, state after); -1: no way."""
    pdf = pdf.sort_values("number")
    items, tally = _items(pdf), Tally()
    for turn, item, fault, copies in zip(pdf["turn"], items, pdf["fault"], pdf["copies"]):
        tally.add(None if turn is None else int(turn), item, int(fault), int(copies))
    t = block_table(items)
    order = {pair: k for k, pair in enumerate(sorted(t, key=lambda p: t[p][1]))}
    text = lambda v: None if v is None else str(v)
    return pd.DataFrame([(
        *key, tally.blank, tally.duplicate, tally.truncated, tally.illegal, tally.turns, text(tally.first_turn),
        text(tally.last_turn), tally.first_initial, tally.last_initial,
        [t[a, b][0] if (a, b) in t else -1 for a in STATES for b in STATES],
        [order.get((a, b), -1) for a in STATES for b in STATES])], columns=_MEASURED)


_MEASURED = ["conv", "range", "block", "blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn",
             "first_initial", "last_initial", "costs", "orders"]
_MEASURED_SCHEMA = ("conv string, range int, block long, blank long, duplicate long, truncated long, illegal long, turns long, "
                    "first_turn string, last_turn string, first_initial string, last_initial string, "
                    "costs array<long>, orders array<int>")


def _chain(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """Per block of one conversation its states before and after; the conversation's counts at each."""
    pdf = pdf.sort_values(["range", "block"])
    tables = [{(a, b): (int(c[4 * a + b]), int(o[4 * a + b])) for a in STATES for b in STATES if c[4 * a + b] >= 0}
              for c, o in zip(pdf["costs"], pdf["orders"])]
    cost, states = chain(tables)
    turns, illegal = int(pdf["turns"].sum()), int(pdf["illegal"].sum())
    firsts = [None if t is None else int(t) for t in pdf["first_turn"]]
    lasts = [None if t is None else int(t) for t in pdf["last_turn"]]
    last = None
    for first, end in zip(firsts, lasts):
        turns -= first is not None and first == last
        last = last if end is None else end
    for a, b in zip(pdf["last_initial"][:-1], pdf["first_initial"][1:]):
        illegal += a + b not in LEGAL
    first = next((t for t in firsts if t is not None), None)
    gaps = 0 if first is None else last - first + 1 - turns
    out = pdf[["conv", "range", "block"]].copy()
    out["entry"], out["end"] = states[:-1], states[1:]
    for name, value in zip(COUNTS, (gaps, int(pdf["blank"].sum()), int(pdf["duplicate"].sum()),
                                    int(pdf["truncated"].sum()), illegal, cost)):
        out[name] = value
    return out


def _part(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """The audit and the repaired lines of one block, its states known."""
    pdf = pdf.sort_values("number")
    items, entry, end = _items(pdf), int(pdf["entry"].iloc[0]), int(pdf["end"].iloc[0])
    audit = shortest(items, entry, ((end, (0, "")),))[1]
    lines = repaired(list(zip(pdf["role"], pdf["text"])), items, audit, entry)
    return pd.DataFrame([(*key, *(int(pdf[c].iloc[0]) for c in COUNTS), audit, "\n".join(lines), len(lines), end)],
                        columns=["conv", "range", "block", *COUNTS, "audit", "lines", "n_lines", "end"])


def _join_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Parts in order → one row a conversation, one part held at a time."""
    now, digest, audits, any_line, last = None, None, [], False, None

    def line(text: str) -> None:
        nonlocal any_line
        digest.update((("\n" if any_line else "") + text).encode("utf-8", "surrogatepass"))
        any_line = True

    def finish() -> tuple:
        state, tail = int(last["end"]), CLOSE[int(last["end"])][1]
        for _ in tail:
            state = NEXT[state]
            line(f"{ROLE[state]}:")
        return (now[0], *(int(last[c]) for c in COUNTS), "".join(audits) + tail, digest.hexdigest())

    for batch in batches:
        out = []
        for row in batch.to_dict("records"):
            if now is None or row["conv"] != now[0]:
                if now is not None:
                    out.append(finish())
                now, digest, audits, any_line = (row["conv"],), hashlib.sha256(), [], False
            audits.append(row["audit"])
            if row["n_lines"]:
                line(row["lines"])
            last = row
        yield pd.DataFrame(out, columns=_DONE)
    if now is not None:
        yield pd.DataFrame([finish()], columns=_DONE)


def _solve_open(rows: DataFrame) -> DataFrame:
    """Results of the conversations that lie in several ranges or are long, from their numbered rows."""
    spark = rows.sparkSession
    rows = rows.withColumn("sha", F.sha2("text", 256))
    seen = rows.groupBy("conv", "role", "sha").agg(F.min(F.struct("range", "number")).alias("first")).toDF(
        "_conv", "_role", "_sha", "first")
    of_row = F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("sha") == F.col("_sha"))
    flagged = rows.join(seen, of_row).select(
        *_ROW, "range", "number", (F.col("number") / BLOCK_ROWS).cast("long").alias("block"),
        (F.col("first") == F.struct("range", "number")).alias("first"))
    flagged = written(spark, flagged, "open-rows")
    block = ["conv", "range", "block"]
    measured = flagged.drop("text").groupBy(*block).applyInPandas(_measure, _MEASURED_SCHEMA)
    counts = ", ".join(f"{c} long" for c in COUNTS)
    chained = written(spark, measured.groupBy("conv").applyInPandas(
        _chain, f"conv string, range int, block long, entry int, end int, {counts}"), "chained-blocks")
    ways = chained.toDF(*[f"_{c}" for c in chained.columns])
    same = F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("range") == F.col("_range")) & (
        F.col("block") == F.col("_block"))
    dealt = flagged.join(ways, same).select(
        *flagged.columns, *[F.col(f"_{c}").alias(c) for c in ("entry", "end", *COUNTS)])
    parts = dealt.groupBy(*block).applyInPandas(
        _part, f"conv string, range int, block long, {counts}, audit string, lines string, n_lines long, end int")
    return parts.repartition("conv").sortWithinPartitions("conv", "range", "block").mapInPandas(_join_parts, DONE)


def repair_conversations(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Results per conversation of ``rows`` (conv, turn, role, text, copies)."""
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").cast("long").alias("copies"))
    rows = written(spark, rows.withColumn("fault", text_fault(F.col("text"))), "damaged-rows")
    ranges = max(1, math.ceil(rows.count() / RANGE_ROWS))
    schema = f"{DONE}, number long, turn string, role string, text string, copies long, fault int"
    streamed = (rows.repartitionByRange(ranges, "conv", "turn", "role", "text")
                .sortWithinPartitions("conv", "turn", "role", "text")
                .withColumn("turn", F.col("turn").cast("string")).mapInPandas(_stream, schema)
                .withColumn("range", F.spark_partition_id()))
    streamed = written(spark, streamed, "repaired")
    done = streamed.where("number is null").select("conv", *COUNTS, "audit", "repaired_sha256")
    open_rows = streamed.where("number is not null").select(
        "conv", "range", "number", "turn", "role", "text", "copies", "fault")
    return done.unionByName(_solve_open(open_rows))


@register("op11_conversation_repair")
def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return repair_table(spark, table(spark, sf_dir, "conversations"))


def repair_table(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """Damage, then repair: one row for every conversation of the table, also one that lost all its rows."""
    found = repair_conversations(spark, damaged(conversations)).withColumnRenamed("conv", "_conv")
    ids = conversations.select("conv_id").distinct()
    joined = ids.join(found, F.col("conv_id").cast("string").eqNullSafe(F.col("_conv")), "left")
    return joined.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS],
                         F.coalesce("audit", F.lit("")).alias("audit"),
                         F.coalesce("repaired_sha256", F.lit(_sha([]))).alias("repaired_sha256"))
