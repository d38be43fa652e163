"""Conversation repair against a table over all edits, for any block size, and odd rows."""

import hashlib
import random
import re
import zlib

import pytest

from clickcast.llm import conversation_repair as cr

GRAMMAR = re.compile("(s?(ua)+)?")
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def brute(rows):
    """(cost, audit, lines), row by row, from the best way to each last initial; rows: (role, text, stays, truncated)."""
    best = {"": (0, "", ())}

    def add(table, initials, label):
        if initials not in table or label[:2] < table[initials][:2]:
            table[initials] = label

    def inserts(table):
        out = dict(table)
        todo = list(table.items())
        while todo:
            q, (c, a, lines) = todo.pop()
            for role in ("user", "assistant"):
                if ok(q, role[0]):
                    label = (c + 2, a + "I", (*lines, f"{role}:"))
                    if role[0] not in out or label[:2] < out[role[0]][:2]:
                        out[role[0]] = label
                        todo.append((role[0], label))
        return out

    def ok(q, r):
        return r != "" and (q + r) in ("s", "u", "su", "ua", "au")

    for role, text, stays, truncated in rows:
        after = {}
        for q, (c, a, lines) in inserts(best).items():
            add(after, q, (c + 3, a + "D", lines))
            if stays:
                if ok(q, role[:1]):
                    add(after, role[:1], (c + truncated, a + "K", (*lines, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if ok(q, new[0]):
                        add(after, new[0], (c + 2 + truncated, a + "R", (*lines, f"{new}:{text}")))
        best = after
    return min((label for q, label in inserts(best).items() if q in ("", "a")), key=lambda x: x[:2])


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda v: " " if v is None else str(v)
        role, text = show(role), show(text)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def expected(rows):
    out = {}
    hurt = damage(rows)
    for conv in {r[0] for r in rows}:
        mine = sorted((r[1:] for r in hurt if r[0] == conv),
                      key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen, lattice = {"blank": 0, "duplicate": 0, "truncated": 0}, set(), []
        for _, role, text in mine:
            letters = BLANK.findall(text)
            fault = ("blank" if not letters else "duplicate" if (role, text) in seen
                     else None if letters[-1] in ".!?" else "truncated")
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            lattice.append((role, text, fault not in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        turns = [r[0] for r in mine if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, lines = brute(lattice)
        out[conv] = (gaps, *faults.values(), illegal, cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def rows_of(rnd, conversations, most):
    texts = ["One. ", "two", "Three!\t", " \n ", "", "four? no", "Fünf .", None, "x" * 3000 + "."]
    out = []
    for conv in conversations:
        n = rnd.randrange(1, most)
        for k in range(n):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rnd.choice(texts) if rnd.random() < 0.4 else f"{rnd.random()}{rnd.choice('.!?,')}"
            out.append((conv, rnd.choice([k, k, k, k - 1, None, k + 5]), role, text))
            if rnd.random() < 0.05:
                out += [out[-1]] * rnd.randrange(1, 4)
    return out


def result(spark, rows):
    df = spark.createDataFrame([(*r, 1, "c") for r in rows],
                               "conv_id long, turn long, role string, text string, cost int, conv string").repartition(5)
    got = cr.repair_table(spark, df)
    assert got.columns == ["conv_id", *cr.COUNTS, "audit", "repaired_sha256"]
    return {r.conv_id: tuple(r)[1:] for r in got.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_audits_equal_the_table_of_all_edits(monkeypatch, seed):
    rnd = random.Random(seed)
    for _ in range(400):
        rows = [(rnd.choice(["user", "assistant", "system", "tool", ""]), "t", rnd.random() < 0.8, rnd.random() < 0.3)
                for _ in range(rnd.randrange(0, 14))]
        items = [(r[:1], stays, cut, 0 if stays else 1) for r, _, stays, cut in rows]
        cost, audit, lines = brute(rows)
        for size in (256, 1, 3):
            monkeypatch.setattr(cr, "BLOCK_ROWS", size)
            assert cr.solve(items) == (cost, audit)
        assert cr.repaired([r[:2] for r in rows], tuple(items), audit, cr.START) == list(lines)
        roles = "".join(line[:1] for line in lines)
        assert GRAMMAR.fullmatch(roles)


def test_table_equals_brute_force(spark):
    rows = rows_of(random.Random(7), [*range(60), None], 12)
    assert result(spark, rows) == expected(rows)


def test_a_hot_conversation_is_cut_and_chained(spark, monkeypatch):
    rnd = random.Random(8)
    rows = rows_of(rnd, [1], 700) + rows_of(rnd, range(2, 30), 8) + rows_of(rnd, [1, 30], 900)
    rows += [(31, 4, "user", "same.")] * 500
    want = expected(rows)
    for ranges, most, block in ((64, 40, 16), (8192, 50, 256)):
        monkeypatch.setattr(cr, "RANGE_ROWS", ranges)
        monkeypatch.setattr(cr, "OPEN_ROWS", most)
        monkeypatch.setattr(cr, "BLOCK_ROWS", block)
        got = result(spark, rows)
        assert got == want


def test_no_rows(spark):
    assert result(spark, []) == {}
    lost = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    assert result(spark, [(5, lost, "user", "a.")]) == {5: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
