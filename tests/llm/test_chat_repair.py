"""Conversation repair: against enumeration of all edits, in pieces and ranges, edges, and the query's SQL."""

import hashlib
import itertools
import random
import zlib

import pytest

from lumiquarry.llm import chat_repair as m


def enumerated(rows, most_inserts=2):
    """The least (cost, audit) of rows (letters) by trying every sequence of edits with up to ``most_inserts`` inserts in each gap."""
    level = {m.NOTHING: [(0, "")]}

    def grown(level):
        out = {q: list(ways) for q, ways in level.items()}
        now = level
        for _ in range(most_inserts):
            then: dict = {}
            for q, ways in now.items():
                for letter, to in m.NEXT[q].items():
                    if letter in "ua":
                        then.setdefault(to, []).extend((c + 3, a + "I") for c, a in ways)
            for q, ways in then.items():
                out.setdefault(q, []).extend(ways)
            now = then
        return out

    level = grown(level)
    for row in rows:
        then: dict = {}
        for q, ways in level.items():
            then.setdefault(q, []).extend((c + 4, a + "D") for c, a in ways)
            if row == m.GONE:
                continue
            more = 3 if row.isupper() else 0
            for letter, to in m.NEXT[q].items():
                if letter == row.lower():
                    then.setdefault(to, []).extend((c + more, a + "K") for c, a in ways)
                if letter in "ua":
                    then.setdefault(to, []).extend((c + 3 + more, a + "R") for c, a in ways)
        level = grown(then)
    return min(w for q in m.LAST for w in level.get(q, []))


def test_all_short_conversations_cost_what_enumeration_finds():
    for n in range(4):
        for rows in itertools.product("suaUAxX-", repeat=n):
            assert m.cheapest("".join(rows), m.NOTHING, m.LAST) == enumerated(rows)
    r = random.Random(5)
    for _ in range(40):
        rows = "".join(r.choice("ssuuaaSUAxX-") for _ in range(5))
        assert m.cheapest(rows, m.NOTHING, m.LAST) == enumerated(rows)


def test_pieces_compose_to_the_whole():
    r = random.Random(7)
    for n in (2, 9, 30, 80):
        rows = "".join(r.choice("suaUAx-") for _ in range(n))
        whole = m.cheapest(rows, m.NOTHING, m.LAST)
        for size in (1, 3, 7, 50):
            folded = m.Folded()
            for k in range(0, n, size):
                folded.add(m.between(rows[k : k + size]))
            assert m.last(folded.all()) == whole


def plain(rows, conv=None):
    """The report and repaired rows of one conversation (turn, role, text), by dynamic programming over whole states."""
    rows = [(t, r or "", x or "") for t, r, x in rows]
    name = "" if conv is None else f"c{conv}"
    who = lambda r, x: hashlib.md5(f"{len(name)}\n{name}\n{len(r)}\n{r}\n{x}".encode()).digest()
    rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], who(*x[1:])))
    seen, letters, counts = set(), "", [0, 0, 0]
    for _, role, text in rows:
        said = text.strip(m.SPACE)
        letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
        if not said:
            letters, counts[0] = letters + "-", counts[0] + 1
        elif (role, text) in seen:
            letters, counts[1] = letters + "-", counts[1] + 1
        elif said[-1] not in ".!?":
            letters, counts[2] = letters + letter.upper(), counts[2] + 1
        else:
            letters += letter
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    level = {m.NOTHING: (0, "")}
    grow = lambda lv: {q: min(w for w in (lv.get(q), *((lv[p][0] + 3, lv[p][1] + "I") for p in lv for x, to in m.NEXT[p].items() if x in "ua" and to == q)) if w) for q in {*lv, *(to for p in lv for x, to in m.NEXT[p].items() if x in "ua")}}
    closed = lambda lv: grow(grow(lv))
    level = closed(level)
    for row in letters:
        then: dict = {}
        for q, (c, a) in level.items():
            for p, to, cost, edit in m.MOVES[row]:
                if p == q:
                    then[to] = min(then.get(to, (9**9, "")), (c + cost, a + edit))
        level = closed(then)
    cost, audit = min(level[q] for q in m.LAST if q in level)
    out, state, k = [], 0, 0
    for edit in audit:
        if edit != "I":
            _, role, text = rows[k]
            k += 1
        if edit != "D":
            role = role if edit == "K" else "assistant" if state == m.USER else "user"
            state = m.NEXT[state][role[0]]
            out.append(f"{role}:{'' if edit == 'I' else text}")
    return (gaps, *counts, illegal, cost, audit), hashlib.sha256("\n".join(out).encode()).hexdigest()


SCHEMA = "conv_id long, turn long, role string, text string, audit string, part int, kind int, conv string"


def held(spark, rows):
    return spark.createDataFrame([(*r, None, None, None, None) for r in rows], SCHEMA)


def check(spark, rows):
    df = held(spark, rows)
    found = m.report(df)
    got = {r.conv_id: tuple(r)[1:] for r in found.collect()}
    sha = {r.conv_id: r.repaired_sha256 for r in m.digests(m.repaired(df, found)).collect()}
    convs: dict = {}
    for c, *rest in rows:
        convs.setdefault(c, []).append(tuple(rest))
    assert set(got) == set(convs)
    for c, mine in convs.items():
        want, digest = plain(mine, c)
        assert got[c] == want, c
        assert sha.get(c, hashlib.sha256(b"").hexdigest()) == digest, c


def test_edges(spark):
    long = "word " * 200_000 + "end."
    rows = [
        (1, 0, "user", "Hi."), (1, 1, "assistant", "Ho."),
        (2, None, "user", None), (2, None, None, "What."), (2, 3, "", "No role."), (2, 9, "assistant", "   \t\n"),
        (None, 0, "system", "Be good."), (None, 1, "assistant", "I am"), (None, 5, "user", "Ok?"),
        (3, 0, "user", "Same."), (3, 0, "user", "Same."), (3, 1, "user", "Same."), (3, 2, "assistant", "Same."),
        (4, 0, "user", long), (4, 1, "user", long), (4, 2, "assistant", long + " x"),
        (5, 0, "system", "Alone."), (6, 0, "tool", "x."), (6, 1, "umpire", "y!"), (6, 2, "Assistant", "z?"),
        (7, 0, "assistant", "İ \U0001f642."), (7, 1, "user", "a\nb:c."), (8, 0, "user", ""),
    ]
    check(spark, rows)


def test_one_hot_conversation_over_many_ranges(spark):
    """Over half the rows are of one conversation, a third of them one text; pieces are short so that many are composed."""
    r = random.Random(2)
    texts = ["Yes.", "No", "Well?", "", "So!"]
    hot = [(5, t, r.choice(["user", "assistant", "system"]), f"{r.choice(texts)}{r.choice(['', r.randrange(300)])}{r.choice(['.', ''])}") for t in range(400)]
    hot += [(5, t, "user", "Again.") for t in range(0, 400, 2)] + [(5, 7, "user", "Again.")] * 300
    rest = [(c, t, r.choice(["user", "assistant"]), r.choice(["A.", "B", "C?", "D!"])) for c in [*range(5), *range(6, 40)] for t in range(r.randrange(1, 7))]
    piece, m.PIECE = m.PIECE, 16
    try:
        check(spark, hot + rest)
    finally:
        m.PIECE = piece


def test_no_rows(spark):
    none = held(spark, [])
    found = m.report(none)
    assert found.count() == 0 and m.digests(m.repaired(none, found)).count() == 0


def test_damage_is_by_the_crc(spark):
    rows = [(c, t, "assistant", "One. Two! Three?") for c in (*range(40), None, -3) for t in (0, 1, 2, None)]
    got: dict = {}
    for r in m.damaged(held(spark, rows)).collect():
        got.setdefault((r.conv_id, r.turn), []).append((r.role, r.text))
    for c, t, role, text in rows:
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        want = {0: None, 1: [(role, "")], 2: [(role, "One Two Three")], 3: [(role, text)] * 2, 4: [("user", text)]}.get(fault, [(role, text)])
        assert got.get((c, t)) == want


@pytest.mark.parametrize("empty", [True, False])
def test_query(spark, tmp_path, empty):
    rows = [] if empty else [(c, t, ["user", "assistant"][t % 2], f"Text {c} {t}.") for c in range(60) for t in range(3)] + [(None, 0, None, None)]
    held(spark, rows).write.parquet(str(tmp_path / "conversations.parquet"))
    got = m.op11_conversation_repair(spark, str(tmp_path)).collect()
    assert len(got) == (0 if empty else 61)
    hurt: dict = {}
    for r in m.damaged(held(spark, rows)).collect():
        hurt.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    for r in got:
        want, sha = plain(hurt.get(r.conv_id, []), r.conv_id)
        assert tuple(r)[1:] == (*want, sha)
