"""Lines of recurring templates: hot groups, blocks, variable fields at any place, edited copies."""

import random

from orrery.llm import line_dedup


def drop(docs_of, rows):
    return {r.doc_id: (r.text, r.n_dropped) for r in line_dedup.drop_recurring_lines(docs_of(rows), counts=True).collect()}


def word(r):
    return "".join(r.choice("abcdefghijklmnop") for _ in range(8))


def prose(r, n=9):
    return " ".join(word(r) for _ in range(n))


def test_a_hot_group_has_no_veto(docs_of):
    r = random.Random(1)
    foot = "See the full list of our partners below"
    hot = [prose(r) for _ in range(3)]
    rows = [(i, f"{prose(r)}\n{foot}\n{prose(r)}") for i in range(40)]
    rows += [(100 + i, "\n".join([hot[0] + f" {word(r)}", foot, *hot[1:]])) for i in range(40)]
    got = drop(docs_of, rows)
    assert all(foot not in t for t, _ in got.values()) and all(got[i][1] == 1 for i in range(40))


def test_blocks_of_lines(docs_of):
    r = random.Random(2)
    block = "All rights are reserved by the owners\n\nNo part of it may be copied\nWrite to us for a licence"
    got = drop(docs_of, [(i, f"{prose(r)}\n{block}\n{prose(r)}") for i in range(30)])
    assert {n for _, n in got.values()} == {3}


def test_the_line_after_may_go_on_in_own_words(docs_of):
    r = random.Random(5)
    got = drop(docs_of, [(i, f"{prose(r)}\nA passage that many quote\nFrom here {prose(r, 5 + i)}") for i in range(30)])
    assert {n for _, n in got.values()} == {1}


def test_fields_at_any_place_and_in_short_lines(docs_of):
    r = random.Random(3)
    first, last = [word(r) for _ in range(4)], [word(r) for _ in range(4)]
    made = [lambda: f"Written by {r.choice(first)} {r.choice(last)} for the weekly letter", lambda: f"Posted by {word(r)}", lambda: f"Filed under {word(r)} today"]
    rows = [(i, f"{prose(r)}\n{made[i % 3]()}\n{prose(r)}") for i in range(120)]
    got = drop(docs_of, rows)
    assert {n for _, n in got.values()} == {1} and not any(k in t for t, _ in got.values() for k in ("Written", "Posted", "Filed"))


def test_copies_and_edited_copies_stay(docs_of):
    r = random.Random(4)
    lines = [prose(r).split() for _ in range(12)]
    rows = []
    for i in range(60):
        own = [list(x) for x in lines]
        own[r.randrange(12)][r.randrange(2, 9)] = word(r)
        rows.append((i, "\n".join(map(" ".join, own))))
    rows += [(100 + i, rows[0][1]) for i in range(20)]
    assert drop(docs_of, rows) == {i: (t, 0) for i, t in rows}


def test_the_inside_of_a_block_goes_and_copies_of_a_document_stay(docs_of):
    r = random.Random(6)
    licence = "You may use this text as you like\nas long as you keep this notice in it\nand say where you found it"
    rows = [(i, f"{prose(r)}\n{prose(r)}\n{licence}\n{prose(r)}") for i in range(200)]
    copy = "\n".join(prose(r) for _ in range(6))
    rows += [(300 + i, f"{copy}\n{word(r)}") for i in range(100)]
    got = drop(docs_of, rows)
    assert {got[i][1] for i in range(200)} == {3} and {got[300 + i][1] for i in range(100)} == {0}


def test_just_enough_texts_and_a_very_long_one(docs_of):
    r = random.Random(7)
    line = "Nine words that stand below each of our texts"
    short = [(i, f"{prose(r)}\n{line}") for i in range(9)]
    assert {n for _, n in drop(docs_of, short).values()} == {0}
    long = "\n".join(prose(r) for _ in range(20_000)) + f"\n{line}\n{line}"
    got = drop(docs_of, [*short, (9, long), (9, long)])
    assert {n for _, n in got.values()} == {1, 2} and got[9] == (long[: -2 * len(line) - 2], 2)
