import random

from tribune.llm import quotes


def test_split():
    own, passages = quotes.split_quotes("On Monday Ann wrote:\n> Hello there\n> again\n> > older words\nMy answer\n>deep\nend")
    assert own == "My answer\nend"
    assert passages == [(1, "Hello there\nagain"), (2, "older words"), (1, "deep")]
    assert quotes.split_quotes("a > b\n\n") == ("a > b\n\n", [])


def order(rows):
    """Depth-first order of one conversation's turns, by recursion over parents found by plain search."""
    own = {t: quotes.split_quotes(x or "") for t, x in rows}
    turns = sorted(own)
    said = {t: {quotes.normalised(p) for p in [own[t][0], *own[t][0].split("\n")]} - {""} for t in turns}
    up = {}
    for k, t in enumerate(turns):
        found = []
        for level, passage in own[t][1]:
            for p in [passage, *passage.split("\n")]:
                p = quotes.normalised(p)
                first = next((u for u in turns if p and p in said[u]), None)
                if first is not None and first < t:
                    found.append((level, -len(p), -first))
        up[t] = -min(found)[2] if found else turns[k - 1] if k else None

    out = []

    def visit(t):
        out.append(t)
        for u in turns:
            if up[u] == t:
                visit(u)

    if turns:
        visit(turns[0])
    return out, up


def test_against_recursion(spark):
    rng = random.Random(7)
    rows = []
    for conv in range(40):
        texts = {}
        for turn in sorted(rng.sample(range(3000), rng.randrange(1, 25))):
            lines = [f"line {conv} {turn} {k}" for k in range(rng.randrange(1, 3))]
            if texts and rng.random() < 0.6:
                quoted = rng.choice([x for x in texts.values()]).split("\n")
                lines = [">" * rng.randrange(1, 3) + " " + line.upper() for line in rng.sample(quoted, 1)] + lines
            texts[turn] = "\n".join(lines)
        rows += [(conv, t, "user", x, "extra") for t, x in texts.items()]
    # columns named like those at work are the user's
    more = ["key", "start", "place", "slice", "before", "first", "n", "head", "rank", "own_text", "said", "quoted"]
    df = spark.createDataFrame([(*r, *more) for r in rows], "conv_id long, turn long, role string, text string, position string, " + ", ".join(f"{c} string" for c in more)).repartition(3)
    got = quotes.format_chats(df).collect()
    assert len(got) == len(rows) and all([r[c] for c in more] == more for r in got)
    for conv in range(40):
        mine = sorted((r for r in got if r.conv_id == conv), key=lambda r: r.position)
        expect, up = order([(t, x) for c, t, _, x, _ in rows if c == conv])
        assert [r.position for r in mine] == list(range(len(mine)))
        assert [r.turn for r in mine] == expect
        assert all(r.parent_turn == up[r.turn] for r in mine)
        assert not any(">" in r.text for r in mine)


def test_odd_rows(spark):
    rows = [(1, 0, "a", None), (1, 0, "a", "x"), (1, 0, "a", "x"), (1, 2, None, "> x\ny"), (None, 1, "a", "> q"), (1, None, "a", "z"), (2, 5, "a", ""), (3, 1, "b", "w" * 200_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = quotes.format_chats(df).collect()
    assert len(got) == len(rows)
    assert sorted((r.turn, r.position) for r in got if r.conv_id == 1 and r.turn is not None) == [(0, 0), (0, 1), (0, 2), (2, 3)]
    assert all(r.position is None and r.parent_turn is None for r in got if r.conv_id is None or r.turn is None)
    assert next(r for r in got if r.turn == 2).parent_turn == 0
    assert quotes.format_chats(df.limit(0)).count() == 0


def test_deeply_nested_branches(spark):
    # every turn is answered twice: at once and, later, by a branch that quotes it
    rows = [(1, t, f"turn {t}" if t < 60 else f"> turn {119 - t}\nlate {t}") for t in range(120)]
    got = quotes.format_chats(spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")).collect()
    expect, up = order([(t, x) for _, t, x in rows])
    assert [r.turn for r in sorted(got, key=lambda r: r.position)] == expect
    assert {r.turn: r.parent_turn for r in got} == up
