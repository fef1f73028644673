from tribune.llm import quotes


def test_rewrapped_and_partial_quotations(spark):
    first = "The first paragraph is\nshort here\n\nA second paragraph that runs\nover two lines"
    rows = [
        (0, first),
        (1, "Sugar is cheap. Salt is dear. Pepper is rare."),
        (2, "> unknown words\nmy upper\nanswer\n> other words\nmy lower\nanswer"),
        (3, "filler"),
        (4, "> A second paragraph\n> that runs over two lines\nabout the paragraph"),
        (5, "> Salt is\n> dear.\nabout the sentence"),
        (6, "> my lower answer\nabout the part"),
        (7, "> fragment. Salt is dear. Pepper\nabout some of it"),
    ]
    df = spark.createDataFrame([(1, t, "user", x) for t, x in rows], "conv_id long, turn long, role string, text string")
    got = {r.turn: r.parent_turn for r in quotes.format_chats(df).collect()}
    assert got == {0: None, 1: 0, 2: 1, 3: 2, 4: 0, 5: 1, 6: 2, 7: 1}
