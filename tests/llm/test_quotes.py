from tests.llm.corpus import prose
from weirspan.llm import quotes

A, B, C = "Shall we open the gate tomorrow?\nThe water is high.", "Better wait for Friday.\n\nThe forecast says more rain is coming.", "I agree with both of you."
SCHEMA = "conv_id long, turn long, role string, text string, position int, root_turn string"


def frame(spark, rows):
    return spark.createDataFrame([(c, t, "user", x, 7, "clash") for c, t, x in rows], SCHEMA)


def quoted(text, level=1):
    return "\n".join(">" * level + " " + line for line in text.split("\n"))


def rows():
    return [
        (1, 0, A),
        (1, 1, f"Ann wrote:\n{quoted(A)}\n{B}"),
        (1, 2, f"{quoted(A, 2)}\n{quoted('better  WAIT for friday.')}\n{C}"),
        (1, 3, "> The water is high.\n> (my own words in between)\nIt fell overnight, look again."),
        (1, 4, "> nobody ever said this line\nStrange."),
        (2, 0, A),
        (2, 1, f"{quoted(A)}\nIn this talk, too."),
        (3, 0, f"> {C}\nFrom another talk."),
        (3, 1, None), (3, 2, ""), (3, 2, ""), (3, None, quoted(A)), (None, 1, quoted(A)), (4, 0, ">>>\n>"), (4, 1, "x > y is no quote"), (4, 2, prose(1, 20_000)),
    ]


def test_links_levels_and_order(spark):
    got = quotes.conversations(frame(spark, rows())).collect()
    assert len(got) == len(rows())
    by = {(r.conv_id, r.turn): r for r in got}
    assert by[1, 0].parent_turn is None and by[1, 0].text == A
    assert by[1, 1].text == B and by[1, 1].parent_turn == 0 and by[1, 1].n_linked == 1
    assert by[1, 2].text == C and by[1, 2].parent_turn == 1 and by[1, 2].depth == 2 and by[1, 2].n_linked == 2 and by[1, 2].max_level == 2
    assert by[1, 3].parent_turn == 0 and by[1, 3].depth == 1
    assert by[1, 4].parent_turn is None and by[1, 4].n_quotes == 1 and by[1, 4].n_linked == 0
    assert (by[2, 1].parent_conv, by[2, 1].parent_turn) == (2, 0)
    assert (by[3, 0].parent_conv, by[3, 0].parent_turn, by[3, 0].conversation, by[3, 0].depth) == (1, 2, 1, 3)
    assert by[3, 1].text is None and by[3, None].parent_turn is None and by[None, 1].parent_turn is None
    assert by[4, 0].text == "" and by[4, 1].text == "x > y is no quote" and by[4, 2].text == prose(1, 20_000)
    talks = {}
    for r in got:
        talks.setdefault(r.conversation, []).append((r.position, r.conv_id, r.turn))
    for talk in talks.values():
        assert sorted(p for p, _, _ in talk) == list(range(len(talk)))
    first = [(c, t) for _, c, t in sorted(talks[1])]
    place = {m: i for i, m in enumerate(first)}
    assert first[0] == (1, 0) and all(place[r.parent_conv, r.parent_turn] < place[r.conv_id, r.turn] for r in got if r.conversation == 1 and r.parent_turn is not None)


def test_chain_of_replies(spark):
    chain = [(5, 0, "message number zero here")] + [(5, i, f"> message number {'zero' if i == 1 else i - 1} here\nmessage number {i} here") for i in range(1, 40)]
    got = {r.turn: r for r in quotes.conversations(frame(spark, chain)).collect()}
    assert all(got[i].depth == i and got[i].position == i for i in range(40))


def test_a_common_first_turn_links_to_the_earliest(spark):
    many = [(c, 0, A) for c in range(50)] + [(100 + c, 0, f"{quoted(A)}\nreply {c}") for c in range(20)]
    got = [r for r in quotes.conversations(frame(spark, many)).collect() if r.conv_id >= 100]
    assert {(r.parent_conv, r.parent_turn, r.conversation) for r in got} == {(0, 0, 0)}


def test_the_original_may_have_a_larger_number(spark):
    rows = [(3, 0, f"{quoted(A)}\nan answer from afar"), (9, 0, A), (11, 0, f"{quoted(A)}\nanother one")]
    got = {r.conv_id: r for r in quotes.conversations(frame(spark, rows)).collect()}
    assert [(got[c].parent_conv, got[c].conversation, got[c].n_linked) for c in (3, 9, 11)] == [(9, 9, 1), (None, 9, 0), (9, 9, 1)]


def test_a_quoter_in_the_first_conversation_takes_the_second(spark):
    # In conversation 1 the words come after their quote, so they cannot be its source.
    rows = [(1, 0, f"{quoted(A)}\nsaid too early"), (1, 1, A), (2, 5, A), (3, 0, A)]
    got = {(r.conv_id, r.turn): r for r in quotes.conversations(frame(spark, rows)).collect()}
    assert (got[1, 0].parent_conv, got[1, 0].parent_turn) == (2, 5) and got[1, 1].parent_conv is None


def test_short_lines_link_within_their_conversation(spark):
    rows = [(1, 0, "We agree.\nIt is about the gate and the water behind it."), (1, 1, "> We agree.\nGood."), (2, 0, "> We agree.\nSo do we."),
            (3, 0, "Yes!"), (4, 0, "> Yes!\nThat was a whole message."), (5, 0, "> unknown opening of a passage\n> Yes!\nA part of a passage.")]
    got = {(r.conv_id, r.turn): r for r in quotes.conversations(frame(spark, rows)).collect()}
    assert [(got[m].parent_conv, got[m].n_linked) for m in ((1, 1), (2, 0), (4, 0), (5, 0))] == [(1, 1), (None, 0), (3, 1), (None, 0)]


def circle(first, n):
    """Conversations of one message each, in which every message quotes the next one's words, and the last the first's."""
    say = lambda i: f"the words of member {i % n} of the circle at {first}"
    return [(first + i, 0, f"> {say(i + 1)}\n{say(i)}") for i in range(n)]


def test_circles_are_opened_once(spark):
    rows = circle(10, 2) + circle(100, 7) + circle(1000, 33) + [(5000, 0, "> the words of member 3 of the circle at 100\nfrom outside")]
    got = {r.conv_id: r for r in quotes.conversations(frame(spark, rows)).collect()}
    assert len(got) == len(rows) and all(r.n_linked == 1 for r in got.values())
    for first, n in ((10, 2), (100, 7), (1000, 33)):
        last = first + n - 1  # of equal links the one of the largest conversation is the weakest
        assert [c for c in range(first, first + n) if got[c].parent_conv is None] == [last]
        assert all((got[c].conversation, got[c].depth, got[c].position) == (last, last - c, last - c) for c in range(first, first + n) if n != 7)
    assert (got[5000].conversation, got[5000].depth) == (106, 4)


def test_circles_against_brute_force(spark):
    import random

    rng = random.Random(5)
    parent = {i: rng.randrange(60) for i in range(60)}
    rows = [(i, 0, (f"> these are the words of number {p}\n" if p != i else "") + f"these are the words of number {i}") for i, p in parent.items()]
    parent = {i: p for i, p in parent.items() if p != i}

    def path(i):
        seen = []
        while i in parent and i not in seen:
            seen.append(i)
            i = parent[i]
        return seen, i

    for i in list(parent):
        seen, end = path(i)
        if end in seen:
            del parent[max(seen[seen.index(end):])]
    got = {r.conv_id: r for r in quotes.conversations(frame(spark, rows)).collect()}
    assert {i: r.parent_conv for i, r in got.items() if r.parent_conv is not None} == parent
    assert all((r.conversation, r.depth) == (path(i)[1], len(path(i)[0])) for i, r in got.items())


def test_empty_table(spark):
    assert quotes.conversations(frame(spark, [])).collect() == []


def test_parse_by_hand():
    assert quotes.parse("a\n\nX wrote:\n> b\n>> c\n>> d\ne") == ("a\n\ne", [(1, ["b"]), (2, ["c", "d"])])
    assert quotes.parse("plain") == ("plain", []) and quotes.parse(None) == (None, [])
