"""Quotation linking against hand-made threads and a plain walk."""

import random

from critiq.llm import quote_links
from critiq.llm.quote_links import parse, reply_ordered

KIND = "conv_id long, turn long, role string, text string, place string"


def rows_of(spark, messages):
    frame = spark.createDataFrame([(*m, "x") for m in messages], KIND)
    return {(r.conv_id, r.turn): r for r in reply_ordered(frame).collect()}


def test_parse_levels():
    body, quotes, posts = parse("Hello there\n\nOn Monday, Ann wrote:\n> first quoted line\n>  goes  on\n> > Inner One\n>> inner two\n> last\nMy answer")
    assert body == "Hello there\n\nMy answer"
    assert [q[0] for q in quotes] == [1, 2, 1]
    assert quotes[1][1] == quote_links.text_hash("inner one inner two") and quotes[0][1] == quote_links.text_hash("first quoted line goes on")
    assert quote_links.text_hash("hello there my answer") in posts
    assert [len(q[2]) for q in quotes] == [2, 0, 0]  # the others are too short to be found by their lines
    assert parse(None) == ("", [], []) and parse("> \n>") == ("", [], [])


def test_links_and_order(spark):
    m = [
        (1, 0, "user", "What colour is the evening sky?"),
        (1, 1, "assistant", "Red, as a rule.\n\nBut it depends on the weather today."),
        (1, 2, "user", "Does it depend on anything else?"),
        (1, 3, "user", "> What colour is the evening sky?\n\nIt was green here!"),
        (1, 4, "assistant", "> > What colour is the evening sky?\n> It was green here!\n\nGreen? Send a picture."),
        (1, 5, "user", "> But it depends on the WEATHER   today.\nIt rained."),
        (1, 6, None, "> nobody said so in this place\nindeed"),
        (2, 0, "user", "> What colour is the evening sky?\nOther conversation."),
        (2, 0, "user", "> What colour is the evening sky?\nOther conversation."),
        (None, 0, "user", "left out"),
    ]
    got = rows_of(spark, m)
    assert {t: got[1, t].reply_to for t in range(7)} == {0: None, 1: 0, 2: 1, 3: 0, 4: 3, 5: 1, 6: 5}
    assert sorted(range(7), key=lambda t: got[1, t].place) == [0, 1, 2, 5, 6, 3, 4]
    assert [got[1, t].n_linked for t in range(7)] == [0, 0, 0, 1, 2, 1, 0] and got[1, 6].role == "user"
    assert got[1, 3].text == "It was green here!" and ">" not in got[1, 4].text and got[1, 3].formatted == "<|user|>\nIt was green here!\n<|end|>\n"
    assert got[2, 0].reply_to is None and len(got) == 8


def walk(parent):
    """Depth-first order of turns, children by turn."""
    children = {}
    for t in sorted(parent):
        children.setdefault(parent[t], []).append(t)
    out, stack = [], children[None][::-1]
    while stack:
        t = stack.pop()
        out.append(t)
        stack += children.get(t, [])[::-1]
    return out


def test_random_trees_in_small_buckets(spark, monkeypatch):
    monkeypatch.setattr(quote_links, "BUCKET", 8)
    rng = random.Random(8)
    messages, parents = [], {}
    for c in range(6):
        parents[c] = {0: None}
        messages.append((c, 0, "user", f"this is the long opening of conversation {c}"))
        for t in range(1, 60):
            quoted = rng.randrange(t) if rng.random() < 0.4 else None
            body = f"this is message {t} of conversation {c}"
            if quoted is None:
                messages.append((c, t, "user", body))
            else:
                text = messages[-t + quoted][3].split("\n")[-1]
                messages.append((c, t, "user", f"> {text}\n{body}"))
            parents[c][t] = t - 1 if quoted is None else quoted
    got = rows_of(spark, messages)
    for c, parent in parents.items():
        assert {t: got[c, t].reply_to for t in parent} == parent
        assert sorted(parent, key=lambda t: got[c, t].place) == walk(parent)


def test_latest_of_equal_messages_and_empty(spark):
    same = "the same words again and again"
    got = rows_of(spark, [(1, t, "user", same) for t in range(5)] + [(1, 5, "user", f"> {same}\nyes"), (1, 3000, "user", f"> {same}\nno")])
    assert got[1, 5].reply_to == 4 and got[1, 3000].reply_to == 4
    assert reply_ordered(spark.createDataFrame([], KIND)).count() == 0
    assert rows_of(spark, [(1, 0, None, None)])[1, 0].text == ""


def plainly_linked(messages):
    """reply_to of every message, by looking for each passage in each earlier message."""
    texts, out = {}, {}
    for t, text in enumerate(messages):
        body, passages, _ = parse(text)
        best = None
        for level, lines in [(lv, ls) for lv, ls in zip([p[0] for p in passages], quoted_lines(text))]:
            found = [u for u in range(t) if any(texts[u][k : k + len(lines)] == lines for k in range(len(texts[u]) - len(lines) + 1))]
            if found and (best is None or (-level, max(found)) > best):
                best = (-level, max(found))
        texts[t] = [quote_links.normal(x) for x in body.split("\n") if x.strip()]
        out[t] = best[1] if best else (t - 1 if t else None)
    return out


def quoted_lines(text):
    """The lines of each passage, in a plain reading: marks off, blank lines and introductions out."""
    got, level = [], 0
    for line in text.split("\n"):
        bare = line.replace("> ", ">").lstrip(">")
        depth = len(line.replace("> ", ">")) - len(bare)
        if depth and depth != level:
            got.append([])
        if depth and bare.strip():
            got[-1].append(quote_links.normal(bare))
        level = depth
    return [g for g in got if g]


def test_any_run_of_lines_is_found(spark):
    """Random quotes of some lines out of messages, interleaved with own lines and nested."""
    rng = random.Random(12)
    rows, want = [], {}
    for c in range(8):
        messages, own = [], []
        for t in range(40):
            if not t or rng.random() < 0.3:
                lines = [f"line {k} of message {t} in {c}, {rng.choice('xyz')}" for k in range(rng.randint(1, 6))]
                text = "\n".join(x + "\n" * rng.randint(0, 1) for x in lines)
                own.append(lines)
            else:
                text, mine = [], []
                for part in range(rng.randint(1, 3)):
                    source = own[rng.randrange(t)]
                    if source:
                        at = rng.randrange(len(source))
                        quote = source[at : at + rng.randint(1, 4)]
                        text += [f"{rng.choice(['> ', '>', '>> '])}{x}" if part else f"> {x}" for x in quote[:1]]
                        mark = text[-1][: len(text[-1]) - len(quote[0])]
                        text += [mark + x.upper() for x in quote[1:]]
                    new = [f"answer {part}.{k} of message {t} in {c}" for k in range(rng.randint(1, 3))]
                    text += new
                    mine += new
                text = "\n".join(text)
                own.append(mine)
            messages.append(text)
            rows.append((c, t, "user", text))
        want[c] = plainly_linked(messages)
    got = rows_of(spark, rows)
    for c, parent in want.items():
        assert {t: got[c, t].reply_to for t in parent} == parent
        assert sorted(parent, key=lambda t: got[c, t].place) == walk(parent)
    assert sum(p is not None and p != t - 1 for w in want.values() for t, p in w.items()) > 100


def test_part_of_a_paragraph_and_interleaved_answers(spark):
    m = [
        (1, 0, "user", "the first line of three lines\nthe second line of three lines\nthe third line of three lines"),
        (1, 1, "assistant", "something quite different here"),
        (1, 2, "user", "> the second line of three lines\n> the third line of three lines\nown line one here x1\nown line two here x2\n> something quite different here\nown line three here y1"),
        (1, 3, "assistant", "nothing to do with it"),
        (1, 4, "user", "> own line one here x1\n> own line two here x2\nright"),
        (1, 5, "user", "> own line two here x2\n> own line three here y1\nright again"),
        (1, 6, "user", "> the first line of three lines\n> On Monday, Ann wrote:\n> > something quite different here\nyes"),
        (1, 7, "user", "> the first line of three lines\n> the third line of three lines\nno such run"),
    ]
    got = rows_of(spark, m)
    assert {t: got[1, t].reply_to for t in range(8)} == {0: None, 1: 0, 2: 1, 3: 2, 4: 2, 5: 2, 6: 0, 7: 6}
    assert [got[1, t].n_linked for t in range(8)] == [0, 0, 2, 0, 1, 1, 2, 0]


def test_deep_threads(spark):
    """Two alternating threads: every turn opens a branch, as deep as half the turns."""
    n = 400
    m = [(1, t, "user", f"message number {t} of the thread" if t < 2 else f"> message number {t - 2} of the thread\nmessage number {t} of the thread") for t in range(n)]
    got = rows_of(spark, m)
    parent = {0: None, 1: 0} | {t: t - 2 for t in range(2, n)}
    assert {t: got[1, t].reply_to for t in range(n)} == parent
    assert sorted(range(n), key=lambda t: got[1, t].place) == walk(parent)


def test_very_long_message(spark):
    lines = [f"this is line {k} of a very long message" for k in range(20_000)]
    got = rows_of(spark, [(1, 0, "user", "\n".join(lines)), (1, 1, "user", "short"), (1, 2, "user", "\n".join(f"> {x}" for x in lines[777:790]) + "\nfine")])
    assert got[1, 2].reply_to == 0 and got[1, 2].n_linked == 1
