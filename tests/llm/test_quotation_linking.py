import random

import duckdb

from tagloom.llm import quotation_linking as q

SCHEMA = "conv_id long, turn long, role string, text string, pos string"


def test_replies_branch_where_they_quote(spark):
    rows = [
        (1, 0, "user", "Hello there, can you help?\nI have a question about cats."),
        (1, 1, "assistant", "Sure, what is it?\nCats are fine animals."),
        (1, 2, "user", "> Sure, what is it?\nWhy do they purr?"),
        (1, 3, "assistant", "On Monday Ann wrote:\n>> Hello there,   can you help?\n> Sure, what is it?\nPurring is a sound."),
        (1, 4, "user", "> I have a question about CATS\nMe too."),
        (1, 5, "user", "and more"),
        (1, 6, "x", "> Me too.\n> unknown line\nok"),
        (1, 7, "x", "> Why do they purr?\nbranch"),
    ]
    found = q.reply_ordered(spark.createDataFrame([(*r, "p") for r in rows], SCHEMA)).orderBy("position").collect()
    assert [(r.turn, r.reply_to, r.quoted, r.levels) for r in found] == [
        (0, None, False, 0), (1, 0, False, 0), (2, 1, True, 1), (7, 2, True, 1), (3, 1, True, 2), (4, 0, True, 1), (5, 4, False, 0), (6, 4, True, 1),
    ]
    assert [r.text for r in found if r.turn in (2, 3, 7)] == ["Why do they purr?", "branch", "Purring is a sound."]


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, None, None, None), (2, 0, "user", None), (2, 1, "user", "> nothing known"), (2, 1, "user", "> nothing known"), (3, 0, "a", ">\n> \n"), (3, 1, "b", "long " * 20_000)]
    messages = spark.createDataFrame([(*r, "p") for r in rows], SCHEMA)
    found = q.reply_ordered(messages).collect()
    assert len(found) == len(rows) and not any(r.quoted for r in found)
    assert sorted(r.position for r in found if r.conv_id == 2) == [1, 2, 3]
    assert q.chats(messages).count() == 3
    assert q.reply_ordered(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_chain_of_branches(spark):
    """Each message quotes the one before the last: every one branches off."""
    rows = [(1, t, "u", (f"> line {t - 2}\n" if t > 1 else "") + f"line {t}", "p") for t in range(24)]
    found = {r.turn: r for r in q.reply_ordered(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(found[t].reply_to == t - 2 for t in range(2, 24))
    children = {t: [t + 2] if t + 2 < 24 else [] for t in range(24)}
    children[0] = [1, 2]
    order = []

    def visit(t):
        order.append(t)
        for c in sorted(children[t]):
            visit(c)

    visit(0)
    assert sorted(found, key=lambda t: found[t].position) == order


def test_equals_sql_on_random_chats(spark, tmp_path):
    random.seed(5)
    rows = []
    for conv in range(40):
        said = []
        for turn in range(random.randint(1, 20)):
            lines = []
            for _ in range(random.randint(0, 3)):
                if said and random.random() < 0.6:
                    x = random.choice(said)
                    lines.append(random.choice([">", "> ", ">> ", "> > "]) + random.choice([x, x.upper(), x + "  "]))
                else:
                    lines.append(random.choice(["On Monday Bob wrote:", "hi", "", f"line {random.randrange(40)} é", f"some {random.randrange(9)} words, here."]))
            said += [x for x in lines if x and not x.startswith(">")]
            text = random.choice(["\n", "\r\n"]).join(lines) if random.random() < 0.97 else None
            rows.append((conv or None, turn if random.random() < 0.95 else None, random.choice(["user", "assistant", None]), text, "p"))
    messages = spark.createDataFrame(rows, SCHEMA)
    messages.write.parquet(f"{tmp_path}/c")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c/*.parquet'")
    found = q.reply_ordered(messages)
    columns = sorted(found.columns)
    expected = duck.sql(f"SELECT {', '.join(columns)} FROM ({q.ORACLE})").fetchall()
    assert sorted(map(str, map(tuple, found.select(*columns).collect()))) == sorted(map(str, expected))
    assert found.where("quoted").count() > 50
