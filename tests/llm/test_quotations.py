import random
import re
from collections import Counter

import duckdb
import pytest

from crossquote.llm import quotations as qt
from workload.check import compare, oracle_connection
from tests.llm.conftest import SF

SCHEMA = "conv_id long, turn long, role string, text string"


def lines_of(text):
    for line in [] if text is None else text.split("\n"):
        mark = re.match(r"(?:[ \t]*>)+", line)
        body = re.sub(r"[ \t\r]+", " ", line[mark.end() if mark else 0:].lower()).strip(" ")
        yield (mark[0].count(">") if mark else 0), body


def brute(rows):
    """Everything by walking over all messages."""
    said = [(c, t, b) for c, t, _, x in rows if c is not None and t is not None for n, b in lines_of(x) if n == 0 and b]
    links = {}
    for c, t, _, x in rows:
        own = links.setdefault((c, t), [])
        for n, b in lines_of(x):
            if n and b:
                here = [(a, u) for a, u, y in said if y == b and a == c and None not in (c, t) and u < t]
                heads = {a: min(u for d, u, y in said if y == b and d == a) for a, _, y in said if y == b}
                first, last = (f(heads.items(), default=None) for f in (min, max))
                other = [m for m in (first, last) if m and c is not None and m[0] != c]
                own.append((n, min(here) if here else other[0] if other else None))
    parent, out = {}, []
    for key, own in links.items():
        votes = Counter(src for n, src in own if src and n == 1)
        parent[key] = max(votes, key=lambda s: (votes[s], s)) if votes and None not in key else None
    for c, t, role, x in rows:
        own = [] if None in (c, t) else links[c, t]
        up, depth = (c, t), 0
        while parent.get(up) and parent[up][0] == c:
            up, depth = parent[up], depth + 1
        source = parent.get((c, t)) or (None, None)
        text = "" if x is None else "\n".join(s for s in x.split("\n") if not re.match(r"(?:[ \t]*>)+", s))
        out.append((c, t, role, len(own), sum(s is not None for _, s in own), max((n for n, _ in own), default=0),
                    *source, None if c is None else up[1], depth, text))
    return sorted(out, key=repr)


def quoting(seed, n=60):
    rng = random.Random(seed)
    said = [f"Line  {i} of Text" for i in range(12)]
    rows = []
    for i in range(n):
        conv, turn = rng.randint(0, 4), rng.randint(0, 15)
        parts = [rng.choice(["", "", "> ", ">", "> > ", " >>\t"]) + rng.choice(said) for _ in range(rng.randint(0, 5))]
        rows.append((conv, turn, rng.choice(["user", "assistant"]), "\n".join(parts)))
    return rows + [rows[3], (None, 2, "user", "> Line 1 of text"), (1, None, "user", "Line 1 of text\n> line 2 of text"),
                   (9, 1, None, None), (9, 2, "user", ""), (9, 3, "user", ">\n>>\n> "), (9, 4, "user", "word " * 20_000)]


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rows = quoting(seed)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'clash' as level", "'x' as hash", "1 as depth")
    assert sorted(map(tuple, qt.link_quotations(df).collect()), key=repr) == brute(rows)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted(con.sql(qt.ORACLE).fetchall(), key=repr) == brute(rows)


def test_long_chain(spark):
    rows = [(1, i, "user", f"> said {i - 1}\nsaid {i}") for i in range(40)]
    got = {r.turn: r for r in qt.link_quotations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i].depth == i and got[i].thread_turn == 0 and got[i].own_text == f"said {i}" for i in range(40))


def test_against_oracle(spark):
    assert compare(qt.op1_quotation_links(spark, SF), oracle_connection(SF), qt.ORACLE).startswith("ok")


def test_empty(spark):
    assert qt.link_quotations(spark.createDataFrame([], SCHEMA)).collect() == []
