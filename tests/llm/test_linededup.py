import random

import pytest
from oracle import same, sql_rows

from lorespark.llm import linededup as D

LONG = " ".join(f"word{i}" for i in range(55))


def docs():
    rng = random.Random(5)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c d", " c d ", "", "e"]) for _ in range(rng.randrange(12)))) for i in range(60)]
    rows += [(100, LONG), (101, "x\n" + LONG + "\ny"), (102, LONG + "\n" + LONG), (103, "q\nq\nq\nq\nq"), (104, None), (105, ""), (106, "\n\n"), (107, "é\n" * 9)]
    return [(*r, "lines") for r in rows]


def test_against_sql(spark):
    rows = docs()
    df = spark.createDataFrame(rows, "doc_id long, text string, a string")
    names, want = sql_rows(D.SQL, documents=("doc_id bigint, text varchar, a varchar", rows))
    same(D.line_dedup(df), names, want)
    assert D.line_dedup(df.limit(0)).count() == 0


def test_no_fingerprint_is_missed_between_other_lines(spark):
    # common lines in changing contexts: the first position of a line tells nothing of most of its windows
    rng = random.Random(8)
    rows = [(i, "\n".join(rng.choice(["hub", "a", "b", "c", f"u{rng.randrange(6)}", " ".join(f"w{rng.randrange(2)}" for _ in range(26))]) for _ in range(rng.randrange(2, 14)))) for i in range(400)]
    names, want = sql_rows(D.SQL, documents=("doc_id bigint, text varchar", rows))
    same(D.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")), names, want)


def test_marks_are_fewer_than_windows(spark):
    rows = D.stored(spark.createDataFrame([(i, i, "\n".join(f"line {i} {j}" for j in range(100))) for i in range(50)], "id long, th long, t string"), "rows")
    n = D.fingerprints(rows).count()
    assert 2000 < n < 2900 and D.fingerprints(rows).select("id", "p").distinct().count() == n  # 4,900 windows of three lines


def test_one_text_of_many_lines(spark):
    text = "\n".join(f"l{i}" for i in range(200_000))
    df = spark.createDataFrame([(1, text), (2, "z\n" + text)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_lines, r.n_removed, len(r.text)) for r in D.line_dedup(df).collect()) == [(1, 200_000, 0, len(text)), (2, 200_001, 200_000, 1)]


def test_repeated_rows_and_null_ids(spark):
    text = "one\ntwo\nthree\nfour"
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, "zero\n" + text)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.n_removed, r.text) for r in D.line_dedup(df).collect())
    assert got == [(0, 0, text), (1, 4, ""), (1, 4, ""), (2, 4, "zero")]


@pytest.mark.parametrize("d", ["sf0.001", "sf0.01"])
def test_query(spark, d):
    same(D.op4_line_dedup(spark, f"/root/testdata/{d}"), *sql_rows(D.SQL, f"/root/testdata/{d}"))


def with_pairs(rows, pair):
    """Lines left of each text, by the rule itself."""
    seen, out = set(), {}
    for i, t in rows:
        lines = t.split("\n")
        at = [n for n, x in enumerate(lines) if x.strip()]
        gone = set()
        for p in range(len(at)):
            for size in (1, 2, 3):
                w = [lines[n].strip() for n in at[p : p + size]]
                words = sum(len(x.split()) for x in w)
                if len(w) == size and (size == 3 or size == 2 and words > pair or size == 1 and words >= 50):
                    gone |= set(at[p : p + size]) if tuple(w) in seen else set()
                    seen.add(tuple(w))
        out[i] = "\n".join(x for n, x in enumerate(lines) if n not in gone)
    return out


def test_two_lines_that_are_long_together(spark):
    a, b = (" ".join(f"{k}{i}" for i in range(30)) for k in "ab")
    rows = [(1, f"{a}\n{b}"), (2, f"{a}\n{b}"), (3, f"x\n{a}\n\n {b}\ny"), (4, a), (5, f"{b}\n{a}"), (6, f"{a}\nz"), (7, f"z\n{a}\n{b}\nz\n{a}\n{b}")]
    rng = random.Random(6)
    rows += [(i, "\n".join(rng.choice([a, b, "q", "r s", ""]) for _ in range(rng.randrange(1, 9)))) for i in range(10, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in D.line_dedup(df).collect()}
    assert got[2] == "" and got[3] == "x\n\ny" and got[4] == a and got == with_pairs(rows, 50)
    assert {r.doc_id: r.text for r in D.line_dedup(df, pair=None).collect()} == with_pairs(rows, 1 << 30)
