"""Names of files: as if chosen one after another, also in a book of many."""

import random

from leafmill.operators import assembly as A
from leafmill.operators import rendering as R


def plain(names):
    taken, out = set(), []
    for name in names:
        n = 1
        while (name if n == 1 else f"{name} {n}").lower() in taken:
            n += 1
        out.append(name if n == 1 else f"{name} {n}")
        taken.add(out[-1].lower())
    return out


def test_unique_stems(spark):
    rng = random.Random(3)
    said = ["a", "A", "a 2", "a 3", "A 2 2", "a 2 2 2", "b", "b 4", "c 2", "c 1", "a 02", "2", "2 2", "d x 3"]
    books = {b: [rng.choice(said) for _ in range(rng.randint(1, 40))] for b in [*"pqrstuvw", None]}
    rows = [(b, i, t) for b, names in books.items() for i, t in enumerate(names)]
    rng.shuffle(rows)
    got = {(r.book, r.number): r.stem for r in A.unique_stems(spark.createDataFrame(rows, "book string, number int, title string")).collect()}
    assert got == {(b, i): s for b, names in books.items() for i, s in enumerate(plain(names))}


def test_a_book_of_many(spark):
    """Each name costs the same, however many came before: a fold over an array of 60,000 took hours."""
    n = 60_000
    rows = spark.range(n).selectExpr("'b' AS book", "id AS number", "CASE WHEN id % 3 = 0 THEN concat('Notes ', id % 9000) ELSE 'notes' END AS title")
    got = [r.stem for r in A.unique_stems(rows).orderBy("number").collect()]
    assert got == plain_fast([f"Notes {i % 9000}" if i % 3 == 0 else "notes" for i in range(n)])


def plain_fast(names):
    taken, at, out = set(), {}, []
    for name in names:
        n = at.get(name.lower(), 1)
        while (name if n == 1 else f"{name} {n}").lower() in taken:
            n += 1
        at[name.lower()] = n
        out.append(name if n == 1 else f"{name} {n}")
        taken.add(out[-1].lower())
    return out


def test_back_divisions(spark):
    """Divisions of back matter whose names meet."""
    titles = ["Notes", "Notes 2", "notes", "Notes:", None, "Back Matter"]
    rows = [("b", i, t, 1) for i, t in enumerate(titles)]
    got = R.back_divisions(spark.createDataFrame(rows, "book string, section int, title string, level int")).orderBy("section").collect()
    assert [r.stem for r in got] == ["Notes", "Notes 2", "notes 3", "Notes 4", "Back Matter", "Back Matter 2"]
    assert [r.part for r in got] == [1, 2, 3, 4, 5, 6]
