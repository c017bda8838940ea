"""Attachments and boxes against plain loops."""

import random
import re

from lodestar.operators.mails import assigned_files, lines_of_boxes

PEOPLE, FILES = "mail long, block long, name string, station string, text string", "mail long, file long, label string, content string"


def by_loops(people, files):
    """Passes over people and files in order, as a reader would do it by hand."""
    plain = lambda s: re.sub(r"[.\s　]", "", s or "").lower()
    shown = lambda s: (re.search(r"\(([^)]+)\)", s or "") or [None, s or ""])[1]
    out, used = {}, set()
    others = lambda b: {plain(p[2]) for p in people if len(plain(p[2])) >= 2} - {plain(b[2])}

    def run(fits, by):
        for b in sorted(people, key=lambda p: p[1]):
            for f in sorted(files, key=lambda f: f[1]):
                if b[1] not in out and f[1] not in used and fits(b, f):
                    out[b[1]] = (f[1], by)
                    used.add(f[1])

    numbers = lambda s: set(re.findall(r"(?<!\d)\d{4,6}(?!\d)", s or ""))

    def only(n):
        sizes = {b[1]: max([len(x) for x in (b[4] or "").split("\n") if n in numbers(x)], default=0) for b in people}
        own = [k for k, v in sizes.items() if v and v == max(sizes.values())]
        having = [f[1] for f in files if n in numbers(shown(f[2]))]
        return (own[0], having[0]) if len(own) == len(having) == 1 else None

    run(lambda b, f: len(plain(b[2])) >= 2 and plain(b[2]) in plain(shown(f[2])), "name")
    pairs = {only(n) for b in people for n in numbers(b[4])}
    run(lambda b, f: (b[1], f[1]) in pairs, "number")
    run(lambda b, f: len(b[3] or "") >= 2 and b[3].lower() in plain(shown(f[2])) and not any(o in plain(shown(f[2])) for o in others(b)), "station")
    text = lambda f: (f[3] or "").lower().replace(".", "")
    run(lambda b, f: len(plain(b[2])) >= 2 and plain(b[2]) in text(f) and not any(o in text(f) for o in others(b)), "content")
    rest, free = [b for b in people if plain(b[2]) and b[1] not in out], [f for f in files if f[1] not in used]
    if len(rest) == len(free) == 1:
        out[rest[0][1]] = (free[0][1], "rest")
    return sorted((people[0][0], b, f, by) for b, (f, by) in out.items())


def test_assignment_against_loops(spark):
    r = random.Random(11)
    people, files, want = [], [], []
    for mail in range(120):
        names = r.sample(["T.K", "M. S", "山田", "鈴木 一", "k.k", "A", None, "", "H.M", "S.S"], r.randrange(1, 5))
        own = [(mail, i, n, r.choice([None, "渋谷", "品川", "X"]), r.choice([None, f"■{24000 + i} {n}\n経験", f"①■{24000 + i} ②■{24001 + i}", "12345678"])) for i, n in enumerate(names)]
        labels = [f"添付({n}_経歴書.xlsx)" if r.random() < 0.5 else f"{n}.xls" for n in names if n] + ["職務経歴書.xlsx", "24000職務.xls", "渋谷_TK.xls", "品川.pdf", f"{24001}_x.doc", None]
        theirs = [(mail, i, label, r.choice([None, "", "氏名 T.K Java", "山田 と 鈴木一", "HM"])) for i, label in enumerate(r.sample(labels, r.randrange(1, min(5, len(labels)))))]
        people, files = people + own, files + theirs
        want += by_loops(own, theirs)
    got = assigned_files(spark.createDataFrame(people, PEOPLE), spark.createDataFrame(files, FILES))
    assert sorted(map(tuple, got.collect())) == want and {w[3] for w in want} == {"name", "number", "station", "content", "rest"}
    assert assigned_files(spark.createDataFrame([], PEOPLE), spark.createDataFrame(files, FILES)).count() == 0


def test_lines_of_boxes(spark):
    boxes = [
        (1, 1, 10.0, 700.2, "2020"), (1, 1, 40.0, 699.8, "年"), (1, 1, 60.0, 700.0, "4 月"), (1, 1, 5.0, 720.0, "title"), (1, 1, 300.0, 720.4, "right"),
        (1, 1, 10.0, 650.0, "b"), (1, 1, 10.0, 650.0, "a"), (1, 1, 1.0, 1.0, "  "), (1, 1, None, 1.0, "lost"), (1, 1, 9.0, 3.0, None), (1, 2, 0.0, -5.5, "1"), (1, 2, 9.0, -5.5, "/"), (1, 2, 20.0, -5.4, "2"), (2, 1, 0.0, 0.0, "x"),
    ]
    got = lines_of_boxes(spark.createDataFrame(boxes[::-1], "id long, page long, x double, y double, text string"), "id")
    assert sorted(map(tuple, got.collect())) == [(1, 1, 0, "title right"), (1, 1, 1, "2020年4月"), (1, 1, 2, "a b"), (1, 2, 0, "1/2"), (2, 1, 0, "x")]
