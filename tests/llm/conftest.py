import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, component_id long, _text string, spans string, n long"


def words(rng, n, most=400):
    return " ".join(f"w{rng.randint(0, most)}" for _ in range(n))


def make_rows():
    """Small documents with every edge: nulls, empty and long texts, ties, repeated rows, copies, near copies, shared passages."""
    rng = random.Random(7)
    rows = []
    passage = words(rng, 70)
    base = words(rng, 120)
    for i in range(30):
        rows.append((i, words(rng, rng.randint(1, 200)), "en" if i % 3 else "de", f"s{i % 4}"))
    rows += [(100 + i, base, "en", "s0") for i in range(12)]
    for i in range(12):
        w = base.split()
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = "zz" + str(i)
        rows.append((200 + i, " ".join(w), "en", "s0"))
    rows += [(300 + i, words(rng, 20) + " " + passage + " " + words(rng, 15), "fr", "s1") for i in range(8)]
    rows += [(400, None, "en", "s2"), (401, "", None, None), (402, " \n\t ", "en", "s2"), (403, "one", "en", None), (404, "One", "en", "s2"),
             (405, "a b c", "en", "s2"), (406, "ab " * 3000, "en", "s2"), (407, words(rng, 6000), "en", "s2"), (408, "é" * 500 + "日本 " * 120, "es", "s2"),
             (409, "Released under the MIT License. GNU General Public License; CC-BY 4.0, apache  license", "en", "s2"),
             (410, "mail a.b@c.example.org or a.b [at] c [dot] example [dot] org, +1 (988) 555-2485, later 1-988-555-2485, 10.0.0.255 4111 1111 1111 1111", "en", "s2"),
             (411, "LINE one two\nLINE one two\nx\n\n# * $ % & | < >", "en", "s2"), (412, "x" * 5000, "en", "s2")]
    rows += [rows[0], rows[0], rows[30], (None, "no id at all here", "en", "s3"), (None, None, None, None)]
    return [(*r, len(r[1] or ""), True, 1, "x", "y", 2) for r in rows]


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(30)] + [(3, 0, 1), (None, 1, None), (5, None, None)], "doc_id long, quality int, toxic int")
