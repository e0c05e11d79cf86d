import re

from sift.llm.licenses import BASE, PASSAGES, scan_licenses


def brute(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hits = sorted((k, BASE[p]) for p in BASE for k in range(len(w)) if w[k:k + len(p.split())] == p.split())
    return len(w), len(hits), hits[0][0] if hits else None, max(k for k, _ in hits) if hits else None, ",".join(sorted({x for _, x in hits}))


def test_equals_brute_force(docs, rows):
    got = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in scan_licenses(docs).collect()]
    want = [(r[0], *brute(r[1])) for r in rows]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_passages_with_gaps_and_empty_table(spark, no_docs):
    w = PASSAGES["mit-text"].split()
    edited = " ".join(w[:12] + ["really"] + w[12:30] + w[32:])
    df = spark.createDataFrame([(1, "intro " + PASSAGES["mit-text"].upper()), (2, edited), (3, " ".join(w[:8]))], "doc_id long, text string")
    got = {r.doc_id: r for r in scan_licenses(df).collect()}
    assert got[1].labels == "mit-text" and got[1].score == 1.0 and got[1].spans[0].first_word == 1
    assert got[2].labels == "mit-text" and 0.5 < got[2].score < 1
    assert got[3].labels == "" and got[3].score == 0.0
    assert scan_licenses(no_docs).count() == 0
