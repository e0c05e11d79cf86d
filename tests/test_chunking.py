"""Recursive chunking: invariants (hypothesis) and agreement with a slow reference splitter."""
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from sift.operators.chunking import chunk_documents, split_text, start_indexes
from sift.plans.profiles import PROFILES

SEPS = PROFILES["advanced"].chunk.separators


def slow_split(text, size, overlap, seps):
    """Independent formulation: regex split keeping separators, same greedy merge."""
    if not seps:
        return [text]
    sep, rest = seps[-1], []
    for i, s in enumerate(seps):
        if s == "" or s in text:
            sep, rest = s, list(seps[i + 1:]) if s != "" else []
            break
    if sep == "":
        pieces = list(text)
    else:
        parts = re.split("(" + re.escape(sep) + ")", text)
        pieces = [parts[0]] + [parts[i] + parts[i + 1] for i in range(1, len(parts) - 1, 2)]
        pieces = [p for p in pieces if p]
    out, buf = [], []

    def flush():
        cur, tot = [], 0
        for p in buf:
            if tot + len(p) > size and cur:
                j = "".join(cur).strip()
                if j:
                    out.append(j)
                while tot > overlap or (tot + len(p) > size and tot > 0):
                    tot -= len(cur.pop(0))
            cur.append(p)
            tot += len(p)
        j = "".join(cur).strip()
        if j:
            out.append(j)

    for p in pieces:
        if len(p) < size:
            buf.append(p)
        else:
            if buf:
                flush()
                buf = []
            out.extend(slow_split(p, size, overlap, rest) if rest else [p])
    if buf:
        flush()
    return out


text_st = st.text(alphabet=st.sampled_from(list("ab cd.\n!?;é")), min_size=0, max_size=1500)


@settings(max_examples=200, deadline=None)
@given(text_st, st.integers(20, 120), st.integers(0, 19))
def test_invariants(text, size, overlap):
    chunks = split_text(text, size, overlap, SEPS)
    starts = start_indexes(text, chunks, overlap)
    for c, s in zip(chunks, starts):
        assert c and c == c.strip()
        assert len(c) <= size                      # "" is in the separator list
        assert s >= 0 and text[s:s + len(c)] == c
    assert starts == sorted(starts)
    covered = set()
    for c, s in zip(chunks, starts):
        covered.update(range(s, s + len(c)))
    assert all(i in covered for i, ch in enumerate(text) if not ch.isspace())


@settings(max_examples=200, deadline=None)
@given(text_st, st.integers(20, 120), st.integers(0, 19))
def test_matches_slow_splitter(text, size, overlap):
    assert split_text(text, size, overlap, SEPS) == slow_split(text, size, overlap, SEPS)


def test_spark_job_equals_helper(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "source", "text")
    spec = PROFILES["advanced"].chunk
    got = chunk_documents(docs, spec.size, spec.overlap, spec.separators).collect()
    want = []
    for r in docs.collect():
        cs = split_text(r.text, spec.size, spec.overlap, spec.separators)
        want += [(r.doc_id, i, c) for i, c in enumerate(cs)]
    assert sorted((g.doc_id, g.chunk_no, g.content) for g in got) == sorted(want)


def test_no_empty_separator_keeps_long_word():
    word = "x" * 700
    assert split_text(word, 300, 30, PROFILES["fast"].chunk.separators) == [word]
