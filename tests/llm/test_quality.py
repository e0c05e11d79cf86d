import math
import random

import pytest

from sift.llm import quality as ql
from sift.llm.quality import classify_quality
from sift.llm.rules import RISK, RULES, _beta_tail, choose, least_rows, quality_rules, upper_bound

SF = "/root/testdata/sf0.01"


def test_binomial_tail_and_bound():
    for n in (1, 7, 40, 300):
        for k in (0, 1, n // 3, n - 1):
            for p in (0.01, 0.2, 0.7):
                want = sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1))
                assert abs(_beta_tail(k, n, p) - want) < 1e-9
    assert upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** 0.01, abs=1e-9)
    assert upper_bound(3, 3, 0.05) == 1.0 and upper_bound(0, 0, 0.05) == 1.0


def test_cutoffs_limit_false_rejection():
    n = 5000
    got = choose([("en", "upper", k, over, n) for k, over in enumerate([900, 400, 30, 5, 0, 0])])
    assert got == {"en": {"upper": 0.5}}  # 5 of 5000 is certified, 30 is not, and testing ends there
    assert choose([("de", "upper", k, 0, 20) for k in range(6)]) == {}


def test_counts_and_verdicts(docs, rows, labels, no_docs):
    import re
    got = {r.doc_id: r for r in quality_rules(docs, labels).collect()}
    for r in rows:
        if r[0] is None:
            continue
        t = r[1] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        g = {}
        for i in range(len(w) - 7):
            g.setdefault(tuple(w[i:i + 8]), []).append(i)
        rep = len({j for v in g.values() if len(v) > 1 for i in v for j in range(i, i + 8)})
        x = got[r[0]]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), rep), r[0]
        assert x.base_failed == (len(w) < 20 or 100 * rep > 30 * len(w)) and not (x.base_failed and x.kept)
    assert quality_rules(no_docs, labels).count() == 0
    assert quality_rules(docs, labels.limit(0)).count() == len(rows)


def test_classifier_edges(docs, rows, labels, no_docs):
    got = classify_quality(docs, labels, ["doc_id", "n"])
    assert got.count() == len(rows) and got.columns[:2] == ["doc_id", "n"]
    assert classify_quality(no_docs, labels, ["doc_id"]).count() == 0
    none = classify_quality(docs, labels.limit(0), ["doc_id"])
    assert none.where("kept").count() == len(rows)


def test_classifier_accuracy_on_held_out_labels(spark):
    d, lab = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    ids = [r.doc_id for r in lab.collect()]
    held = set(random.Random(1).sample(ids, len(ids) // 3))
    got = classify_quality(d, lab.where(~lab.doc_id.isin(held)), ["doc_id"]).join(lab, "doc_id").where(lab.doc_id.isin(held)).collect()
    right = sum(r.kept == (r.quality == 1 and r.toxic == 0) for r in got)
    assert right >= 0.9 * len(got)


def _plain_strength(groups):
    """Beta strength by moments of (rows, rate, rate above) groups."""
    n = sum(g[0] for g in groups)
    if not n or len(groups) < 2:
        return 1e6
    spread = sum(c * a * (1 - a) for c, _, a in groups) / n
    room = n - sum(c * c for c, _, _ in groups) / n
    tau = (sum(c * (r - a) ** 2 for c, r, a in groups) - (len(groups) - 1) * spread) / room if room > 0 else 0.0
    return min(1e6, max(1.0, spread / tau - 1)) if tau > 0 else 1e6


def _check_posteriors(got):
    """Shrinkage and posterior of every row again, row by row, from the documents' own evidence."""
    clip = lambda x: min(1 - 1e-6, max(1e-6, x))
    mu = clip(sum(r.p_document for r in got) / len(got))
    hosts, paths = {}, {}
    for r in got:
        for table, key in ((hosts, r.host), (paths, (r.host, r.path))):
            table.setdefault(key, []).append(r.p_document)
    rate = lambda v: sum(v) / len(v)
    k_host = _plain_strength([(len(v), rate(v), mu) for v in hosts.values()])
    k_path = _plain_strength([(len(v), rate(v), rate(hosts[k[0]])) for k, v in paths.items()])
    for r in got:
        h, s, p = hosts[r.host], paths[(r.host, r.path)], r.p_document
        p_host = clip((sum(h) - p + k_host * mu) / (len(h) - 1 + k_host))
        p_path = clip((sum(s) - p + k_path * p_host) / (len(s) - 1 + k_path))
        odds = math.log(p / (1 - p)) + math.log(p_path / (1 - p_path)) - math.log(mu / (1 - mu))
        assert (r.p_host, r.p_path) == (pytest.approx(p_host, rel=1e-6), pytest.approx(p_path, rel=1e-6))
        assert r.p_good == pytest.approx(1 / (1 + math.exp(-odds)), rel=1e-6, abs=1e-9)
        assert r.kept == (odds >= 0) or abs(odds) < 1e-6
    return k_host, k_path


def test_posteriors_equal_brute_force(spark, docs, rows, labels):
    got = classify_quality(docs, labels, ["doc_id"]).collect()
    assert len(got) == len(rows)
    _check_posteriors(got)
    rng = random.Random(8)
    good = lambda: " ".join(rng.choice(("river", "stone", "garden", "window", "letter")) + str(rng.randint(0, 99)) for _ in range(40)) + "."
    bad = lambda: "$ # " * rng.randint(5, 20) + "buy " * rng.randint(5, 30)
    share = {("a", "x"): 0.95, ("a", "y"): 0.5, ("b", "x"): 0.1, ("b", None): 0.4, (None, "x"): 0.9}
    table = [(i, good() if (is_good := rng.random() < share[site]) else bad(), *site, int(is_good))
             for i, site in enumerate(rng.choices(list(share), (30, 20, 40, 8, 2), k=600))]
    d = spark.createDataFrame([r[:4] for r in table], "doc_id long, text string, source string, lang string").repartition(4)
    lab = spark.createDataFrame([(r[0], r[4], 0) for r in table if r[0] % 3 == 0], "doc_id long, quality int, toxic int")
    got = classify_quality(d, lab, ["doc_id"]).collect()
    k_host, k_path = _check_posteriors(got)
    assert k_host < 1e6 and k_path < 1e6  # sites differ, so strengths are estimated


def test_sparse_sites_shrink_to_the_level_above(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = classify_quality(d, spark.read.parquet(f"{SF}/labels.parquet"), ["doc_id", "source"])
    p = got.selectExpr("min(p_path)", "max(p_path)", "avg(p_document)").first()
    assert 0 < p[0] <= p[2] + 0.2 and p[1] < 1


def test_least_rows_certify_a_cutoff_without_rejections():
    n = least_rows()
    error, risk = 0.05 / len(RULES), RISK / len(RULES)
    assert upper_bound(0, n - 1, error) > risk and upper_bound(0, n + 1, error) <= risk


def test_all_labelled_documents_certify_not_only_the_sample(spark):
    """A language with 900 good documents gets its rules, however few of them the term-learning sample holds."""
    rng = random.Random(2)
    text = lambda: " ".join(f"w{rng.randint(0, 10 ** 6)}" for _ in range(25))
    rows = [(i, text(), "en" if i % 4 else "de") for i in range(3600)] + [(5000 + i, text(), "fr") for i in range(600)]
    rows += [(9000 + i, text() + " # # # # # # # # # #", lang) for i, lang in enumerate(("en", "de", "fr"))]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    lab = spark.createDataFrame([(r[0], 1, 0) for r in rows if r[0] < 9000], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_rules(d, lab, max_labels=100).collect()}
    assert len(got) == len(rows)
    assert not got[9000].kept and not got[9001].kept and "symbols" in got[9001].failed_rules
    assert got[9002].kept  # 600 good documents certify nothing
    assert all(got[i].kept for i in range(3600))


def test_a_repeated_labelled_id_is_one_training_row(spark, monkeypatch):
    rng = random.Random(6)
    text = lambda: " ".join(f"w{rng.randint(0, 50)}" for _ in range(30))
    rows = [(i, text()) for i in range(40)] + [(1, text()) for _ in range(150)] + [(2, None)] * 20
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    lab = spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    sizes = []

    class Watched(ql.Evidence):
        def __init__(self, x, good, ridge=1.0):
            sizes.append((len(x), int(good.sum())))
            super().__init__(x, good, ridge)
    monkeypatch.setattr(ql, "Evidence", Watched)
    ql.fit(d, lab, "doc_id", "text", 20)
    ql.fit(d, lab, "doc_id", "text", 1000)
    assert sizes[0][0] == 20 and sizes[1] == (30, 15)
