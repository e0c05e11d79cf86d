"""Corpus scan, empty-corpus guard, collection get-or-create and upsert."""
import os

import pytest

from sift.sources import corpus as A


def test_read_corpus_with_fallback(spark, tmpdir_fresh):
    os.makedirs(os.path.join(tmpdir_fresh, "a", "b"))
    with open(os.path.join(tmpdir_fresh, "a", "u.txt"), "w", encoding="utf-8") as f:
        f.write("héllo wörld")
    with open(os.path.join(tmpdir_fresh, "a", "b", "l.txt"), "wb") as f:
        f.write("café".encode("latin-1"))
    with open(os.path.join(tmpdir_fresh, "a", "skip.md"), "w") as f:
        f.write("no")
    got = {os.path.basename(r.source): r.text for r in A.read_corpus(spark, tmpdir_fresh).collect()}
    assert got == {"u.txt": "héllo wörld", "l.txt": "café"}


def test_empty_corpus_names_files(spark, tmpdir_fresh):
    with open(os.path.join(tmpdir_fresh, "x.pdf"), "w") as f:
        f.write("x")
    with pytest.raises(A.EmptyCorpusError, match="pdf"):
        A.require_corpus(A.read_corpus(spark, tmpdir_fresh), tmpdir_fresh)


def test_collection_modes(spark, tmpdir_fresh):
    path = os.path.join(tmpdir_fresh, "coll")
    df1 = spark.createDataFrame([("1", "s1", "a")], "chunk_id string, source string, content string")
    df2 = spark.createDataFrame([("1", "s1", "a"), ("2", "s2", "b")], "chunk_id string, source string, content string")
    A.save_collection(df1, path, "ignore")
    A.save_collection(df2, path, "ignore")           # exists: untouched
    assert spark.read.parquet(path).count() == 1
    assert A.append_new(df2, path) == 1               # only the new id is added
    assert A.append_new(df2, path) == 0
    twice = spark.createDataFrame([("3", "s2", "c"), ("3", "s2", "d")], df2.schema)
    assert A.append_new(twice, path) == 1             # an id repeated in the batch is added once
    assert spark.read.parquet(path).count() == 3
    A.save_collection(df1, path, "refresh")
    assert spark.read.parquet(path).count() == 1


def test_clear_session(spark):
    log = spark.createDataFrame([("a", 0), ("b", 0), ("a", 1), (None, 0)], "session_id string, turn int")
    assert {r.session_id for r in A.clear_session(log, "a").collect()} == {"b", None}


def test_collection_auto_refresh(spark, tmpdir_fresh):
    path = os.path.join(tmpdir_fresh, "coll")
    a = spark.createDataFrame([("1", "s1", "a")], "chunk_id string, source string, content string")
    b = spark.createDataFrame([("1", "s1", "changed")], "chunk_id string, source string, content string")
    assert A.save_collection(a, path, "auto") is True
    assert A.save_collection(a, path, "auto") is False      # same content: untouched
    assert A.save_collection(b, path, "auto") is True       # changed: rewritten
    assert spark.read.parquet(path).first().content == "changed"


TEXTS = {"es": "El niño comió piña en la mañana; ¿dónde está el corazón? Qué lástima, señor Muñoz.",
         "de": "Die schöne Straße führt über große Hügel. Müller läßt grüßen, während Ärzte öfter prüfen.",
         "fr": "L'été dernier, où étaient les élèves? Ça fait déjà longtemps; le garçon a mangé des gâteaux à Noël.",
         "ru": "Съешь ещё этих мягких французских булок, да выпей же чаю. Москва не сразу строилась."}


def test_encodings_are_detected():
    from sift.sources.encodings import decode
    for lang, codecs in {"es": ("utf-8", "cp1252", "utf-16-le", "utf-16-be", "utf-32-be", "mac_roman", "cp850"), "de": ("utf-8-sig", "cp1252", "utf-16", "mac_roman", "cp850"),
                         "fr": ("cp1252", "utf-32-le", "utf-16-be", "mac_roman"), "ru": ("utf-8", "cp1251", "koi8_r", "utf-16-le")}.items():
        for codec in codecs:
            text, name = decode((TEXTS[lang] * 3).encode(codec))
            assert text == TEXTS[lang] * 3, (lang, codec, name)
    assert decode(b"") == ("", "utf-8") and decode(b"plain") == ("plain", "utf-8")
    assert decode(bytes([0x81, 0x8D, 0xFF, 0x00, 0x98]) * 3)[0]  # nothing fits: still decoded


def test_read_corpus_detects(spark, tmpdir_fresh):
    for i, codec in enumerate(("utf-8", "cp1252", "utf-16", "utf-16-be", "utf-32")):
        with open(os.path.join(tmpdir_fresh, f"{i}.txt"), "wb") as f:
            f.write((TEXTS["fr"] * 2).encode(codec))
    got = A.read_corpus(spark, tmpdir_fresh).collect()
    assert len(got) == 5 and all(r.text == TEXTS["fr"] * 2 for r in got)
    assert {os.path.basename(r.source): r.encoding for r in got}["0.txt"] == "utf-8"


def test_inventory_counts_files_written_in_parts(spark, tmpdir_fresh, monkeypatch):
    """The four files of ``a2_file_inventory`` are written by all tasks, not one task each."""
    from sift.plans import QUERIES, q_corpus
    rows = [(i, "line " * (i % 7)) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(8).write.parquet(f"{tmpdir_fresh}/documents.parquet")
    written = []

    def listed(spark, path, result):
        root = path.removeprefix("file:")
        written.extend(os.path.join(d, f) for d, _, files in os.walk(root) for f in files if f.endswith(".txt"))
        assert [tuple(r) for r in A.file_inventory(spark, path).collect()] == [("txt", len(written), sum(map(os.path.getsize, written)))]
        return result

    monkeypatch.setattr(q_corpus, "drop_path", listed)
    got = [tuple(r) for r in QUERIES["a2_file_inventory"](spark, tmpdir_fresh).collect()]
    assert got == [("txt", 4, sum(len(t) + 1 for _, t in rows))]
    assert len(written) >= 16 and max(map(os.path.getsize, written)) * 8 < got[0][2]
