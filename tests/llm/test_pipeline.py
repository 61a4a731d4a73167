"""The corpus pipeline on planted cases, and the registration of all queries."""

from __future__ import annotations

import random
import time

import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline

from .conftest import prose


def test_all_operators_are_registered():
    names = __spark_entry__.queries()
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14)) and "pipeline" in names
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_stages_take_effect(spark, tmp_path):
    r = random.Random(4)
    item, passage = prose(r, 30), prose(r, 60)
    base = prose(r, 200)
    rows = [
        (1, base, "en"), (2, base, "en"), (3, base.replace(base.split()[50], "changed"), "en"), (4, "12 34 !!", "en"), (5, None, None),
        (6, f"{prose(r, 40)} {item} {prose(r, 40)}", "en"), (7, f"{prose(r, 50)}\n{passage}", "en"),
        (8, f"{prose(r, 50)}\n{passage}\n{prose(r, 30)}", "en"), (9, "", "en"), (10, prose(r, 80), "en"), (12, "short text", "en"),
    ]
    docs = spark.createDataFrame([(i, t, x, "s", len(t or "")) for i, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(sorted({x.doc_id for x in now.collect()}))
        if name == "substring_dedup":
            text = {x.doc_id: x.text for x in now.collect()}
            assert passage in text[7] and passage.split()[20] not in text[8].split()[50:]
            assert now.columns == docs.columns
    assert kept[0] == [1, 2, 3, 6, 7, 8, 10, 12]
    assert kept[1] == kept[2] == [1, 6, 7, 8, 10, 12]
    assert kept[3] == kept[4] == [1, 7, 8, 10, 12]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()


def test_no_documents_at_all(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_with_null_and_repeated_ids_count_one_by_one(spark, tmp_path):
    """One row of each group, nothing of a clean text lost, whatever the ids are."""
    r = random.Random(8)
    alone, twice, near, other, shared, item, passage = (prose(r, 80) for _ in range(7))
    changed = near.replace(near.split()[40], "changed")
    leaked, clean, first, second = f"{prose(r, 40)} {item} {prose(r, 40)}", prose(r, 90), f"{passage}\n{prose(r, 50)}", f"{prose(r, 50)}\n{passage}"
    sample = [
        (None, alone), (5, twice), (5, twice), (6, near), (7, changed), (7, other), (None, shared), (None, shared), (8, shared),
        (9, leaked), (9, clean), (None, leaked + " end"), (3, first), (3, second),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in sample], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    now = corpus_pipeline.drop_near_duplicates(spark, now, str(tmp_path))
    want = [(None, alone), (5, twice), (6, near), (7, other), (8, shared), (9, leaked), (9, clean), (3, first), (3, second)]
    assert sorted(((x.doc_id, x.text) for x in now.collect()), key=str) == sorted(want, key=str)
    assert now.columns == docs.columns
    now.write.parquet(f"{tmp_path}/one")
    now = corpus_pipeline.cut_repeats(spark, spark.read.parquet(f"{tmp_path}/one"), str(tmp_path))
    assert sum(passage.split()[20:60] == x.text.split()[a : a + 40] for x in now.collect() for a in range(len(x.text.split()))) == 1
    now.write.parquet(f"{tmp_path}/two")
    now = corpus_pipeline.decontaminate(spark, spark.read.parquet(f"{tmp_path}/two"), str(tmp_path))
    left = sorted(((x.doc_id, x.text) for x in now.where("doc_id != 3 OR doc_id IS NULL").collect()), key=str)
    assert left == sorted([(None, alone), (5, twice), (6, near), (7, other), (8, shared), (9, clean)], key=str)
    again = spark.createDataFrame([(None, leaked), (9, clean), (9, leaked)], "doc_id long, text string")
    assert [x.text for x in corpus_pipeline.decontaminate(spark, again, str(tmp_path)).collect()] == [clean]


def test_rows_without_words_stay(spark, tmp_path):
    docs = spark.createDataFrame([(None, None), (None, " "), (1, ""), (1, "")], "doc_id long, text string")
    assert corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).count() == 4


def test_documents_in_several_languages_stay(spark, tmp_path):
    r = random.Random(2)
    tongues = {"aa": ["kalo", "kamo", "kolana", "makalo"], "bb": ["strich", "schrift", "tritsch", "strift"], "cc": ["ouvelle", "ellevue", "vueille", "queue"]}
    say = {lang: lambda n, w=w: " ".join(r.choice(w) for _ in range(n)) for lang, w in tongues.items()}
    sample = [(i, say[lang](60), lang) for i, lang in enumerate(list(tongues) * 20)]
    sample += [(100, f"{say['aa'](40)}\n{say['bb'](35)}\n{say['cc'](25)}", None), (101, "12 34", None)]
    docs = spark.createDataFrame([(i, t, x, "s", len(t)) for i, t, x in sample], "doc_id long, text string, lang string, source string, n_chars long")
    got = {x.doc_id for x in corpus_pipeline.identify_language(spark, docs, str(tmp_path)).collect()}
    assert got == {i for i, _, _ in sample} - {101}


def test_columns_of_any_name_come_back_as_they_were(spark, tmp_path):
    r = random.Random(6)
    item, passage = prose(r, 30), prose(r, 60)
    texts = [prose(r, 80), f"{prose(r, 40)}\n{passage}", f"{prose(r, 50)}\n{passage}\n{prose(r, 20)}", f"{prose(r, 30)} {item} {prose(r, 30)}"]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    more = ["_key", "_id", "_spans", "_language", "_place", "component_id", "start", "row", "spans", "own", "digest", "n", "h", "_KEY_"]
    rows = [(i, t, "en", "s", len(t), *(f"{c}{i}" for c in more)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "n_chars", *more])
    wanted = {row[0]: row[5:] for row in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        got = {x[0]: tuple(x[5:]) for x in out.collect()}
        assert got == {i: wanted[i] for i in got} and len(got) >= 3, name
    assert corpus_pipeline.pack(spark, docs, str(tmp_path)).select("doc_id").distinct().count() == 4


def test_long_texts_go_to_python_a_few_mb_at_a_time(spark, texts):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    @corpus_pipeline.bounded
    def stage(spark, docs, sf_dir):
        return docs.coalesce(1).mapInArrow(sizes, "n long")

    found = [r.n for r in stage(spark, texts([(i, "long " * 20_000) for i in range(200)]), "").collect()]
    assert 20_000_000 <= sum(found) and max(found) < 5_000_000


def test_shuffle_files_of_a_stage_go_with_its_query(spark):
    def blocks() -> int:
        return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().size()

    docs = spark.range(1000).withColumn("text", F.lit("x"))
    before = blocks()
    stage = corpus_pipeline.bounded(lambda spark, docs, sf_dir: docs.groupBy(F.col("id") % 7).count())
    rows = stage(spark, docs, "").collect()
    for _ in range(50):  # they go in the background
        if blocks() <= before:
            break
        time.sleep(0.1)
    assert len(rows) == 7 and blocks() <= before
