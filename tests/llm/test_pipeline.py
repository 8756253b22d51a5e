"""The pipeline against plain versions of its stages."""

import hashlib
import random

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline as C
from marlstone.llm import jaccard_join, language_mix, mix_schedule, registry, toxicity

from .test_joins import brute, fill
from .test_quality import WORDS, say


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, d = random.Random(12), tmp_path_factory.mktemp("tables")
    rows, labels = [], []
    for k in range(160):
        lang = rng.choice(list(WORDS))
        text = say(lang, rng.randrange(5, 60), rng)
        toxic = rng.random() < 0.25
        if toxic:
            text = f"worthless moron {text} you idiot clown moron"
        labels.append((k, 1, int(toxic)))
        rows.append((k, text, lang, rng.choice(["a", "b", "c", None]), len(text)))
    rows += [(200 + k, rows[k][1], rows[k][2], "a", rows[k][4]) for k in range(12)]
    rows += [(300, None, "en", "a", 0), (301, "", "en", "b", 0), (302, "... 12", "de", "c", 6), (303, "le " * 5000, "fr", "b", 15000), (None, rows[3][1] + " fin", "en", "a", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
    return str(d)


def test_stages_against_plain_versions(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    names = [k for k, _ in C.STAGES]
    assert len(names) == 5

    first = C.STAGES[0][1](spark, docs, tables)
    lang = {r.doc_id: r.lang_pred for r in language_mix.identify(docs).collect()}
    assert first.columns == columns
    assert sorted(str(r.doc_id) for r in first.collect()) == sorted(str(i) for i, x in lang.items() if x != "und")

    second = C.STAGES[1][1](spark, first, tables)
    bad = {r.doc_id for r in toxicity.classify(first, spark.read.parquet(f"{tables}/labels.parquet")).collect() if r.predicted}
    assert second.columns == columns and bad
    assert sorted(str(r.doc_id) for r in second.collect()) == sorted(str(r.doc_id) for r in first.collect() if r.doc_id not in bad)

    third = C.STAGES[2][1](spark, second, tables).cache()
    groups = brute([(r.doc_id, r.text) for r in second.collect()])
    assert third.columns == columns
    assert sorted(r.doc_id for r in third.collect() if r.doc_id is not None) == sorted({c for none, _, _, c in groups if not none})

    fourth = C.STAGES[3][1](spark, third, tables).cache()
    kept = third.collect()
    sizes = {}
    for r in kept:
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    taken = dict.fromkeys(sizes, 0)
    whole = {r.doc_id: r for r in kept}
    assert fourth.columns == columns
    for r in fourth.collect():
        taken[r.source] += len(r.text.split())
        assert whole[r.doc_id].text.startswith(r.text) and r.n_chars in (len(r.text), whole[r.doc_id].n_chars)
    assert all(abs(taken[s] - t) <= 1 for s, t in fill(sizes).items())

    fifth = C.STAGES[4][1](spark, fourth, tables)
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.no_truncation()
    want = sorted((str(r.doc_id), hashlib.sha256(",".join(map(str, t.encode(r.text, add_special_tokens=False).ids)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()) for r in fourth.collect())
    assert sorted((str(r.doc_id), r.ids_sha256, r.decoded_sha256) for r in fifth.collect()) == want

    assert sorted(map(str, C.run(spark, tables).collect())) == sorted(map(str, fifth.collect()))


def test_empty_corpus(spark, tables, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{tables}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0


def test_registered_queries():
    names = [k for k in entry.queries() if k.startswith("op") and k[2].isdigit()]
    assert sorted(int(k[2:].split("_")[0]) for k in names) == list(range(1, 14))
    assert entry.queries()["pipeline"] is C.run
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert jaccard_join.PERCENT == 90 and mix_schedule.MOST == 3


def test_stages_keep_extra_columns_with_clashing_names(spark, tables):
    """Ties (equal texts of several ids) and columns that the stages use themselves, stages 1 to 4."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for name in ("score", "toxic", "component_id", "size", "row", "n", "lettered", "taken"):
        docs = docs.withColumn(name, F.lit(name))
    docs = docs.unionByName(docs.filter("doc_id < 4").withColumn("doc_id", F.col("doc_id") + 900))
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, tables)
        assert out.columns == docs.columns, name
        assert {r.size for r in out.select("size").distinct().collect()} == {"size"}, name
