"""What users plug in, and settings."""

import pytest
from pyspark.sql import functions as F

from marlstone.plans import surfaces as S
from marlstone.sources import feeds


def test_functions_in_sql(spark):
    assert "plain_key" in S.register_functions(spark)
    row = spark.sql("SELECT plain_key('Deep-Learning (DL)') AS k, mastery_level(60D) AS m, clamp(2000, 1, 1000) AS c, text_digest(NULL) AS d").first()
    assert (row.k, row.m, row.c, row.d[:8]) == ("deep learning", "learning", 1000, "e3b0c442")


class Doubled:
    name, inputs, runs = "doubled", ("base",), 0

    def validate(self, inputs):
        return [] if "x" in inputs["base"].columns else ["no column x"]

    def run(self, inputs):
        self.runs += 1
        return inputs["base"].withColumn("y", F.col("x") * 2)


def test_transforms_run_once_for_equal_inputs(spark):
    t, base = Doubled(), spark.range(3).select(F.col("id").alias("x"))
    tables, marks = S.run_transforms([t], {"base": base}, {}, {}, {"base": "1"})
    assert sorted(r.y for r in tables["doubled"].collect()) == [0, 2, 4]
    S.run_transforms([t], tables, marks, {}, {"base": "1"})
    assert t.runs == 1
    S.run_transforms([t], tables, marks, {"doubled": {"k": 1}}, {"base": "1"})
    S.run_transforms([t], tables, marks, {}, {"base": "2"})
    assert t.runs == 3
    with pytest.raises(ValueError, match="no column x"):
        S.run_transforms([t], {"base": spark.range(1)}, {}, {}, {"base": "1"})


def test_validators_refuse_rows(spark):
    rows = spark.range(5)
    assert S.checked(rows, lambda r: r.filter("id > 9")) is rows
    with pytest.raises(ValueError, match="refuses"):
        S.checked(rows, lambda r: r.filter("id > 3"))


def test_settings():
    assert S.merged({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"b": 9}, "d": {"e": 1}}) == {"a": {"b": 9, "c": 2}, "d": {"e": 1}}
    templates = {"base": {"retry": {"max": 1, "delay": 5}}, "mid": {"extends": "base", "retry": {"max": 2}}, "job": {"extends": "mid", "pool": "ai"}, "loop": {"extends": "loop"}}
    assert S.extended("job", templates) == {"retry": {"max": 2, "delay": 5}, "pool": "ai"}
    for bad in ("loop", "none"):
        with pytest.raises(ValueError):
            S.extended(bad, templates)
    got = S.substituted({"a": "$N", "b": ["${T}", "x-$N", "$U"], "c": 1}, {"N": "12", "T": "1.5"})
    assert got == {"a": 12, "b": [1.5, "x-12", "$U"], "c": 1}


def test_backend_by_protocol(spark):
    rows = spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "id long, body string")
    assert [r.id for r in S.SubstringBackend().search(rows, "beta", ("body",), "id").collect()] == [1]


def test_sources_and_stores(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for name, text in (("a.mp3", "x"), ("sub/b.PDF", "yy"), ("c.bin", "z"), ("d.json", '{"n": 3}'), ("e.json", "broken"), ("f.json", '{"n": 4, "pad": "' + "x" * 100 + '"}')):
        (tmp_path / "in" / name).write_text(text)
    got = {r.title: (r.content_type, r.item_id.split("|")[:2]) for r in feeds.items(spark, "local_dir", str(tmp_path / "in")).collect()}
    assert got == {"a.mp3": ("audio", ["a.mp3", "1"]), "b.PDF": ("document", ["sub/b.PDF", "2"])}
    values = {r.path.rsplit("/", 1)[1]: (r.oversized, r.value and r.value.n) for r in feeds.json_artifacts(spark, str(tmp_path / "in" / "*.json"), "n long", 64).collect()}
    assert values == {"d.json": (False, 3), "e.json": (False, None), "f.json": (True, None)}
    with pytest.raises(ValueError, match="registered"):
        feeds.register("local_dir", feeds.listing)
    with pytest.raises(ValueError, match="unknown source"):
        feeds.items(spark, "moon", "x")
    store = str(tmp_path / "store")
    contents = lambda *texts: spark.createDataFrame([(t,) for t in texts], "content string").select(F.sha2("content", 256).alias("name"), "content")
    assert {r.kind for r in feeds.store_contents(contents("a", "b"), store).collect()} == {"stored"}
    assert sorted(r.kind for r in feeds.store_contents(contents("b", "c"), store).collect()) == ["same", "stored"]
    assert spark.read.parquet(store).count() == 3
    with pytest.raises(ValueError, match="can't be stored"):
        feeds.store_contents(contents("d").withColumn("content", F.lit("e")), store)
