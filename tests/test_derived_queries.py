"""Search queries of questions with unspaced Chinese runs and glossary terms."""

from marlstone.operators import search


def derive(spark, question, glossary=None, most=6):
    terms = spark.createDataFrame([(t,) for t in glossary], "term string") if glossary else None
    return [r.query for r in search.derived_queries(spark.createDataFrame([(1, question)], "id long, q string"), "id", "q", most, terms).orderBy("place").collect()]


def test_windows_of_chinese_runs(spark):
    assert derive(spark, "注意力机制", most=20) == ["注意力机", "意力机制", "注意力", "意力机", "力机制", "注意", "意力", "力机", "机制"]
    assert derive(spark, "机制 GPU") == ["gpu", "机制"]
    assert derive(spark, "什么是图") == ["什么是图", "什么是", "么是图", "么是", "是图"]
    assert derive(spark, "") == []


def test_glossary_terms_come_first(spark):
    assert derive(spark, "explain the GNN 图网络", [" GNN ", "图网", "absent", ""]) == ["gnn", "图网", "explain", "图网络", "网络"]
