"""Operators that keep the documents' columns, with names that clash."""

from readloom.llm import decontaminate, langid, neardup


def test_kept_columns_may_have_any_name(spark):
    rows = [(1, "a short item here", 5, "x", 9), (2, "nothing of that kind in it", 6, "y", 8), (3, "nothing of that kind in it", 7, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, bd_n_hit int, lid_lang string, nd_gone int")
    items = spark.createDataFrame([(1, "short item")], "item_id bigint, text string")
    clean = decontaminate.decontaminate(docs, items)
    assert clean.columns == docs.columns and [tuple(r) for r in clean.orderBy("doc_id").collect()] == rows[1:]
    kept = neardup.deduplicate(docs)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.orderBy("doc_id").collect()] == rows[:2]
    marked = decontaminate.mark(docs, items)
    assert sorted((r.doc_id, r.bd_n_hit) for r in marked.collect()) == [(1, 2), (2, 0), (3, 0)]
    predicted = langid.predict(docs, ([], [], None))
    assert predicted.columns == ["doc_id", "text", "bd_n_hit", "nd_gone", "lid_lang", "lid_score"]
    assert {r.lid_lang for r in predicted.collect()} == {"und"}
