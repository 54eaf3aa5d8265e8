from gridextremes.llm import quality


def test_texts_are_searched_once(spark):
    """What joins the rates reads the evidence; it does not search the texts again."""
    docs = spark.createDataFrame([(i, "good words here" if i % 2 else "!! ## @@ 12 12", "s", "en") for i in range(20)],
                                 "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    judged = quality.judge(docs, labels, docs["source"], docs["lang"])
    assert "regexp" not in judged._jdf.queryExecution().executedPlan().toString().lower()
    assert {r["doc_id"] % 2 for r in judged.where("kept").select("row.doc_id").collect()} == {1}
